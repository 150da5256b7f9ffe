"""The training-data operators against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import math
import random
import re
import threading
from collections import Counter, defaultdict

import numpy as np
import psutil
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import backoff, bagminhash, bpe, components, fingerprint, html, mixing, pii, quality, registry, sentences, shingles, spans, suffixes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words long, _key string, n_tokens string"


def words_of(text):
    return WORD.findall(text or "")


def shingles_of(text, n=5):
    w = words_of(text)
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


@pytest.fixture(scope="module")
def docs(spark):
    """Ordinary texts and the awkward ones, with columns whose names the operators use themselves."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ß😀", "the", "of"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
    base = say(200)
    near = base.split(" ")
    near[40] = "changed"
    texts = [None, "", " \n\t", "one", "a b c d", base, base, " ".join(near), say(60) + " " + " ".join(base.split(" ")[50:130]) + " " + say(40), say(20_000), "x" * 100_000, "And " * 300, say(120), say(80), say(90) + " mail me@x.org or +1 (555) 010-9999, 10.0.0.1 4012 8888 8888 1881"]
    rows = [(i, t, f"s{i % 4}" if i % 5 else None, -1, "k", "n") for i, t in enumerate(texts)]
    rows += [rows[5], rows[12], (None, say(70), None, 0, "", ""), (None, base, "s1", 0, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# --- shared parts --------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b.", max_size=40), max_size=6))
def test_words_and_shingles(texts):
    got = []
    for _, _, data, offsets in shingles.blocks(pa.array(texts, pa.string())):
        of = shingles.words(data, offsets)
        raw = data.tobytes()
        got += [[raw[of.starts[k] : of.ends[k]].decode() for k in range(a, b)] for a, b in zip(of.first[:-1], of.first[1:], strict=True)]
        hashes, first = shingles.shingles(of)
        assert [b - a for a, b in zip(first[:-1], first[1:], strict=True)] == [sum(shingles_of(t).values()) for t in texts[: len(first) - 1]]
    assert got == [words_of(t) for t in texts]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and set(got) == {x for e in edges if e[0] != e[1] for x in e}


# --- 1 -------------------------------------------------------------------------------------------------------------

def measured(text):
    t = text or ""
    w = words_of(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_quality_measures(spark, docs, empty):
    rows = docs.select("doc_id", "text").join(docs.select("doc_id"), "doc_id", "left_semi").collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score(docs).collect() if r.doc_id is not None)
    want = Counter()
    for r in rows:
        m = measured(r.text)
        want[r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]] += 1
    assert got == want
    assert quality.score(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (0, 1, 2, 3, 4, 11)").isEmpty() and kept.filter("doc_id IN (5, 7, 8, 9)").count() == 5


def test_a_failing_host_goes(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows = [(i, text(10), "bad") for i in range(200)] + [(1000, text(90), "bad")] + [(2000 + i, text(90), f"good{i % 5}") for i in range(400)] + [(5000, text(8), "tiny"), (5001, text(90), "tiny")]
    out = {r.doc_id: r.kept for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not out[1000] and out[2000] and out[5001] and not out[5000]


# --- 2 -------------------------------------------------------------------------------------------------------------

def test_bagminhash_estimates_weighted_jaccard():
    rng = random.Random(4)
    gaps = []
    for _ in range(30):
        a = [f"v{rng.randrange(40)}" for _ in range(150)]
        b = a[:110] + [f"v{rng.randrange(40)}" for _ in range(rng.randrange(20, 90))]
        _, _, data, offsets = next(shingles.blocks(pa.array([" ".join(a), " ".join(b)])))
        hashes, first = shingles.shingles(shingles.words(data, offsets), 1)
        x = bagminhash.signatures(hashes, first, 1024)
        ca, cb = Counter(a), Counter(b)
        gaps.append((x[0] == x[1]).mean() - sum((ca & cb).values()) / sum((ca | cb).values()))
    assert abs(np.mean(gaps)) < 0.012 and np.std(gaps) < 0.025


def near_classes(rows, least=0.8):
    bags = [shingles_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            whole = sum(bags[i].values()) + sum(bags[j].values()) - both
            if (rows[i][1] or "") == (rows[j][1] or "") or (whole and both / whole >= least):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    out = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        out[find(i)].append(k)
    return Counter((k, min((x for x in ks if x is not None), default=None)) for ks in out.values() for k in ks)


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.class_id) for r in bagminhash.classes(docs).collect()) == near_classes(rows)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert Counter((r.doc_id, r.class_id) for r in bagminhash.classes(table).collect()) == near_classes(rows)
    assert bagminhash.classes(empty).count() == 0
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter({c for _, c in near_classes([(r.doc_id, r.text) for r in docs.collect()])})


def test_near_copies_of_one_text_far_from_each_other(spark):
    """A star: copies are near the middle and not near each other; all are one class, without a pair of copies."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(180)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for k in rng.sample(range(180), 3):
            copy[k] = f"c{i}-{k}"
        rows.append((i, " ".join(copy)))
    out = bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id) for r in out) == near_classes(rows)


@pytest.mark.parametrize(("texts", "most", "reach"), [(150, 18, 256), (150, 28, 256), (300, 40, 256), (150, 28, 4)])
def test_crowds_of_texts_that_are_nearly_alike(spark, monkeypatch, texts, most, reach):
    """Copies of one text with more and more changes: many pairs lie just above and just below 0.8, and none loses its class.

    With a short reach, and so in rounds of other orders, at least 0.95 keep theirs."""
    rng = random.Random(16)
    base, rows = [f"b{i}" for i in range(300)], []
    for i in range(texts):
        copy = list(base)
        for k in rng.sample(range(300), rng.randrange(1, most)):
            copy[k] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(0, texts, 5):  # a partner of its own, far from the rest
        copy = rows[i][1].split(" ")
        for k in rng.sample(range(300), 3):
            copy[k] = f"d{rng.randrange(10**6)}"
        rows.append((texts + i, " ".join(copy)))
    monkeypatch.setattr(bagminhash, "AHEAD", reach)
    got, want = ({r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}, {k: c for k, c in near_classes(rows)})
    assert sum(got[i] == want[i] for i in want) >= (1 if reach == 256 else 0.95) * len(want)
    assert all(want[got[i]] == want[i] for i in want)


def test_fine_buckets_larger_than_a_block_are_covered_whole(spark, monkeypatch):
    """Pairs of one bucket meet once each, whatever blocks and shares it is cut into; texts of one label do not meet."""
    monkeypatch.setattr(bagminhash, "AHEAD", 4)
    monkeypatch.setattr(bagminhash, "SPREAD", 5, raising=False)
    rng, one = random.Random(3), [7] * (bagminhash.SHARP // 64)
    label = {i.to_bytes(16, "big"): 0 if i < 30 else i // 2 for i in range(60)}
    sharp = [(k, one, [k[-1] % 3 + 1 if b < 9 else 900 + b if b < 12 and k[-1] % 2 else 0 for b in range(bagminhash.FINE)]) for k in label]
    rng.shuffle(sharp)
    fine = [(k, label[k], b, band) for k, _, bands in sharp for b, band in enumerate(bands) if band]
    fine = [(k, x, b, band * 100 + b) for k, x, b, band in fine]  # of each place its own
    wanted = Counter(frozenset((a, b)) for a, b in itertools.combinations(label, 2) if label[a] != label[b] and (a[-1] % 3 == b[-1] % 3 or a[-1] % 2 and b[-1] % 2))
    rows = bagminhash._blocks(spark.createDataFrame(fine, "key binary, label long, at int, band long"), spark.createDataFrame(sharp, "key binary, bits array<long>, fine array<long>"))
    met = rows.repartition(3, "band", "chunk", "salt").sortWithinPartitions("band", "chunk", "salt", "probe").mapInArrow(bagminhash._across, bagminhash._ACROSS_SCHEMA)
    assert Counter(frozenset((bytes(r.a), bytes(r.b))) for r in met.collect()) == wanted


def test_partners_in_a_sparse_crowd_are_found_whatever_the_block(spark, monkeypatch):
    """Texts at 0.71 to each other, four with a partner at 0.82: with blocks of one text none is missed."""
    monkeypatch.setattr(bagminhash, "AHEAD", 1)
    rng = random.Random(32)
    base, rows = [f"b{i}" for i in range(300)], []
    for i in range(200):
        copy = list(base)
        for k in range(5):
            copy[rng.randrange(60) + 60 * k] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(4):
        copy = rows[i][1].split(" ")
        for k in range(6):
            copy[rng.randrange(40) + 50 * k] = f"d{rng.randrange(10**6)}"
        rows.append((200 + i, " ".join(copy)))
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: c for k, c in near_classes(rows)}


# --- 3 and 5 -------------------------------------------------------------------------------------------------------

def merged(ranges):
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return ",".join(f"{a}:{b}" for a, b in out)


def passages(rows, runs):
    found = defaultdict(set)
    for key, text in rows:
        m = list(WORD.finditer(text or ""))
        for a, b in runs(m, text or ""):
            found[" ".join(x.group() for x in m[a:b])].add((key, m[a].start(), m[b - 1].end()))
    all_, later = defaultdict(list), defaultdict(list)
    for places in found.values():
        if len(places) > 1:
            first = min(places)
            for key, a, b in places:
                all_[key].append((a, b))
                if (key, a, b) != first:
                    later[key].append((a, b))
    return {k: (merged(v), merged(later[k])) for k, v in all_.items()}


def windows(m, _):
    return [(i, i + 50) for i in range(len(m) - 49)]


def runs(m, text):
    """All runs of two sentences and 16 words or more (as far as twelve sentences beyond the shortest; longer ones are unions of these)."""
    begins = [i for i, x in enumerate(m) if not i or m[i - 1].group()[-1] in ".!?" or "\n" in text[m[i - 1].end() : x.start()]] + [len(m)]
    out = []
    for i in range(len(begins) - 1):
        j = i + 2
        while j < len(begins) and begins[j] - begins[i] < 16:
            j += 1
        out += [(begins[i], begins[k]) for k in range(j, min(j + 12, len(begins)))]
        if begins[i + 1] - begins[i] >= 30:
            out.append((begins[i], begins[i + 1]))
    return out


@pytest.mark.parametrize(("operator", "rule"), [(suffixes.repeated_passages, windows), (sentences.repeated_sentences, runs)])
def test_repeated_spans_equal_brute_force(spark, docs, empty, operator, rule):
    known = docs.filter("doc_id IS NOT NULL")
    rows = list({(r.doc_id, r.text) for r in known.collect()})
    assert {r.doc_id: (r.spans, r.removed) for r in operator(known).collect()} == passages(rows, rule)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    found = operator(table)
    want = passages(rows, rule)
    assert {r.doc_id: (r.spans, r.removed) for r in found.collect()} == want
    odd = table.withColumns({"_id": F.lit(1), "my col": F.lit("x"), "removed": F.lit("1:2")})
    cleaned = spans.without(odd, found)
    assert cleaned.columns == odd.columns
    cleaned = {r.doc_id: r.text for r in cleaned.collect()}
    for key, text in rows:
        cut = [tuple(map(int, x.split(":"))) for x in want.get(key, ("", ""))[1].split(",") if x]
        assert cleaned[key] == "".join(text[b:a] for b, a in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(text)], strict=True))
    assert operator(empty).count() == 0 and operator(docs).filter("doc_id IS NULL").count() <= 1


def test_texts_that_share_a_key_keep_their_passages(spark):
    rng = random.Random(15)
    say = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    a, shared = say(90), say(70)
    b, c, d = f"{say(30)} {shared} {say(20)}", f"{say(10)} {shared}", f"{shared} {say(5)}"
    table = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (None, d), (None, say(80)), (None, None)], "doc_id long, text string")
    out = {(r.doc_id, r.removed_chars > 0, r.repeated_chars) for r in suffixes.repeated_passages(table).collect()}
    assert out == {(1, False, len(a)), (2, True, len(a)), (2, True, len(shared)), (3, True, len(shared)), (None, False, len(shared))}


def test_passages_without_whole_sentences_are_found(spark, tmp_path):
    rng = random.Random(5)
    say = lambda n, every=0: " ".join(f"w{rng.randrange(9000)}" + ("." if every and i % every == every - 1 else "") for i in range(n))
    shared = [say(40), say(50), say(25) + ". " + say(20), say(28) + ". " + say(29) + " " + say(10), say(400)]
    rows = [(2 * i + k, f"{say(37 + i + 5 * k, 8)} {x} {say(41)}") for i, x in enumerate(shared) for k in range(2)] + [(90, say(3000)), (91, say(20)), (92, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in registry.op5_sentences(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(10))
    for i, x in enumerate(shared):
        for k in range(2):
            text, spans = rows[2 * i + k][1], [tuple(map(int, s.split(":"))) for s in out[2 * i + k].spans.split(",")]
            at = text.index(x)
            assert len(spans) == 1 and at <= spans[0][0] and spans[0][1] <= at + len(x)
            assert len(words_of(text[slice(*spans[0])])) >= max(30, len(words_of(x)) - 20)


# --- 4 -------------------------------------------------------------------------------------------------------------

def test_main_text_of_awkward_pages():
    w = html.Weights()
    assert html.main_text(None, w) == html.main_text("", w) == html.main_text("<div></div>", w) == ""
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site for you</div><div id=main-text><h1>A long title &amp; more</h1><p>First   paragraph with <b>bold</b>ness &lt;ok&gt;<br>and a break<p>Second one &#233; here
    <script>var t = "</p>";</script><form><input value=x><label>Your name here please now</label></form><ul><li>Point number one here<li>Point number two here</ul></div>
    <section class="comments"><p>I liked this page a lot, thanks to all of you</p></section><aside>Other things to read today</aside><footer>All rights reserved by us</footer></body>"""
    assert html.main_text(page, w) == "A long title & more\n\nFirst paragraph with boldness <ok> and a break\n\nSecond one é here\n\nPoint number one here\n\nPoint number two here"
    assert html.main_text("<article><p>end</article><!-- never closed", w) == "end"
    assert len(html.main_text("<p>" + "word " * 50_000, w)) == 5 * 50_000 - 1


def test_nothing_else_of_an_article_is_dropped():
    w = html.Weights()
    say = lambda n, x: " ".join(f"{x}{i}" for i in range(n))
    page = f"""<body><div class="site-header top"><p>{say(6, "h")}</p></div><article><div class="post-header"><h1>A title of four words</h1></div><p>{say(30, "a")}</p>
    <div class="legal-analysis"><p>{say(20, "b")}</p></div><div class="search-history related-work"><p>{say(20, "c")}</p></div><p>where <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds</p>
    <p hidden>{say(5, "d")}</p><p>see <svg><text>axis</text></svg> and <object data=x>fallback words</object></p><div class="ad-slot">{say(9, "x")}</div><div id="post-comments">{say(9, "y")}</div></article></body>"""
    want = ["A title of four words", say(30, "a"), say(20, "b"), say(20, "c"), "where x = 2 holds", say(5, "d"), "see axis and fallback words"]
    assert html.main_text(page, w) == "\n\n".join(want)
    assert html.main_text(f"<article><p>{say(9, 'a')}</p><p title='a > b' data-x=\"it's\">don't</p><p don't>{say(9, 'b')}</p></article>", w) == f"{say(9, 'a')}\n\ndon't\n\n{say(9, 'b')}"


@pytest.mark.parametrize("page", ["<a " * 100_000, "<a \"'" * 100_000, "<a b='" * 100_000, "<!" * 100_000, "<div>" * 100_000 + "deep", "<div class=x>" * 100_000 + "deep", "<p><li><ul>" * 50_000 + "deep", "</div>" * 100_000, "<b><p>" * 50_000, "<script " * 50_000, "<" * 100_000])
def test_time_of_broken_pages_is_in_proportion(page):
    import time

    began = time.perf_counter()
    html.main_text(page, html.Weights())
    html.observe(page)
    assert time.perf_counter() - began < 10


def test_pages_equal_their_articles(spark):
    import html as escapes

    table = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r for r in html.extract(table).collect()}
    for page in table.collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        blocks = (" ".join(escapes.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want = "\n\n".join(b for b in blocks if b)
        assert (out[page.page_id].text, out[page.page_id].n_chars, out[page.page_id].url) == (want, len(want), page.url)
    odd = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "v", "<p>a b c</p>")], "page_id long, url string, html string")
    assert [(r.page_id, r.text) for r in html.extract(odd).orderBy("page_id").collect()] == [(None, ""), (1, ""), (2, "a b c")]
    assert html.extract(odd.limit(0)).count() == 0


# --- 6 -------------------------------------------------------------------------------------------------------------

ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(registry.RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40) | st.text(alphabet="ab é\n\x1c\x85 'sß中🙂19<|endoftext|>", max_size=60))
def test_encoding_equals_the_library(text):
    assert [int(x) for x in bpe.encode_text(text, bpe.load_ranks(registry.RANKS), public_tokenizers.PATTERN).split()] == ENCODING.encode_ordinary(text)


def test_long_piece():
    piece = "".join(random.Random(6).choice("abcdefgh") for _ in range(60_000))
    ids = bpe.merge_piece(piece.encode(), bpe.load_ranks(registry.RANKS))
    assert ids == ENCODING.encode_ordinary(piece)


def test_encode_and_decode(spark, docs, empty):
    out = bpe.decode(bpe.encode(docs, registry.RANKS, public_tokenizers.PATTERN), registry.RANKS)
    assert out.columns == ["doc_id", "source", "n_words", "_key", "n_tokens", "token_ids", "decoded"]
    got = Counter((r.doc_id, r.n_tokens, r.token_ids, bytes(r.decoded)) for r in out.collect())
    want = Counter((r.doc_id, len(ids := ENCODING.encode_ordinary(r.text or "")), " ".join(map(str, ids)), (r.text or "").encode()) for r in docs.collect())
    assert got == want
    assert Counter((r.doc_id, r.n_tokens, r.token_ids, bytes(r.decoded)) for r in bpe.round_trip(docs, registry.RANKS, public_tokenizers.PATTERN).collect()) == want
    assert bpe.encode(empty, registry.RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_are_bounded():
    """Pre-tokens met once don't stay, those that come again do, and the ids are the library's."""
    pieces = bpe._Pieces(bpe.load_ranks(registry.RANKS), 100)
    for i in range(3_000):
        for piece in (f" zq{i}x", f" hot{i % 50}"):
            assert [int(x) for x in pieces[piece].split()] == ENCODING.encode_ordinary(piece)
    assert len(pieces) == 50 and not pieces.older and len(pieces.new) + len(pieces.waiting) <= 200
    for piece in [f" q{i % 700}z" for i in range(0, 2_100)] + [f" r{i // 2}z" for i in range(4_000)]:
        pieces[piece]
        assert max(map(len, (pieces, pieces.older, pieces.new, pieces.waiting))) <= 100


def test_encoding_holds_few_texts(spark):
    """A worker holds some texts of its partition at a time, not an Arrow batch of them (60 MB here)."""
    docs = spark.range(0, 3_000, 1, 1).selectExpr("id AS doc_id", "repeat(' the', 5000 + int(id % 7)) AS text")
    first, most, stop = {}, {}, threading.Event()

    def watch():
        while not stop.is_set():
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                        rss = p.memory_info().rss / 1e6
                        first.setdefault(p.pid, rss)
                        most[p.pid] = max(most.get(p.pid, 0), rss)
                except psutil.Error:
                    pass
            stop.wait(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = bpe.round_trip(docs, registry.RANKS, public_tokenizers.PATTERN).selectExpr("sum(n_tokens)", "sum(length(decoded))").first()
    finally:
        stop.set()
        watcher.join()
    assert tuple(got) == (sum(5000 + i % 7 for i in range(3_000)), 4 * sum(5000 + i % 7 for i in range(3_000)))
    grown = max(most[p] - first[p] for p in most)
    print("grown", grown)
    assert grown < 75


# --- 7 -------------------------------------------------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
            good = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if good[name]:
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def test_fixed_patterns_equal_brute_force(spark, docs, empty):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aB1234567890.@+-_ ()5é😀\n%40") for _ in range(rng.randrange(1, 120))) for _ in range(800)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4012888888881881", "1" * 30_000, "9." * 9_000, "a" * 30_000 + "@b", "+1 " + "(" * 9_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.base for r in pii.find(table).collect()} == {i: base_spans(t) for i, t in enumerate(texts)}
    got = Counter((r.doc_id, r.base) for r in pii.find(docs).collect())
    assert got == Counter((r.doc_id, base_spans(r.text or "")) for r in docs.collect())
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0


def test_contexts_find_what_patterns_miss(spark):
    rows = [(i, f"please note my mobile number +1 ({200 + i}) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(100, "so my mobile number 55570000x. bye"), (200, "the room count is 55570000 now"), (300, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(table).collect()}
    assert out[100].spans == "phone:20:29" and out[100].base == "" and out[200].spans == "" and out[3].spans == out[3].base != ""
    text = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert text[100] == "so my mobile number [PHONE]. bye" and text[3] == "please note my mobile number [PHONE] thanks" and text[300] is None
    assert text[200] == rows[13][1]


def test_candidates_with_parted_digits_and_after_other_digits(spark):
    rows = [(i, f"please note my mobile number +1 ({200 + i}) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(20 + i, f"the line 7 +1 ({300 + i}) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(100, "so my mobile number 55-57-00-00"), (101, "so my mobile number 01/23/45/67/89, bye"), (102, "so my mobile number 5-5-7 0"), (103, "so on line 7 55570000x. bye"), (104, "at 9 on line 7 55-57-00-00 or 8")]
    rows += [(105, "+1 (200) 555-7777 and my mobile number 5557-0000")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.find(table).collect()}
    assert [out[i] for i in range(100, 106)] == ["phone:20:31", "phone:20:34", "", "phone:13:22", "phone:15:26", "phone:0:17,phone:39:48"]
    text = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert text[100] == "so my mobile number [PHONE]" and text[104] == "at 9 on line 7 [PHONE] or 8"
    scan = spark.createDataFrame([("+1 (200) 555-7777 +1 (200) 555-8888 and (55570000",)], "text string").select(pii.base_spans(F.col("text")).alias("b"), pii.candidates(F.col("text")).alias("o")).first()
    assert [x.context for x in scan.b if x.start == 18] == ["(200) 555-7777"] and [x.context for x in scan.o if x.start == 41] == ["and ("]


def test_secrets_are_found_by_what_stands_before_them(spark):
    rng = random.Random(17)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n)) + "a1"
    rows = [(i, f'of the w{i} token = "{hexa(38)}" and so w{i + 1} on') for i in range(8)]
    rows += [(100, 'some token = "tk-2024-99-7x", then'), (101, f"the commit {hexa(38)} is old"), (102, "so 2024 was 9999 and 8888")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"more": F.lit(1), "_id": F.lit("x"), "_t": F.lit(2), "my col": F.lit("y"), "base": F.lit(0)})
    out = {r.doc_id: r for r in pii.find(table).collect()}
    assert out[100].spans == "secret:14:27" and out[101].spans == out[102].spans == "" and out[100].base == "" and out[100].n_spans == 1
    assert all(len(out[i].spans.split(",")) == 1 and out[i].spans.startswith("secret:") for i in range(8))
    redacted = pii.redact(table)
    assert redacted.columns == table.columns and {r.doc_id: r.text for r in redacted.collect()}[100] == 'some token = "[SECRET]", then'


def test_runs_of_digit_groups_are_found(spark):
    rows = [(i, f"please note my mobile number +1 ({200 + i}) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(100, "so my mobile number 01 23 45 67 89, bye"), (101, "the years 2019 2020 2021 passed")]
    out = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == "phone:20:34" and out[101] == ""


def scored(rows, rounds=3, support=5, trust=0.8):
    """Brute force of the scoring rounds over (pattern, instance, kind or None)."""
    kinds, links = {}, defaultdict(set)
    for pattern, instance, kind in rows:
        links[pattern].add(instance)
        if kind is not None:
            kinds.setdefault((pattern, instance), kind)
            kinds[pattern, instance] = min(kinds[pattern, instance], kind)
    seeds = {(instance, k): 1.0 for (_, instance), k in kinds.items()}
    links = {p: xs for p, xs in links.items() if len(xs) >= (4 * support if p.startswith("1:") else support)}
    belief = dict(seeds)
    for _ in range(rounds):
        said = defaultdict(float)
        for p, xs in links.items():
            for (instance, k), b in belief.items():
                if instance in xs:
                    said[p, k] += b / (len(xs) + 1)
        doubt = defaultdict(float)
        for p, xs in links.items():
            for (q, k), t in said.items():
                if q == p:
                    for x in xs:
                        doubt[x, k] += math.log1p(-min(t, 0.999999))
        belief = dict(seeds)
        for x, d in doubt.items():
            belief[x] = max(belief.get(x, 0.0), 1 - math.exp(d))
    best = {}
    for (p, k), t in said.items():
        best[p] = max(best.get(p, (-1, 0)), (t, -k))
    return {p: -k for p, (t, k) in best.items() if t >= trust}


def test_scoring_rounds_equal_brute_force(spark):
    rng = random.Random(19)
    table = []
    for i in range(250):
        word, kind = rng.choice([("mail", 0), ("call", 3), ("from", 1), ("misc", 9)])
        value = {0: f"u{rng.randrange(60)}@x.org", 3: f"+1 555 {rng.randrange(60) + 1000} 99", 1: f"10.0.0.{rng.randrange(60)}", 9: f"{rng.randrange(1000, 1060)}"}[kind if rng.random() < 0.9 else 9]
        table.append((i, f"{rng.choice(['do', 'we'])} {word} {value} {rng.choice(['ok', 'no'])}"))
    scan = pii.scanned(spark.createDataFrame(table, "doc_id long, text string"))
    rows = []
    for r in scan.collect():
        for x in [*r.base, *r.other]:
            if x.context:
                one = x.context.split(" ")[-1]
                for p in ([f"2:{x.context}"] if " " in x.context else []) + ([f"b:{one} _ {x.after}"] if x.after else []) + [f"1:{one}"]:
                    rows.append((p, x.instance, x.kind if x.kind < 4 else None))
    got = {r.pattern: r.kind for r in pii.trusted_patterns(scan, trust=0.6).collect()}
    assert got == scored(rows, trust=0.6) and got


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_folds_of_long_arrays(spark, n):
    from palimpsest.llm.common import fold

    step = lambda s, x: (s + x, x % 3 == 0, s)
    got = spark.range(1).select(F.expr(f"CAST(filter(sequence(0, {n}), x -> x < {n}) AS array<long>)").alias("a")).select(fold(F.col("a"), F.lit(0).cast("long"), F.array().cast("array<long>"), step).alias("f")).first().f
    assert got.s == sum(range(n)) and got.out == [sum(range(i)) for i in range(0, n, 3)]


# --- 8 -------------------------------------------------------------------------------------------------------------

def test_targets():
    assert mixing.source_targets({"a": 100, "b": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    out = mixing.source_targets({"a": 1, "b": 1000, "c": 10, "d": 0})
    assert out["a"] == 3 and out["d"] == 0 and abs(sum(out.values()) - 1011) < 1e-6 and out["c"] <= 30


def test_targets_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_SOURCES", 5)
    rng = random.Random(18)
    for n in (0, 1, 3, 40):
        sizes = {f"s{rng.randrange(10**6)}é"[: rng.randrange(2, 9)]: rng.choice([0, 1, 7, 100, 10_000]) for _ in range(n)} | ({None: 50} if n else {})
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), (5, 2, 1), 3).collect()}
        want = mixing.source_targets(sizes)
        assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_many_sources_are_not_broadcast(spark, docs, monkeypatch):
    want = Counter(mixing.mix(docs).collect()), Counter(r.doc_id for r in mixing.mixed(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert (Counter(mixing.mix(docs).collect()), Counter(r.doc_id for r in mixing.mixed(docs).collect())) == want


def test_mix_comes_near_its_targets(spark, docs, empty):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * (1 + rng.randrange(3)) for _ in range(rng.randrange(40))), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(table).collect()
    assert sorted((r.doc_id, r["size"]) for r in out) == [(i, len(words_of(t))) for i, t, _ in rows]
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    assert Counter(mixing.mix(table.repartition(7)).collect()) == Counter(out)
    copies = Counter(r.doc_id for r in mixing.mixed(table).collect())
    assert all(copies[r.doc_id] * r["size"] == r.taken for r in out if r["size"])
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).count() == docs.count() and mixing.mixed(docs).columns == docs.columns


# --- 9 -------------------------------------------------------------------------------------------------------------

def test_sketches_merge():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 2**63, 3000, np.uint64), rng.integers(0, 2**63, 2000, np.uint64)
    a = np.concatenate([a, b[:1000]])
    whole = fingerprint.bottom_k(np.concatenate([a, b]))
    assert (fingerprint.merge(fingerprint.bottom_k(a), fingerprint.bottom_k(b)) == whole).all()
    x, y = fingerprint.bottom_k(a * np.uint64(2)), fingerprint.bottom_k(b * np.uint64(2))
    assert abs(fingerprint.resemblance(x, y) - 0.2) < 0.1 and abs(fingerprint.containment(y, x) - 0.5) < 0.2 and abs(fingerprint.distinct(x) / 4000 - 1) < 0.2
    assert (fingerprint.unpack(fingerprint.pack(x)) == x).all()


def test_fingerprints_with_successors(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 2)
    known = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in known.collect())
    likeness = lambda x, y: sum((Counter(set(x)) & Counter(set(y))).values()) / len(set(x) | set(y)) if set(x) | set(y) else 1.0
    for parts in (1, 4, 50):
        out = {r.doc_id: r for r in fingerprint.with_next(known, parts=parts).collect()}
        assert set(out) == {k for k, _ in rows}
        for i, (key, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            n = len(text) // 4
            new = text[: len(text) - n] + after[:n]
            r = out[key]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
            assert abs(r.near_edited - likeness(shingles_of(text), shingles_of(new))) < 0.13 and abs(r.near_next - likeness(shingles_of(text), shingles_of(after))) < 0.13
    # Rows without a key: before all others, in the order of their texts' hashes, over ranges of their own.
    loose = known.select("doc_id", "text").unionByName(spark.createDataFrame([(None, f"loose text number {i} of some") for i in range(40)], "doc_id long, text string"))
    hashed = sorted((r.doc_id is not None, r.doc_id or 0, r.tie, r.text) for r in loose.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect())
    after = {(k if has else None, t): hashed[(i + 1) % len(hashed)][3] for i, (has, k, _, t) in enumerate(hashed)}
    want = Counter((k, hashlib.sha256((t[: len(t) - len(t) // 4] + x[: len(t) // 4]).encode()).hexdigest()) for (k, t), x in after.items())
    for parts in (1, 6, 30):
        assert Counter((r.doc_id, r.edited_sha256) for r in fingerprint.with_next(loose, parts=parts).collect()) == want
    every = fingerprint.with_next(docs, parts=3).collect()
    assert len(every) == docs.count() and len({r.fingerprint for r in every if r.doc_id in (5, 6)}) == 1
    assert fingerprint.with_next(empty).count() == 0 and fingerprint.fingerprints(docs).count() == docs.count()


# --- 10 ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_equals_brute_force(spark, docs, empty, order, monkeypatch):
    monkeypatch.setattr(backoff, "CHUNK_WORDS", 5_000)
    rows = [(r.doc_id, words_of(r.text)) for r in docs.collect()]
    counts = [Counter() for _ in range(order + 1)]
    for _, w in rows:
        for n in range(1, order + 1):
            counts[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in rows)
    want = Counter()
    for key, w in rows:
        score = 0.0
        for i in range(len(w)):
            n = top = min(order, i + 1)
            while n > 1 and counts[n][tuple(w[i - n + 1 : i + 1])] < 2:
                n -= 1
            p = counts[n][tuple(w[i - n + 1 : i + 1])] / (counts[n - 1][tuple(w[i - n + 1 : i])] if n > 1 else total)
            score += math.log(p * 0.4 ** (top - n))
        want[key, len(w), round(score, 4) if w else None] += 1
    got = Counter((r.doc_id, r.n_words, None if r.log_score is None else round(r.log_score, 4)) for r in backoff.score(docs, order=order).collect())
    assert got == want
    assert backoff.score(empty).count() == 0
    if order > 1:  # as tables of rows
        got = Counter((r.doc_id, r.n_words, None if r.log_score is None else round(r.log_score, 4)) for r in backoff.score_rows(docs, order=order).collect())
        assert got == want
        facts = lambda df: Counter((r.doc_id, r.n_words, r.n_top, r.n_unigram) for r in df.collect())
        assert facts(backoff.score_rows(docs, order=order)) == facts(backoff.score(docs, order=order))
        assert backoff.score_rows(empty).count() == 0


def test_the_backoff_query_scores_trigrams(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: Counter((r.doc_id, r.n_words, r.n_top, r.n_unigram) for r in df.collect())
    got = rows(registry.op10_backoff(spark, str(tmp_path)))
    assert got == rows(backoff.score(docs, order=3)) != rows(backoff.score(docs, order=2))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.integers(1, 1 << 20))
def test_blocks_of_hashes(numbers, buckets):
    hashes = np.unique(np.array(numbers, np.uint64))
    assert backoff._bucket(hashes, buckets).tolist() == [int(h) * buckets >> 64 for h in hashes]
    assert backoff._unpacked(backoff._packed(hashes)).tolist() == hashes.tolist()
    for b in set(backoff._bucket(hashes, buckets).tolist()):
        block = hashes[backoff._bucket(hashes, buckets) == b]
        assert backoff._from_low(backoff._low(block, buckets)).tolist() == [(int(h) * buckets % 2**64) >> 24 for h in block]


# --- the pipeline --------------------------------------------------------------------------------------------------

def test_pipeline_equals_brute_force(spark):
    """Each stage is held against plain Python over what the stage before it kept."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    docs = table
    stages = dict(corpus_pipeline.STAGES)
    good = {r.doc_id for r in quality.score(table).collect() if r.kept}
    docs = stages["quality rules"](spark, docs, SF).cache()
    assert docs.columns == table.columns and {r.doc_id for r in docs.collect()} == good
    one = {c for _, c in near_classes([(r.doc_id, r.text) for r in docs.collect()])}
    docs = stages["near-dedup"](spark, docs, SF).cache()
    assert {r.doc_id for r in docs.collect()} == one and docs.count() == len(one)
    before = {r.doc_id: r.text for r in docs.collect()}
    odd = docs.withColumns({"my col": F.lit("x"), "more": F.lit(1), "_id": F.lit(2)})
    assert stages["personal data"](spark, odd, SF).columns == odd.columns
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for stage in stages.values())
    docs = stages["personal data"](spark, docs, SF).cache()
    for r in docs.collect():
        assert r.n_chars == len(r.text) and not base_spans(r.text).startswith("email")
        if not base_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]
    takes = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix(docs).collect()}
    docs = stages["mixing"](spark, docs, SF).cache()
    assert docs.columns == table.columns and Counter(r.doc_id for r in docs.collect()) == Counter({k: n for k, n in takes.items() if n})
    out = stages["encoding"](spark, docs, SF).collect()
    want = Counter((r.doc_id, " ".join(map(str, ENCODING.encode_ordinary(r.text)))) for r in docs.collect())
    assert Counter((r.doc_id, r.token_ids) for r in out) == want and all(r.round_trip for r in out)
    assert Counter((r.doc_id, r.token_ids) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_pii_counts_are_of_their_kind(spark):
    """Each count is of its own kind, wherever its spans stand among those of other kinds."""
    texts = ["a@b.c x@y.zz", "1.2.3.4", "+1 (200) 555-7777 at 1.2.3.4 or a@b.c", "4111 1111 1111 1111, 10.0.0.1 10.0.0.2", "none", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find(table).collect()}
    assert out == {0: (2, 0, 0, 0), 1: (0, 1, 0, 0), 2: (1, 1, 0, 1), 3: (0, 2, 1, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0)}
