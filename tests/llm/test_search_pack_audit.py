"""Ranked search, packing and the filter audit against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import audit, lexical, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use themselves stand beside the given columns.
SCHEMA = "doc_id long, text string, source string, part string, mask string, qid string, range string, length string, ids string, _row string"


def say(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)] + ["The", "É", "ẞ", "don't", "x#y", "ABC", "1,000"]
    texts = [None, "", " \n", "one two", "x" * 50_000, say(rng, words, 9000)] + [say(rng, words, rng.choice([3, 40, 60, 200])) for _ in range(160)]
    rows = [(i, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[10], "s1") for i in range(40)] + [(500, texts[11], "s2"), rows[12], rows[12], (None, texts[13], "s0"), (None, texts[13], None), (None, say(rng, words, 70), "s3"), (None, None, "s3")]
    rng.shuffle(rows)
    return [(*r, "p", "m", "q", "r", "l", "i", "_") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


# --- ranked search -------------------------------------------------------------------------------------------------

def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def best(rows, items, k=10):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    merged = {}
    for item, text in items:
        merged.setdefault(item, set()).update(terms(text))
    out = {}
    for item, asked in merged.items():
        scores = []
        for i, c in docs:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out[item] = [(None if none else i, -s) for s, none, i in sorted(scores)[:k]]
    return {i: x for i, x in out.items() if x}


def test_terms():
    for text in (None, "", "Don't, ÉCOLE_x2 \x7f\x00ẞ😀-a", "a b"):
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


def test_search_equals_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE_DOCS", 20)  # many ranges and blocks, of few documents and items
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    items = [(i, r[1][:400] if r[1] else None) for i, r in enumerate(rows[:12])] + [(3, "w1 W2 w3"), (None, "the é"), (50, "w5"), (51, ""), (52, "unseen"), (53, rows[20][1])]
    asked = spark.createDataFrame([(*i, 0, 0, 0) for i in items], "item_id long, text string, qid int, term int, rank int")
    got = {}
    for r in lexical.rank(docs, asked).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["item_id"]])
    assert got == best(rows, items)


def test_search_of_nothing(spark, docs):
    asked = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), asked).count() == 0
    assert lexical.rank(docs, asked.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 200), st.integers(1, 9)), min_size=1, max_size=120, unique_by=lambda x: x[:2]), st.integers(1, 12), st.integers(1, 30))
def test_tree(postings, k, floor):
    term, doc, gain = (np.array(x) for x in zip(*postings, strict=True))
    weight = np.array([3, 1, 0, 2, 5, 1])
    scores = Counter()
    for t, d, g in postings:
        scores[d] += int(weight[t] * g)
    ids = [None if d % 50 == 7 else d // 2 for d in range(201)]
    want = sorted(((-s, ids[d] is None, ids[d] or 0) for d, s in scores.items() if s >= floor))[:k]
    got = lexical.Tree(term, doc, gain.astype(np.int64), 201).best(weight, ids, floor, k)
    assert sorted((-s, i is None, i or 0) for s, i in got) == want


# --- packing -------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in packing._ids(PATH).of(pa.array(texts, pa.string()))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbé́'sS.,!1²ª \x1c\x85 \n\x0b\x00 <|endoftext|>HßİḴǰꙮ", max_size=30), max_size=4))
def test_ids_by_words_equal_the_library(tokenizer, texts):
    assert ids_of(texts) == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_ids_of_many_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_CHUNKS", 100)
    monkeypatch.setattr(packing, "_TOGETHER", 7)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcDEé'") for _ in range(rng.randint(1, 7))) + rng.choice(["", ".", "!?", "9", "ö"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert ids_of(texts) == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert ids_of(texts[7:]) == ids_of(texts)[7:] and ids_of([]) == []
    assert ids_of(["Aİ b İİ"]) == [tokenizer.encode("Aİ b İİ", add_special_tokens=False).ids]


def test_runs_of_texts(monkeypatch):
    monkeypatch.setattr(packing, "_BYTES", 10)
    assert list(packing._runs(pa.array(["aaaa", "bbbb", "c", "d" * 30, "", "e"]))) == [(0, 3), (3, 4), (4, 6)]
    assert list(packing._runs(pa.array([], pa.string()))) == []


def places(lengths, limits, rule):
    """The rule word by word: every open sequence is looked at."""
    bins, out = [], [None] * len(lengths)
    full = (limits.tokens, limits.documents, limits.attention)
    weight = [w / f**2 for w, f in zip(limits.weights, full, strict=True)]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[i], 1, lengths[i] ** 2)
        fit = [(b, left) for b, (left, _) in enumerate(bins) if all(r >= d for r, d in zip(left, need, strict=True))]
        if not fit:
            bins.append([full, 0])
            fit = [(len(bins) - 1, full)]
        value = (lambda left: sum(w * (r - d) ** 2.0 for w, r, d in zip(weight, left, need, strict=True))) if rule == "norm" else (lambda left: -sum(w * r * float(d) for w, r, d in zip(weight, left, need, strict=True)))
        b = min(fit, key=lambda x: value(x[1]))[0]
        out[i] = (b, bins[b][1])
        bins[b] = [tuple(r - d for r, d in zip(bins[b][0], need, strict=True)), bins[b][1] + lengths[i]]
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from(["norm", "dot"]), st.integers(1, 9), st.integers(2000, 12_000))
def test_place_equals_brute_force(lengths, rule, documents, attention):
    limits = packing.Limits(100, documents, max(attention, 10_000), (1.0, 0.3, 0.2))
    of, offset = packing.place(np.array(lengths, np.int64), limits, rule)
    assert list(zip(of.tolist(), offset.tolist(), strict=True)) == places(lengths, limits, rule)


def test_packing_whole(spark, docs, rows, tokenizer):
    cut = packing.pieces(docs, PATH).withColumn("crc", F.crc32("ids"))
    got = packing.pack(cut, shard_pieces=40).collect()
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r[0], k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    one = packing.pack(cut).select("sequence_id").distinct().count()
    assert one <= -(-sum(r["length"] for r in got) // 4096) + 1  # many short texts fill what long ones leave
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(docs, PATH).collect()}
    assert sorted(np.concatenate([np.frombuffer(x, "<u4") for x in whole.values()]).tolist()) == sorted(i for r in rows for i in [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0


def test_packing_keeps_every_capacity(spark):
    rng = random.Random(8)
    table = spark.createDataFrame([(i, rng.randint(1, 90), 0, 0) for i in range(300)], "doc_id long, length long, sequence_id int, offset int")
    limits = packing.Limits(100, 3, 9000)
    by = {}
    for r in packing.pack(table, limits, "dot").collect():
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert sum(map(len, by.values())) == 300
    assert all(sum(x) <= 100 and len(x) <= 3 and sum(y * y for y in x) <= 9000 for x in by.values())


# --- filter audit --------------------------------------------------------------------------------------------------

def audited(rows, labels):
    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any((x is not None and (i is None or x < i)) and t == text for x, t, _ in rows)
        return {f for f, x in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller), strict=True) if x}

    good = {i for i, q, _ in labels if q == 1}
    bad = {i for i, _, t in labels if t == 1}
    judged = [(part, fails(i, text), i in good and i is not None, i in bad and i is not None) for i, text, part in rows]
    out = {}
    for part in {r[2] for r in rows}:
        own = [x for x in judged if x[0] == part]
        share = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                here = [x for x in own if f in x[1] and not x[1] & set(order[:step])]
                share[f] += len(here)
                out[part, "".join(order), step + 1] = [len([x for x in own if not x[1] & set(order[: step + 1])]), len(here), len([x for x in own if f in x[1]]) - len(here), len([x for x in own if x[1] == {f}]), sum(x[2] for x in here), sum(x[3] for x in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


@pytest.mark.parametrize("held", [audit.HELD_BYTES, 100])
def test_audit_equals_brute_force(spark, docs, rows, monkeypatch, held):
    monkeypatch.setattr(audit, "HELD_BYTES", held)
    marks = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 1040, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)).withColumn("part", F.lit("x"))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in audit.interactions(docs, labels).collect()}
    assert got == audited([(r[0], r[1] or "", r[2] or "") for r in rows], marks)


def test_audit_with_equal_fingerprints(spark, docs, rows, monkeypatch):
    """Different texts of one fingerprint stay apart in its chain."""
    chains = audit.Chains()
    copies = [c for r in rows if (c := chains.add(7, ((r[1] or "").encode(), r[0], 0, {"p": 1})))]
    left = [r for _, r in chains.drain()]
    assert len(left) == len({r[1] or "" for r in rows})
    assert sum(n for r in [*copies, *left] for n in r[3].values()) == len(rows)


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(docs.limit(0), labels).count() == 0
    assert {tuple(r)[7:9] for r in audit.interactions(docs, labels).collect()} == {(0, 0)}
