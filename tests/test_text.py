"""Text, distance and scalar functions on small cases."""

import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import distance, scalars, text
from palimpsest.operators import classify


def one(spark, **columns):
    """Values of column expressions over a one-row table."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_mark_table_follows_decomposition():
    composed, bases = text.mark_table()
    assert len(composed) == len(bases) > 500
    assert dict(zip(composed, bases, strict=True))["ΐ"] == "ι"


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="aÉéñΆΐςΣx .,-_9", max_size=30))
def test_canonical_equals_decomposition(spark, s):
    got = one(spark, c=text.canonical(F.lit(s))).c
    plain = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn").replace("ς", "σ")
    assert got == " ".join("".join(c if c.isalnum() or c == "_" else " " for c in plain).split())


def test_normalisers_differ_in_sigma(spark):
    row = one(spark, a=text.canonical(F.lit("Όπως!")), b=text.plain(F.lit("Όπως")), c=text.canonical(F.lit(None).cast("string")))
    assert (row.a, row.b, row.c) == ("οπωσ", "οπως", "")


def test_words_and_marks(spark):
    row = one(
        spark,
        fill=text.content_tokens(F.lit("Εμ, ναι εε ναι")), skel=text.phonetic_skeleton(F.lit("είναι")), same=text.phonetic_skeleton(F.lit("ήνε")),
        reason=text.strip_reasoning(F.lit("text\n\nWait, let me reconsider this")), overlap=text.has_overlap_marker(F.lit("see C.")), no=text.has_overlap_marker(F.lit("cat")),
        latin=text.greek_to_latin(F.lit("Θάλασσα")), homo=text.fix_homoglyphs(F.lit("OΔΟΣ abc")), forms=text.inflections(F.lit("παπαδοπουλος")), upper=text.upper_without_marks(F.lit("άλφα")),
    )
    assert row.fill == ["ναι", "ναι"] and row.skel == row.same
    assert row.reason == "text" and row.overlap and not row.no
    assert row.latin == "thalassa" and row.homo == "ΟΔΟΣ abc" and row.upper == "ΑΛΦΑ"
    assert row.forms == ["παπαδοπουλος", "παπαδοπουλου", "παπαδοπουλο"]


def test_repeated_ngram(spark):
    words = lambda s: F.split(F.lit(s), " ")
    row = one(spark, a=text.repeated_ngram(words("a b " * 3 + "c"), 2, 3), b=text.repeated_ngram(words("a b a b c"), 2, 3), c=text.repeated_ngram(words("a"), 2, 3))
    assert (row.a, row.b, row.c) == (True, False, False)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _step(row, i, x, b)
    return row[-1]


def _step(before, i, x, b):
    after = [i]
    for j, y in enumerate(b, 1):
        after.append(min(before[j] + 1, after[j - 1] + 1, before[j - 1] + (x != y)))
    return after


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_token_distance(spark, a, b):
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, d=distance.token_distance(arr(a), arr(b))).d == edit_distance(a, b)


def test_rates_of_empty_texts(spark):
    row = one(spark, a=distance.cer(F.lit(""), F.lit("")), b=distance.wer(F.lit("x"), F.lit("")), c=distance.wer(F.lit("a b"), F.lit("a b c d")))
    assert (row.a, row.b, row.c) == (0.0, 1.0, 0.5)


def test_near_and_swapped(spark):
    near = lambda a, b: distance.transposed_or_near(F.lit(a), F.lit(b))
    row = one(spark, a=near("abcd", "abdc"), b=near("abcd", "abcde"), c=near("abcd", "badc"), d=near("same", "same"))
    assert (row.a, row.b, row.c, row.d) == (True, True, False, True)


def test_edit_scores(spark):
    row = one(spark, s=distance.edit_scores(F.lit("the cat sat"), F.lit("the dog sat down"), F.lit("the dog sat"))).s
    assert (row.normalized_exact, row.edit_application) == (False, 1.0)
    assert abs(row.overcorrection - 1 / 3) < 1e-9 and abs(row.wer - 1 / 3) < 1e-9


def test_scalars(spark):
    row = one(
        spark, slug=scalars.slug_date(F.lit("oct30_2_2025")), bad=scalars.slug_date(F.lit("meeting")), base=scalars.without_session(F.lit("oct30_2_2025")),
        grid=scalars.ceil_grid(F.lit(2.34)), fnv=scalars.fnv1a(F.lit(" A ")), bucket=scalars.md5_bucket(F.lit("abc"), 7),
        low=scalars.wilson(F.lit(0), F.lit(10)).low, none=scalars.wilson(F.lit(3), F.lit(2)), arr=scalars.json_array(F.lit("so: ```json\n[{\"a\": 1}]\n```"), "array<struct<a:int>>"),
    )
    import hashlib

    assert row.slug == "2025-10-30 00:00:00" and row.bad is None and row.base == "oct30_2025" and row.grid == 2.34
    assert row.fnv == ((0x811C9DC5 ^ ord("a")) * 0x01000193) % 2**32
    assert row.bucket == int(hashlib.md5(b"abc").hexdigest(), 16) % 7
    assert abs(row.low) < 1e-9 and row.none is None and row.arr[0].a == 1


def test_error_categories(spark):
    cases = [
        ("ίδιο", "ίδιο", "no_change"), ("καλος", "καλός", "accent_tonos"), ("Ναι", "ναι.", "punctuation_capitalization"),
        ("στις 5", "στις 6", "number_date"), ("δ ε υ α εδω", "ΔΕΥΑ εδω", "acronym_abbreviation"), ("καλη μερα", "καλημερα", "word_boundary"),
        ("ο γιαννης", "ο Γιάνννης", "named_entity"), ("ναι", "ναι βεβαια", "insertion_deletion"), ("ειναι", "ηναι", "homophone"), ("γραφω", "γραφει", "morph_grammar"), ("ενα", "δυο", "other_lexical"),
    ]
    rows = spark.createDataFrame(cases, "b string, a string, e string").select("e", classify.error_category(F.col("b"), F.col("a")).alias("got")).collect()
    assert [r.got for r in rows] == [r.e for r in rows]


def test_mechanical_labels(spark):
    cases = [("οπωσ", "όπως", "accent_tonos,final_sigma"), ("τα παντα", "ταπαντα", "word_boundary"), ("δ ε η", "ΔΕΗ", "acronym_abbreviation"), ("τιχος", "τοιχος", ""), ("τοιχη", "τοιχι", "homophone"), ("Ναι", "ναι!", "punctuation_capitalization"), ("ενα", "δυο", ""), ("a\nb", "a b", ""), ("εμ ναι ναι πάμε", "ναι πάμε", "disfluency_cleanup"), ("ναι τώρα πάμε", "ναι πάμε", "")]
    rows = spark.createDataFrame(cases, "b string, a string, e string").select("e", F.array_join(classify.mechanical_labels(F.col("b"), F.col("a")), ",").alias("got")).collect()
    assert [r.got for r in rows] == [r.e for r in rows]


def test_ingest(spark):
    cases = [("a", "b", "1", "2", "clean", ""), ("", "", "1", "2", "noop_edit", ""), ("a", "", "1", "2", "empty_after", ""), ("a  b", "a b", "1", "2", "whitespace_only", "whitespace_normalised"), ("a", "b", "2", "1.97", "clean", "timestamps_swapped"), ("a", "b", "x", "1", "reversed_timestamps", ""), ("a\n\n<think>b", "b", "1", "2", "embedded_reasoning", "reasoning_stripped")]
    rows = spark.createDataFrame(cases, "b string, a string, s string, e string, want string, tags string").select("want", "tags", classify.ingest(F.col("b"), F.col("a"), F.col("s"), F.col("e")).alias("g")).collect()
    assert [(r.g.ingest_category, r.g.cleaning_applied) for r in rows] == [(r.want, r.tags) for r in rows]
