"""Further named queries, registered beside those of ``catalogue``: scalars, text forms, sources, labels, reviews, fusion and resampling.

Where a rule needs letters of another script, the Latin ones of the tables are mapped to it first, in Spark and in SQL alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import distance, scalars, sketches, text
from palimpsest.operators import alignment, classify, fusion, guards, intervals, labels, language, matching, review, selection, statistics
from palimpsest.sources import readers, writers

from palimpsest.streaming import events as streams

from . import dataset
from .catalogue import _CANON as _CANONICAL
from .catalogue import _DELTAS, _EDITS, _SPANS, _r, _turn_tokens, _verdicts, drawn, edits, long, query, spans, table

_GREEK = ("abgdezhiklmnoprstfxw", "αβγδεζηικλμνοπρστφχω")
_WORDS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+')"


def greek(c: Column) -> Column:
    return F.translate(text.plain(c), *_GREEK)


_GREEK_SQL = f"translate(lower(strip_accents(text)), '{_GREEK[0]}', '{_GREEK[1]}')"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for what a query writes and reads again."""
    from palimpsest.session import shared

    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


# --- scalars -----------------------------------------------------------------------------------------------------

_MON = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS day, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month,
  CASE WHEN o_orderkey % 5 = 0 THEN 'special_' || o_orderkey ELSE {_MON}[month(o_orderdate)] || day(o_orderdate) || '_' || year(o_orderdate) END AS bare FROM orders""")
def slug_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMM").alias("m"), F.dayofmonth("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"))
    stem = F.concat(F.lower("m"), F.col("d").cast("string"))
    plain = F.concat_ws("_", stem, F.col("y"))
    counted = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("_", stem, F.lit("2"), F.col("y"))).when(F.col("o_orderkey") % 3 == 1, F.concat_ws("_", plain, F.lit("2"))).otherwise(plain)
    slug = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("special_"), F.col("o_orderkey").cast("string"))).otherwise(counted)
    return rows.select("o_orderkey", scalars.slug_date(slug).alias("day"), scalars.meeting_month(slug).alias("month"), scalars.without_session(slug).alias("bare"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def iso_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.iso_to_seconds_text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"))


@query("""SELECT event_id, user_id || '|' || round((event_id + 0.25) * 100)::BIGINT || '|' || round((event_id + 1.5) * 100)::BIGINT AS span_key, substr(sha1(event_id || '|' || coalesce(event_type, '') || '|' || user_id), 1, 16) AS signature,
  user_id || '/' || event_type AS owner FROM events""")
def span_identities(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    key = scalars.span_key(F.col("user_id").cast("string"), F.col("event_id") + 0.25, F.col("event_id") + 1.5)
    return rows.select("event_id", key.alias("span_key"), scalars.row_signature(F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("signature"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("owner"))


@query("""SELECT event_id, least(1.0, greatest(0.0, (value - 20) / 50)) AS clamped, value / 100 BETWEEN 0 AND 1 AND value IS NOT NULL AS known, round((event_id + 7.5) - 30 * floor((event_id + 7.5) / 30), 6) AS phase,
  CASE WHEN value IS NULL THEN NULL WHEN value < 1 THEN '<1s' WHEN value < 3 THEN '1-3s' WHEN value < 5 THEN '3-5s' WHEN value < 10 THEN '5-10s' WHEN value < 20 THEN '10-20s' WHEN value < 30 THEN '20-30s' ELSE '>=30s' END AS bucket,
  round(floor(value / 0.02 + 1e-9) * 0.02, 2) AS low, round(ceil(value / 0.02 - 1e-9) * 0.02, 2) AS high FROM events""")
def number_forms(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.clamp((v - 20) / 50).alias("clamped"), scalars.valid_confidence(v / 100).alias("known"), F.round(scalars.phase(F.col("event_id").cast("double"), -7.5, 30.0), 6).alias("phase"),
        scalars.duration_bucket(v).alias("bucket"), scalars.floor_grid(v).alias("low"), scalars.ceil_grid(v).alias("high"))


@query("""WITH RECURSIVE h AS (SELECT o_orderpriority AS t, lower(trim(o_orderpriority)) AS s, 0 AS i, 2166136261::BIGINT AS v FROM (SELECT DISTINCT o_orderpriority FROM orders)
  UNION ALL SELECT t, s, i + 1, ((xor(v, ascii(substr(s, i + 1, 1))::BIGINT))::HUGEINT * 16777619 % 4294967296)::BIGINT FROM h WHERE i < length(s))
SELECT t AS priority, v AS seed FROM h WHERE i = length(s)""")
def seed_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")).distinct()
    return rows.select("priority", scalars.fnv1a(F.col("priority")).alias("seed"))


@query("SELECT event_id, (event_id % 4) AS verdict, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 END AS second, event_id % 5 = 0 AS broken FROM events")
def json_verdicts(spark, sf_dir):
    """Answers as JSON in free text: a fenced block, bare brackets between words, or nothing that parses."""
    a, b = (F.col("event_id") % 4).cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise((F.col("event_id") % 7).cast("string"))
    body = F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone [ok]."))).otherwise(F.concat(F.lit("The answer is "), body, F.lit(".")))
    rows = table(spark, sf_dir, "events").select("event_id", scalars.padded(scalars.json_array(said, "array<long>"), 3).alias("v"), scalars.json_array(F.when(F.col("event_id") % 5 == 0, F.lit("no answer")).otherwise(said), "array<long>").alias("w"))
    return rows.select("event_id", F.get("v", F.lit(0)).alias("verdict"), F.get("v", F.lit(1)).alias("second"), (F.size(scalars.as_list(F.col("w").cast("array<string>"))) == 0).alias("broken"))


@query(f"""WITH {_SPANS} SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN start + 0.5 ELSE start END, 3) AS start, round(CASE WHEN event_id % 3 = 0 THEN "end" - 0.5 ELSE "end" END, 3) AS "end" FROM spans""")
def adjusted_spans(spark, sf_dir):
    third, known = F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1
    rows = spans(spark, sf_dir).withColumns({"a": F.when(third | known, F.col("start") + 0.5), "b": F.when(third, F.col("end") - 0.5)})
    return rows.withColumn("s", scalars.coalesce_span(F.col("start"), F.col("end"), F.col("a"), F.col("b"))).select("event_id", F.round("s.start", 3).alias("start"), F.round("s.end", 3).alias("end"))


@query("""SELECT doc_id, round(1.0 * greatest(0.05, least(1.0, (n_chars % 100 / 100.0 - 0.08) / 0.22)) * CASE WHEN doc_id % 7 <= 1 THEN 1.0 WHEN doc_id % 7 <= 2 THEN 0.95 WHEN doc_id % 7 <= 3 THEN 0.8 WHEN doc_id % 7 <= 5 THEN 0.55 ELSE 0.25 END
  * CASE WHEN doc_id % 11 <= 1 THEN 1.1 WHEN doc_id % 11 <= 2 THEN 1.0 WHEN doc_id % 11 <= 3 THEN 0.75 WHEN doc_id % 11 <= 5 THEN 0.45 ELSE 0.15 END
  * CASE WHEN n_chars / 100 BETWEEN 1.5 AND 12 THEN 1.0 WHEN n_chars / 100 > 12 AND n_chars / 100 <= 25 THEN 0.85 WHEN n_chars / 100 >= 0.8 AND n_chars / 100 < 1.5 THEN 0.6 WHEN n_chars / 100 > 25 THEN 0.55 ELSE 0.25 END
  * CASE WHEN doc_id % 11 >= 8 THEN 0.0 WHEN n_chars % 100 / 100.0 >= 0.55 THEN 0.15 WHEN doc_id % 13 <= 2 THEN 0.25 ELSE 1.0 END, 9)::DOUBLE AS score FROM documents""")
def candidate_scores(spark, sf_dir):
    n, d = F.col("n_chars"), F.col("doc_id")
    score = classify.base_score(F.lit(1.0), n % 100 / 100.0, d % 7, d % 11, d % 13, n / 100, F.lit(1.0))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 9).alias("score"))


# --- text --------------------------------------------------------------------------------------------------------

@query(f"""SELECT doc_id, md5(lower(strip_accents(text))) AS plain, md5(upper(strip_accents(replace(text, 'ß', 'ss')))) AS upper_form, md5({_GREEK_SQL}) AS greek,
  md5(translate(replace(replace(replace({_GREEK_SQL}, 'θ', 'th'), 'χ', 'ch'), 'ψ', 'ps'), 'αβγδεζηικλμνξοπρσςτυφω', 'avgdeziiklmnxoprsstyfo')) AS latin FROM documents""")
def script_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain(t)).alias("plain"), F.md5(text.upper_without_marks(F.replace(t, F.lit("ß"), F.lit("ss")))).alias("upper_form"), F.md5(greek(t)).alias("greek"), F.md5(text.greek_to_latin(greek(t))).alias("latin"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(list_distinct(regexp_extract_all({_GREEK_SQL}, '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM documents),
s AS (SELECT w, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, 'αι', 'ε', 'g'), 'ει', 'ι', 'g'), 'οι', 'ι', 'g'), 'υι', 'ι', 'g'), '[ηιυ]', 'ι', 'g'), 'ω', 'ο', 'g'), ''), lambda x: x <> '') AS c FROM w)
SELECT w, array_to_string(list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i > 1 AND c[i] = c[i - 1] THEN '' ELSE c[i] END), lambda x: x <> ''), '') AS sound,
  translate(replace(replace(replace(replace(w, 'ει', 'I'), 'οι', 'I'), 'αι', 'E'), 'ου', 'U'), 'ηιυωοεα', 'IIIOOEA') AS vowels FROM s""")
def sound_skeletons(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(greek(F.col("text")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("w")).distinct()
    return words.select("w", text.phonetic_skeleton(F.col("w")).alias("sound"), text.vowel_skeleton(F.col("w")).alias("vowels"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(list_distinct(regexp_extract_all({_GREEK_SQL}, '[α-ω]+'))) AS w FROM documents), c AS (SELECT w, list_filter(string_split(w, ''), lambda x: x <> '') AS c FROM w)
SELECT w, array_to_string(list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i > 1 AND c[i] = c[i - 1] AND contains('βγδζθκλμνξπρσςτφχψ', c[i]) THEN '' ELSE c[i] END), lambda x: x <> ''), '') AS single FROM c""")
def doubled_letters(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(greek(F.col("text")), F.lit("([α-ω]+)"), F.lit(1)))).alias("w")).distinct()
    return words.select("w", review.single_consonants(F.col("w")).alias("single"))


@query("""SELECT event_id, 'δημοσ' || event_id || ' AB κ' || CASE WHEN event_id % 2 = 0 THEN 'α' ELSE 'ο' END || 'λοσ' AS fixed, 'the text ' || event_id AS bare, event_id % 3 = 0 AS marked, event_id % 4 = 0 AS complete FROM events""")
def transcript_marks(spark, sf_dir):
    """Lookalike letters in words of both scripts, reasoning that follows a transcript, marks in notes, whole sentences."""
    n = F.col("event_id").cast("string")
    mixed = F.concat(F.lit("δημoσ"), n, F.lit(" AB κ"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("o"), F.lit("λοσ"))
    tail = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("the text "), n, F.lit("\n\nWait, let me reconsider this."))).otherwise(F.concat(F.lit("the text "), n))
    note = F.when(F.col("event_id") % 3 == 0, F.lit("two voices, c here")).otherwise(F.lit("chance of noise"))
    whole = F.when(F.col("event_id") % 4 == 0, F.lit(" The end.")).otherwise(F.lit("the end"))
    return table(spark, sf_dir, "events").select("event_id", text.fix_homoglyphs(mixed).alias("fixed"), text.strip_reasoning(tail).alias("bare"), text.has_overlap_marker(note).alias("marked"), text.complete_sentence(whole).alias("complete"))


@query("""WITH s AS (SELECT c_custkey, ['παπαδοπουλος', 'νικολαου', 'γεωργιος', 'δημητρης', 'τσακαλας', 'αλεξις'][(c_custkey % 6 + 1)::INT] AS name FROM customer)
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'παπαδοπουλος|παπαδοπουλου|παπαδοπουλο' WHEN 1 THEN 'νικολαου' WHEN 2 THEN 'γεωργιος|γεωργιου|γεωργιο' WHEN 3 THEN 'δημητρης|δημητρη' WHEN 4 THEN 'τσακαλας|τσακαλα' ELSE 'αλεξις|αλεξι' END AS forms,
  CASE WHEN c_custkey % 2 = 0 THEN replace(name, 'ς', 'σ') || '|ιωαννησ' ELSE 'ιωαννησ|' || replace(name, 'ς', 'σ') END AS tokens FROM s""")
def surname_forms(spark, sf_dir):
    names = F.array(*map(F.lit, ("παπαδοπουλος", "νικολαου", "γεωργιος", "δημητρης", "τσακαλας", "αλεξις")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 6).cast("int")).alias("n"))
    tokens = text.name_tokens(F.concat(F.lit("Ιωάννης ο "), F.col("n")))
    placed = F.when(F.col("c_custkey") % 2 == 0, F.array_sort(tokens, lambda a, b: F.when(a == "ιωαννησ", 1).when(b == "ιωαννησ", -1).otherwise(0))).otherwise(F.array_sort(tokens, lambda a, b: F.when(a == "ιωαννησ", -1).when(b == "ιωαννησ", 1).otherwise(0)))
    return rows.select("c_custkey", F.array_join(text.inflections(F.col("n")), "|").alias("forms"), F.array_join(placed, "|").alias("tokens"))


@query(f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t) WHERE w[i] IS NOT NULL AND w[i + 1] IS NOT NULL),
q AS (SELECT a, b FROM p WHERE regexp_full_match(a, '[a-z0-9_]+') AND regexp_full_match(b, '[a-z0-9_]+'))
SELECT a, b, damerau_levenshtein(a, b) <= 1 AS near FROM q""")
def near_words(spark, sf_dir):
    w = text.word_tokens(F.col("text"))
    pairs = table(spark, sf_dir, "documents").select(w.alias("w")).select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - 1)).alias("a"), F.slice("w", F.lit(2), F.greatest(F.lit(0), F.size("w") - 1)).alias("b"))).alias("p"))
    ascii_ = pairs.select("p.a", "p.b").distinct().filter("a RLIKE '^[a-z0-9_]+$' AND b RLIKE '^[a-z0-9_]+$'")
    return ascii_.select("a", "b", distance.transposed_or_near(F.col("a"), F.col("b")).alias("near"))


_PAIRS = """t AS (SELECT conv_id, turn, coalesce(regexp_extract_all(lower(strip_accents(lag(text) OVER (PARTITION BY conv_id ORDER BY turn))), '[\\p{L}\\p{N}_]+'), []) AS r, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+') AS h FROM conversations),
c AS (SELECT conv_id, turn, w, sum(a) AS a, sum(b) AS b FROM (SELECT conv_id, turn, unnest(r) AS w, 1 AS a, 0 AS b FROM t UNION ALL SELECT conv_id, turn, unnest(h), 0, 1 FROM t) GROUP BY ALL)"""


@query(f"WITH {_PAIRS} SELECT t.conv_id, t.turn, coalesce(sum(greatest(a - b, 0)), 0)::BIGINT AS lost, coalesce(sum(greatest(b - a, 0)), 0)::BIGINT AS added, coalesce(sum(least(a, b)), 0)::BIGINT AS shared FROM t LEFT JOIN c USING (conv_id, turn) GROUP BY ALL")
def token_multisets(spark, sf_dir):
    r, h = F.col("ref"), F.col("hyp")
    return _turn_tokens(spark, sf_dir).select("conv_id", "turn", long(F.size(distance.multiset_minus_udf(r, h))).alias("lost"), long(F.size(distance.multiset_minus_udf(h, r))).alias("added"), long(F.size(r) - F.size(distance.multiset_minus_udf(r, h))).alias("shared"))


@query(f"WITH {_PAIRS} SELECT t.conv_id, t.turn, coalesce(sum(greatest(a - b, 0)), 0) + coalesce(sum(greatest(b - a, 0)), 0) = 0 AS same_bag, r = h AS same_words, len(list_distinct(list_filter(h, lambda x: NOT list_contains(r, x))))::BIGINT AS novel FROM t LEFT JOIN c USING (conv_id, turn) GROUP BY t.conv_id, t.turn, r, h")
def word_changes(spark, sf_dir):
    r, h = F.col("ref"), F.col("hyp")
    bag = (F.size(distance.multiset_minus_udf(r, h)) == 0) & (F.size(distance.multiset_minus_udf(h, r)) == 0)
    return _turn_tokens(spark, sf_dir).select("conv_id", "turn", bag.alias("same_bag"), (r == h).alias("same_words"), long(F.size(F.array_except("hyp", "ref"))).alias("novel"))


_CANON = "list_filter(string_split(trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"""WITH e AS (SELECT conv_id, turn, {_CANON.format('lag(text, 2) OVER w')} AS s, {_CANON.format('lag(text) OVER w')} AS m, {_CANON.format('text')} AS g FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT conv_id, turn, x, sum(a) AS s, sum(b) AS m, sum(c) AS g FROM (SELECT conv_id, turn, unnest(s) AS x, 1 AS a, 0 AS b, 0 AS c FROM e UNION ALL SELECT conv_id, turn, unnest(m), 0, 1, 0 FROM e UNION ALL SELECT conv_id, turn, unnest(g), 0, 0, 1 FROM e) GROUP BY ALL),
n AS (SELECT conv_id, turn, sum(greatest(g - s, 0) + greatest(s - g, 0)) AS needed, sum(least(greatest(g - s, 0), m) + least(greatest(s - g, 0), greatest(s - m, 0))) AS achieved, sum(greatest(greatest(m - s, 0) - greatest(g - s, 0), 0) + greatest(greatest(s - m, 0) - greatest(s - g, 0), 0)) AS harm FROM k GROUP BY ALL)
SELECT e.conv_id, e.turn, m = g AS exact, round(CASE WHEN coalesce(needed, 0) = 0 THEN 1.0 ELSE achieved / needed END, 9)::DOUBLE AS applied, round(coalesce(harm, 0) / greatest(1, len(s)), 9)::DOUBLE AS beyond FROM e LEFT JOIN n USING (conv_id, turn)""")
def correction_scores(spark, sf_dir):
    """A turn as the gold form, the one before as the output, the one before that as the source."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.canonical_tokens(F.col("text")).alias("g"))
    none = F.array().cast("array<string>")
    rows = rows.select("conv_id", "turn", F.coalesce(F.lag("g", 2).over(w), none).alias("s"), F.coalesce(F.lag("g").over(w), none).alias("m"), "g")
    rows = rows.withColumn("x", distance.token_edit_scores(F.col("s"), F.col("m"), F.col("g")))
    return rows.select("conv_id", "turn", F.col("x.normalized_exact").alias("exact"), F.round("x.edit_application", 9).alias("applied"), F.round("x.overcorrection", 9).alias("beyond"))


# --- alignment and fusion ----------------------------------------------------------------------------------------

_STREAMS = """s AS (SELECT event_id, ['a', 'b', NULL][(event_id % 3 + 1)::INT] AS x, ['a', 'c', 'b', NULL][(event_id % 4 + 1)::INT] AS y, ['b', 'a', NULL, 'c', 'a'][(event_id % 5 + 1)::INT] AS z FROM events)"""


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of three entries in every mixture of words and gaps."""
    pick = lambda *words: F.get(F.array(*map(F.lit, words)), (F.col("event_id") % len(words)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.array(pick("a", "b", None), pick("a", "c", "b", None), pick("b", "a", None, "c", "a")).alias("c"))


@query(f"""WITH {_STREAMS}, n AS (SELECT *, (x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (z IS NOT NULL)::INT AS k FROM s), v AS (SELECT *, CASE WHEN k < 2 THEN NULL WHEN x = y OR x = z THEN x WHEN y = z THEN y ELSE coalesce(x, y, z) END AS token FROM n)
SELECT event_id, token, CASE WHEN k < 2 THEN 'epsilon' WHEN k = 3 AND x = y AND y = z THEN 'unanimous' WHEN coalesce(x = y, false) OR coalesce(x = z, false) OR coalesce(y = z, false) THEN 'majority' WHEN x IS NOT NULL THEN 'tie_pivot' ELSE 'tie_priority' END AS reason,
  coalesce(token, CASE WHEN k = 1 AND event_id % 2 = 0 THEN coalesce(x, y, z) END) AS guarded, (x IS DISTINCT FROM y)::INT + (x IS DISTINCT FROM z)::INT + (y IS DISTINCT FROM z)::BIGINT AS cost,
  CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'single' WHEN 2 THEN CASE WHEN coalesce(x = y, false) OR coalesce(x = z, false) OR coalesce(y = z, false) THEN 'pair' ELSE 'pair_split' END
    ELSE CASE WHEN x = y AND y = z THEN 'unanimous' WHEN x = y OR x = z OR y = z THEN 'two_of_three' ELSE 'all_different' END END AS class FROM v""")
def column_votes(spark, sf_dir):
    rows = _streams(spark, sf_dir).withColumns({"v": alignment.vote(F.col("c"), 0), "one": F.array("c")})
    fire = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return rows.select("event_id", "v.token", "v.reason", F.get(fusion.compose_guarded(F.col("one"), 0, fire), F.lit(0)).alias("guarded"), alignment.columns_cost(F.col("one")).alias("cost"), classify.column_class(F.col("c")).alias("class"))


@query("SELECT event_id, CASE WHEN value >= 50 THEN 'new' ELSE 'old' END || ',' || CASE WHEN event_id % 2 = 0 AND value >= 50 THEN '' ELSE 'kept' END AS words, event_id % 3 = 0 AS torn FROM events")
def confident_words(spark, sf_dir):
    """Words replaced, or taken away, where the confidence reaches a threshold; columns in which two streams cut the same letters differently."""
    choice = lambda i, token: F.struct(F.lit(i).alias("i"), token.cast("string").alias("token"), F.col("value").alias("confidence"))
    choices = F.array(choice(0, F.lit("new")), F.when(F.col("event_id") % 2 == 0, choice(1, F.lit(None))).otherwise(choice(1, F.lit("kept"))))
    words = fusion.override(F.array(F.lit("old"), F.lit("kept")), choices, 50)
    columns = F.when(F.col("event_id") % 3 == 0, F.array(F.array(F.lit("στο"), F.lit("σ"), F.lit(None)), F.array(F.lit(None).cast("string"), F.lit("το"), F.lit("στο")))).otherwise(F.array(F.array(F.lit("στο"), F.lit("στο"), F.lit("α")), F.array(F.lit("ν"), F.lit("ν"), F.lit("β"))))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit(""))).alias("words"), (F.size(fusion.split_or_merged(columns)) == 2).alias("torn"))


@query("""WITH x AS (SELECT user_id, event_id, epoch(ts) AS t, value, event_type = 'error' OR event_type = 'click' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
b AS (SELECT *, p - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM x WHERE bad)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n, round(min(t), 3) AS page_start, round(max(t), 3) AS page_end, max(value) AS max_gap FROM b GROUP BY user_id, run""")
def conflict_zones(spark, sf_dir):
    rows = table(spark, sf_dir, "events").join(spans(spark, sf_dir).select("event_id", F.col("start").alias("t")), "event_id")
    out = fusion.zones(rows, ["user_id"], "event_id", F.col("event_type").isin("error", "click"), "value", "t")
    return out.select("user_id", "first", "last", "n", *_r("page_start", "page_end"), "max_gap")


@query("""WITH x AS (SELECT user_id, event_id, epoch(ts) AS t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), b AS (SELECT *, p - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM x WHERE event_type IN ('view', 'click', 'error'))
SELECT user_id, round(arg_min(t, event_id), 3) AS start, round(arg_max(t, event_id), 3) AS "end" FROM b GROUP BY user_id, run HAVING count(*) >= 3""")
def lost_runs(spark, sf_dir):
    rows = spans(spark, sf_dir).select("user_id", "event_id", F.col("start").alias("t"), F.when(F.col("event_type").isin("view", "click", "error"), "D").otherwise("M").alias("op"))
    return fusion.deletion_runs(rows, ["user_id"], "event_id", "op", "t").select("user_id", *_r("start", "end"))


@query(f"""WITH {_SPANS}, c AS (SELECT DISTINCT user_id, start AS t FROM spans WHERE event_type = 'click')
SELECT s.event_id, count(c.t) AS cell FROM spans s LEFT JOIN c ON c.user_id = s.user_id AND c.t <= s.start GROUP BY s.event_id""")
def cell_numbers(spark, sf_dir):
    rows = spans(spark, sf_dir).select("event_id", "user_id", "event_type", F.col("start").alias("t"))
    cuts = rows.filter("event_type = 'click'").select("user_id", "t").distinct()
    return fusion.in_cells(rows, cuts, ["user_id"]).select("event_id", "cell")


@query(f"""WITH {_SPANS}, c AS (SELECT DISTINCT user_id, start AS t FROM spans WHERE event_type = 'click'), b AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM c UNION ALL SELECT user_id, NULL, min(t) FROM c GROUP BY user_id)
SELECT user_id, round(a, 3) AS start, round(b, 3) AS "end" FROM b""")
def time_cells(spark, sf_dir):
    cuts = spans(spark, sf_dir).filter("event_type = 'click'").select("user_id", F.col("start").alias("t")).distinct()
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.round(c, 3)).alias
    return fusion.cells(cuts, ["user_id"]).select("user_id", finite(F.col("start"))("start"), finite(F.col("end"))("end"))


@query("""WITH x AS (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
SELECT event_id, coalesce(m - value > 1e-6, false) AS backwards, CASE WHEN m - value > 1e-6 THEN round(m - value, 3) END AS regression FROM x""")
def backward_times(spark, sf_dir):
    return fusion.backwards(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value").select("event_id", "backwards", "regression")


@query("""WITH d AS (SELECT doc_id, n_chars / 10 AS e, greatest(1, ceil((n_chars / 10 - 30) / 20) + 1)::BIGINT AS n FROM documents), w AS (SELECT *, unnest(range(0, n)) AS i FROM d),
v AS (SELECT doc_id, i, 20e0 * i AS a, least(20e0 * i + 30, e) AS b, CASE WHEN i = 0 THEN 0e0 ELSE 20e0 * i + 5 END AS oa, CASE WHEN i = n - 1 THEN e ELSE 20e0 * i + 25 END AS ob FROM w),
c AS (SELECT doc_id, i, a + k * (b - a) / 4 AS s, a + (k + 1) * (b - a) / 4 AS t FROM v, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE b > a),
o AS (SELECT c.doc_id, c.i, s, t, arg_min(v.i, (abs((s + t) / 2 - (v.a + v.b) / 2), v.i)) AS own FROM c JOIN v ON c.doc_id = v.doc_id AND (s + t) / 2 BETWEEN v.a - 1e-7 AND v.b + 1e-7 GROUP BY ALL)
SELECT o.doc_id, o.i AS "window", round(s, 6) AS start, round(t, 6) AS "end" FROM o JOIN v ON v.doc_id = o.doc_id AND v.i = o.i WHERE own = o.i AND (s + t) / 2 BETWEEN oa - 1e-7 AND ob + 1e-7""")
def seam_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0.0).alias("start"), (F.col("n_chars") / 10).alias("end"))
    windows = intervals.windows(rows, 30, 20).drop("start", "end").withColumns({c: F.col(c).cast("double") for c in ("w_start", "w_end", "own_start", "own_end")})
    quarter = (F.col("w_end") - F.col("w_start")) / 4
    four = windows.filter("w_end > w_start").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("doc_id", "window", (F.col("w_start") + F.col("k") * quarter).alias("start"), (F.col("w_start") + (F.col("k") + 1) * quarter).alias("end"))
    out = fusion.seam_kept(four, windows, ["doc_id"])
    return out.select("doc_id", long(F.col("window")).alias("window"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS t FROM part), x AS (SELECT p_partkey, t, unnest(range(1, len(t) + 1)) AS i, list_sum(list_transform(t, lambda q: length(q))) AS n FROM w)
SELECT p_partkey, i - 1 AS place, t[i] AS token, round(10 + 6.0 * coalesce(list_sum(list_transform(t[1:i - 1], lambda q: length(q))), 0) / n, 6)::DOUBLE AS start, round(10 + 6.0 * list_sum(list_transform(t[1:i], lambda q: length(q))) / n, 6)::DOUBLE AS "end" FROM x""")
def timed_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("t"))
    parts = rows.select("p_partkey", F.posexplode(fusion.word_parts(F.col("t"), F.lit(10.0), F.lit(16.0))).alias("place", "s"))
    return parts.select("p_partkey", long(F.col("place")).alias("place"), "s.token", F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"))


@query("""WITH h AS (SELECT user_id, event_id, event_type, value, (event_id % 17)::DOUBLE AS lm, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY r) AS k FROM h) WHERE k = 1), t AS (SELECT user_id, arg_min(value, r) AS v0, arg_min(lm, r) AS l0, min(r) AS r0 FROM d GROUP BY user_id),
g AS (SELECT d.user_id, event_id, r, r0, CASE WHEN r = r0 THEN 0 ELSE (value - v0) / 20 + 0.3 * (lm - l0) / 5 END AS gain FROM d JOIN t USING (user_id))
SELECT user_id, arg_max(event_id, (round(gain, 9), -r)) AS event_id, round(max(gain), 9) AS gain FROM g GROUP BY user_id""")
def chosen_hypotheses(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumns({"r": F.row_number().over(w) - 1, "lm": (F.col("event_id") % 17).cast("double")})
    once = fusion.distinct_hypotheses(rows, ["user_id"], F.col("event_type"), "r")
    return fusion.rescored(once, ["user_id"], "r", "value", "lm", 0.3, 20.0, 5.0).select("user_id", "event_id", F.round("gain", 9).alias("gain"))


@query("SELECT arg_min(l_linenumber, (s, l_linenumber))::BIGINT AS setting, min(s)::DOUBLE AS cost FROM (SELECT l_linenumber, sum(l_quantity) AS s FROM lineitem GROUP BY l_linenumber)")
def best_setting(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy(long(F.col("l_linenumber")).alias("setting")).agg(F.sum("l_quantity").cast("double").alias("cost"))
    return fusion.first_least(totals, "setting", "cost")


# --- reviews, names and terms ------------------------------------------------------------------------------------

@query(f"""WITH {_EDITS}, p AS (SELECT conv_id, bool_or(edited_by = 'user') AS t, bool_or(edited_by = 'assistant') AS u, arg_min(before_text, turn) AS b, arg_max(after_text, turn) AS a FROM edits GROUP BY conv_id),
f AS (SELECT conv_id, CASE WHEN t AND u THEN 'both' WHEN t THEN 'task' WHEN u THEN 'user' ELSE 'unknown' END AS profile, lower(regexp_replace(b, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) = lower(regexp_replace(a, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS punct FROM p)
SELECT conv_id, profile, profile IN ('both', 'user') AND NOT punct AS queued FROM f""")
def review_queue(spark, sf_dir):
    """Groups of edits by who made them; the queue leaves out changes of punctuation alone."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    groups = edits(spark, sf_dir).groupBy("conv_id").agg(F.bool_or(F.col("edited_by") == "user").alias("t"), F.bool_or(F.col("edited_by") == "assistant").alias("u"), F.min_by("before_text", "turn").alias("b"), F.max_by("after_text", "turn").alias("a"))
    profile = F.when(F.col("t") & F.col("u"), "both").when(F.col("t"), "task").when(F.col("u"), "user").otherwise("unknown")
    return groups.select("conv_id", profile.alias("profile"), review.matches_filter(profile, bare(F.col("b")) == bare(F.col("a")), True, ["both", "user"]).alias("queued"))


@query("SELECT event_id, event_id % 3 = 0 AS marked FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def noted_rows(spark, sf_dir):
    note = F.when(F.col("event_id") % 5 == 0, F.lit("  ")).when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 3 == 0, F.lit("voices: C")).otherwise(F.lit("cut"))
    return review.noted(table(spark, sf_dir, "events").select("event_id", note.alias("note")), "note").select("event_id", "marked")


@query("SELECT user_id, min(event_id) AS place FROM events WHERE event_type = 'error' GROUP BY user_id")
def category_queue(spark, sf_dir):
    return review.queue_of(table(spark, sf_dir, "events"), "user_id", "event_type", "error", "event_id")


@query("""SELECT 'total' AS what, count(*) AS n FROM documents UNION ALL SELECT 'labeled', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'remaining', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'source:' || CASE WHEN toxic = 1 THEN 'b' ELSE 'a' END, count(*) FROM labels GROUP BY 1""")
def label_progress(spark, sf_dir):
    done = table(spark, sf_dir, "labels").withColumn("by", F.when(F.col("toxic") == 1, "b").otherwise("a"))
    return review.progress(table(spark, sf_dir, "documents"), done, "doc_id", "by")


@query("""WITH g AS (SELECT event_type, avg(CASE WHEN value < 60 THEN 1.0 ELSE 0 END) AS p, avg(CASE WHEN value < 45 THEN 1.0 ELSE 0 END) AS h FROM events GROUP BY event_type)
SELECT event_type, CASE WHEN greatest(p, h) >= 0.7 THEN 'llm_post_correction' WHEN greatest(p, h) < 0.4 AND event_type IN ('error', 'click') THEN 'asr_finetune' WHEN event_type IN ('view') THEN 'rule_based' ELSE 'review' END AS "to",
  CASE WHEN h - p >= 0.05 THEN 'helps' WHEN h - p <= -0.05 THEN 'hurts' ELSE 'none' END AS effect FROM g""")
def category_routes(spark, sf_dir):
    rates = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") < 60).cast("double")).alias("p"), F.avg((F.col("value") < 45).cast("double")).alias("h"))
    return rates.select("event_type", review.route(F.col("event_type"), F.col("p"), F.col("h"), ["error", "click"], ["view"]).alias("r")).select("event_type", "r.*")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY coalesce(CASE WHEN doc_id % 3 > 0 THEN n_chars % 4 / 2.0 END, 2.0), n_chars, (doc_id <> 7)::INT, doc_id::VARCHAR) AS place FROM documents")
def ranked_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") % 4 / 2.0).alias("rate"), "n_chars", F.col("doc_id").cast("string").alias("name"))
    return rows.select("doc_id", long(F.row_number().over(Window.partitionBy("lang").orderBy(*review.incumbent_order("rate", "n_chars", "name", "7")))).alias("place"))


@query("SELECT conv_id, turn, length(trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) < 20 OR len(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+')) < 5 AS short FROM conversations")
def short_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", review.short_text(F.col("text")).alias("short"))


@query("SELECT 'missing' AS fault, '' AS what FROM documents WHERE false")
def sound_packs(spark, sf_dir):
    """Packs that ``selection.pack`` makes break none of the rules."""
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("source", "doc_id", (F.row_number().over(w) * 100.0).alias("start"), (F.row_number().over(w) * 100.0 + F.col("n_chars") / 200).alias("end"))
    items = selection.pack(rows, ["source"], "doc_id").withColumn("pack", F.concat_ws(":", "source", "pack")).drop("source")
    return review.pack_faults(items, rows, "doc_id", "source")


@query("""SELECT 'repeated' AS fault, doc_id::VARCHAR AS what FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'too_long', 'p' || doc_id FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT 'late', 'p' || doc_id FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'length', 'p' || doc_id FROM documents WHERE doc_id % 7 = 0""")
def pack_rules(spark, sf_dir):
    """Planted faults, each found by its rule; shares are of equal lengths here."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("c").alias("city"), F.lit(0.0).alias("start"), F.lit(10.0).alias("end"))
    begin = F.when(d % 11 == 0, 1.5).otherwise(0.0)
    items = rows.select("doc_id", F.concat(F.lit("p"), d.cast("string")).alias("pack"), begin.alias("t_start"), (begin + F.when(d % 7 == 0, 31.0).otherwise(10.0)).alias("t_end"))
    again = items.filter("doc_id % 10 = 0").select("doc_id", F.concat(F.lit("q"), d.cast("string")).alias("pack"), F.lit(0.0).alias("t_start"), F.lit(10.0).alias("t_end"))
    return review.pack_faults(items.unionByName(again), rows, "doc_id", "city")


@query("SELECT CASE WHEN op <> 'I' AND event_id % 3 = 0 THEN 'convention' WHEN op = 'I' AND event_id % 4 = 0 THEN 'ref_omission' ELSE 'ours' END AS bucket, count(*) AS n FROM (SELECT event_id, ['S', 'D', 'I', 'M'][(event_id % 4 + 1)::INT] AS op FROM (SELECT (event_id * 7 + user_id) AS event_id FROM events)) WHERE op <> 'M' GROUP BY 1")
def edit_census(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") * 7 + F.col("user_id")).alias("event_id"))
    rows = rows.withColumn("op", F.get(F.array(*map(F.lit, "SDIM")), (F.col("event_id") % 4).cast("int")))
    return review.census(rows, F.col("event_id") % 3 == 0, F.col("event_id") % 4 == 0)


@query("SELECT round(floor(value / 10) * 10, 6) AS bin, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS kept, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 9) AS share FROM events GROUP BY 1")
def score_bins(spark, sf_dir):
    out = review.keep_rates(table(spark, sf_dir, "events"), "value", F.col("event_type") != "error", 10.0)
    return out.select(F.round("bin", 6).alias("bin"), "n", "kept", F.round("share", 9).alias("share"))


@query("SELECT DISTINCT event_id % 6 AS d, event_id % 13 AS l, (event_id % 6) BETWEEN 1 AND 4 AND (event_id % 6 = 1 OR event_id % 6 = 2 AND event_id % 13 >= 5 OR (event_id % 6) / greatest(1, event_id % 13) <= 0.34) AS near FROM events")
def near_gate(spark, sf_dir):
    d, n = F.col("event_id") % 6, F.col("event_id") % 13
    return table(spark, sf_dir, "events").select(d.alias("d"), n.alias("l"), review.near_miss(d, n).alias("near")).distinct()


@query(f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN ('the', 'of', 'a', 'la', 'de', 'der', 'die')) AS k FROM t)
SELECT doc_id, CASE WHEN len(w) = 0 THEN '' WHEN len(k) = 0 THEN w[len(w)] ELSE array_to_string(w[list_min(k):list_max(k)], ' ') END AS span FROM p""")
def trimmed_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.array_join(review.trimmed(F.col("w"), ["the", "of", "a", "la", "de", "der", "die"]), " ").alias("span"))


@query(f"""WITH w AS (SELECT w FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY w HAVING count(*) >= 3), x AS (SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w <> b.w AND left(a.w, 4) = left(b.w, 4) AND length(a.w) >= 4 AND length(b.w) >= 4),
s AS (SELECT a, b, list_min(list_filter(range(1, greatest(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) - 1 AS p FROM x)
SELECT a, b FROM s WHERE length(a) - p <= 4 AND length(b) - p <= 4""")
def word_families(spark, sf_dir):
    """Words of three documents or more that differ in their endings."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.word_tokens(F.col("text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return review.suffix_pairs(words, "w")


@query(f"""WITH t AS (SELECT {_WORDS} AS w FROM documents), e AS (SELECT DISTINCT [w[i]] AS b, [w[i + 1]] AS a FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t)),
s AS (SELECT a, b, list_concat(b, a) AS x, regexp_replace(array_to_string(b, ' '), '[^a-z0-9_ ]', '~', 'g') AS bj, regexp_replace(array_to_string(a, ' '), '[^a-z0-9_ ]', '~', 'g') AS aj FROM e)
SELECT b[1] AS before, a[1] AS after, CASE WHEN len(list_filter(x, lambda q: regexp_matches(q, '[0-9]'))) > 0 THEN 'number' WHEN list_has_any(x, ['the', 'la']) THEN 'roster-name' WHEN list_has_any(x, ['of', 'der']) THEN 'glossary-term'
  WHEN levenshtein(bj, aj) <= greatest(2, floor(0.34 * greatest(length(bj), length(aj)))) THEN 'spelling-tweak' ELSE 'other-lexical' END AS kind FROM s""")
def edit_kinds(spark, sf_dir):
    """Each pair of neighbouring words as an edit of one by the other."""
    w = text.word_tokens(F.col("text"))
    plain = lambda x: F.regexp_replace(x, "[^a-z0-9_ ]", "~")
    words = lambda *xs: F.array(*map(F.lit, xs))
    each = table(spark, sf_dir, "documents").select(w.alias("w")).select("w", F.posexplode("w").alias("i", "before"))
    pairs = each.select("before", F.get("w", F.col("i") + 1).alias("after")).filter("after IS NOT NULL").distinct()
    pairs = pairs.select("before", "after", plain("before").alias("b"), plain("after").alias("a"))  # once each, whatever asks for them
    return pairs.select("before", "after", review.edit_kind(F.array("b"), F.array("a"), words("the", "la"), words("of", "der")).alias("kind"))


@query("SELECT n_nationkey::BIGINT AS nation, c_name AS name, row_number() OVER (PARTITION BY n_nationkey ORDER BY sha256('salt' || n_nationkey || lower(replace(c_name, '#', ' '))), lower(replace(c_name, '#', ' '))) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ranked_surnames(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(long(F.col("c_nationkey")).alias("nation"), F.col("c_name").alias("name"))
    return review.ranked_names(rows, ["nation"], "name", "salt").select("nation", "name", long(F.col("rank")).alias("rank"))


@query(f"WITH w AS (SELECT DISTINCT source, unnest({_WORDS}) AS w FROM documents) SELECT DISTINCT source, n_name AS term FROM w, (SELECT DISTINCT split_part(p_name, ' ', 1) AS n_name FROM part UNION SELECT 'The' UNION SELECT 'de') WHERE w = lower(n_name)")
def roster_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term")).unionByName(spark.createDataFrame([("The",), ("de",)], "term string")).distinct()
    return review.present_terms(terms, table(spark, sf_dir, "documents").select("source", "text"), ["source"], "term", "text")


@query("""SELECT event_type AS raw, CASE event_type WHEN 'click' THEN 'click' ELSE NULL END AS id FROM (SELECT DISTINCT event_type FROM events)
UNION ALL SELECT 'asr_phonetic', 'substitution_phonetic' UNION ALL SELECT 'capitalization', 'punctuation_capitalization' UNION ALL SELECT 'malformed_or_unclear', 'unusable'""")
def category_ids(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("raw")).distinct().unionByName(spark.createDataFrame([("asr_phonetic",), ("capitalization",), ("malformed_or_unclear",)], "raw string"))
    return raw.select("raw", review.category_id(F.col("raw"), ["click"]).alias("id"))


@query("SELECT user_id, string_agg(h, ',' ORDER BY h) AS hashes FROM (SELECT DISTINCT user_id, substr(sha256('key|' || user_id || '|' || event_type), 1, 16) AS h FROM events) GROUP BY user_id")
def event_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("e"))
    return rows.select("user_id", F.array_join(sketches.event_hashes("key", F.col("user_id").cast("string"), F.col("e")), ",").alias("hashes"))


@query("""WITH h AS (SELECT DISTINCT user_id, ('0x' || substr(sha256('key|' || user_id || '|' || event_type), 1, 16))::UBIGINT AS h FROM events), s AS (SELECT i, ((i::HUGEINT * 11400714819323198485 + 1) % 18446744073709551616)::UBIGINT AS salt FROM (SELECT unnest(range(0, 128)) AS i)),
m AS (SELECT user_id, i, min(xor(h, salt)) AS v FROM h, s GROUP BY ALL) SELECT user_id, string_agg(lpad(lower(to_hex(v)), 16, '0'), '' ORDER BY i) AS signature FROM m GROUP BY user_id""")
def minhash_signatures(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("e"))
    return rows.select("user_id", F.array_join(sketches.salted_minima(sketches.event_hashes("key", F.col("user_id").cast("string"), F.col("e"))), "").alias("signature"))


# --- resampling --------------------------------------------------------------------------------------------------

def _interval_sql(counts: str, columns: str, estimate: str, low: float, high: float, draws: int = 1000) -> str:
    return f"""WITH g AS ({counts}), {drawn(columns, draws)}, e AS (SELECT {estimate} AS e FROM r), q AS (SELECT quantile_cont(e, {low}) AS low, quantile_cont(e, {high}) AS high, count(*) FILTER (WHERE e IS NULL) AS undefined FROM e),
w AS (SELECT {estimate.replace('sum(', '(')} AS delta FROM (SELECT {', '.join(f'sum({c}) AS {c}' for c in columns.split(' '))} FROM g))
SELECT round(delta, 9) AS delta, round(low, 9) AS low, round(high, 9) AS high, low > 0 OR high < 0 AS excludes_zero, (SELECT count(*) FROM g) AS n_clusters, undefined FROM q, w"""


def _interval(sums: DataFrame, columns: list[str], estimate: Column, low: float, high: float) -> DataFrame:
    out = statistics.cluster_interval(sums, "source", columns, estimate, draws=1000, low=low, high=high)
    return out.select(*(F.round(c, 9).alias(c) for c in ("delta", "low", "high")), "excludes_zero", "n_clusters", "undefined")


_STRATA = """SELECT source, sum(CASE WHEN n_chars < 1500 THEN toxic ELSE 0 END)::DOUBLE AS a, count(*) FILTER (WHERE n_chars < 1500)::DOUBLE AS m, sum(CASE WHEN n_chars >= 1500 THEN toxic ELSE 0 END)::DOUBLE AS b, count(*) FILTER (WHERE n_chars >= 1500)::DOUBLE AS n
FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.col("n_chars") < 1500
    return _verdicts(spark, sf_dir).groupBy("source").agg(
        F.sum(F.when(short, F.col("toxic")).otherwise(0)).cast("double").alias("a"), F.count_if(short).cast("double").alias("m"),
        F.sum(F.when(~short, F.col("toxic")).otherwise(0)).cast("double").alias("b"), F.count_if(~short).cast("double").alias("n"))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0.0))


@query(_interval_sql(_STRATA, "a m b n", "a / nullif(m, 0) - b / nullif(n, 0)", 0.025, 0.975))
def strata_interval(spark, sf_dir):
    """Difference of rates over different tokens."""
    return _interval(_strata(spark, sf_dir), ["a", "m", "b", "n"], _ratio("a", "m") - _ratio("b", "n"), 2.5, 97.5)


@query(_interval_sql(_STRATA, "a m b n", "a / nullif(a + b, 0) - m / nullif(m + n, 0)", 0.025, 0.975))
def detector_interval(spark, sf_dir):
    """Difference of two detectors' rates, each over what it flags."""
    columns = F.col("a") / F.nullif(F.col("a") + F.col("b"), F.lit(0.0)) - F.col("m") / F.nullif(F.col("m") + F.col("n"), F.lit(0.0))
    return _interval(_strata(spark, sf_dir), ["a", "m", "b", "n"], columns, 2.5, 97.5)


@query(_interval_sql(_DELTAS[len("g AS ("):-1], "d n", "d / nullif(n, 0)", 0.05, 0.95))
def one_sided_bound(spark, sf_dir):
    """The 95th of a hundred is the one-sided upper bound of a paired delta."""
    return _interval(statistics.clusters(_verdicts(spark, sf_dir), "source", "toxic", "low", "one"), ["d", "n"], _ratio("d", "n"), 5.0, 95.0)


_SEEDS = "SELECT source, sum(toxic)::DOUBLE AS t, sum(1 - quality)::DOUBLE AS l, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS v, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source"


@query(_interval_sql(_SEEDS, "t l v n", "((t - l) / nullif(n, 0) + (t - v) / nullif(n, 0) + (l - v) / nullif(n, 0)) / 3", 0.05, 0.95))
def seed_contrast(spark, sf_dir):
    """Mean of three seeds' gaps, all under one resample."""
    sums = _verdicts(spark, sf_dir).groupBy("source").agg(F.sum("toxic").cast("double").alias("t"), F.sum("low").cast("double").alias("l"), F.count_if(F.col("doc_id") % 2 == 0).cast("double").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    gap = lambda a, b: (F.col(a) - F.col(b)) / F.nullif(F.col("n"), F.lit(0.0))
    return _interval(sums, ["t", "l", "v", "n"], (gap("t", "l") + gap("t", "v") + gap("l", "v")) / 3, 5.0, 95.0)


_AREAS = """SELECT source, coalesce(a, 0) AS a, (a IS NOT NULL)::INT::DOUBLE AS k FROM (SELECT source, (sum(r) FILTER (WHERE toxic = 1) - sum(toxic) * (sum(toxic) + 1) / 2) / nullif(sum(toxic) * (count(*) - sum(toxic)), 0) AS a
FROM (SELECT source, toxic, rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL) GROUP BY source)"""


@query(_interval_sql(_AREAS, "a k", "a / nullif(k, 0)", 0.025, 0.975))
def area_interval(spark, sf_dir):
    """Mean of the clusters' AUROCs, over clusters that have one."""
    areas = statistics.auroc(_verdicts(spark, sf_dir), ["source"], "n_chars", F.col("toxic") == 1)
    sums = areas.select("source", F.coalesce("auroc", F.lit(0.0)).alias("a"), F.col("auroc").isNotNull().cast("double").alias("k"))
    return _interval(sums, ["a", "k"], _ratio("a", "k"), 2.5, 97.5)


@query("""WITH x AS (SELECT source AS c, n_chars AS s, toxic = 1 AS y FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL), k AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r, row_number() OVER (PARTITION BY c ORDER BY s, y) AS i, sum(y::INT) OVER (PARTITION BY c) AS pos FROM x),
n AS (SELECT count(*) AS n, sum(y::INT) AS p, sum(CASE WHEN y THEN r END) AS t FROM k), d AS (SELECT c, r, pos, draw, row_number() OVER (PARTITION BY c, draw ORDER BY md5('3|' || draw || '|' || c || '|' || i), i) AS o FROM k, (SELECT unnest(range(1, 201)) AS draw)),
a AS (SELECT draw, (sum(r) - any_value(p * (p + 1) / 2)) / any_value(p * (n - p)) AS a FROM d, n WHERE o <= pos GROUP BY draw)
SELECT round((t - p * (p + 1) / 2) / (p * (n - p)), 9) AS auroc, round((SELECT avg(a) FROM a), 9) AS null_mean, round((SELECT avg(CASE WHEN a >= (t - p * (p + 1) / 2) / (p * (n - p)) - 1e-12 THEN 1.0 ELSE 0 END) FROM a, n), 9) AS p FROM n""")
def label_shuffles(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).filter("source IS NOT NULL").withColumn("y", F.col("toxic") == 1)
    out = statistics.permutation_null(rows, "source", "n_chars", "y", draws=200)
    return out.select(*(F.round(c, 9).alias(c) for c in ("auroc", "null_mean", "p")))


@query("""WITH g AS (SELECT lang, n_chars, sum(CASE WHEN toxic = 1 THEN 3 ELSE -1 END) AS g FROM labels JOIN documents USING (doc_id) GROUP BY ALL), c AS (SELECT lang, n_chars, sum(g) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS t FROM g)
SELECT lang, CASE WHEN max(t) > 0 THEN arg_max(n_chars, (t, n_chars)) END AS threshold, greatest(0, max(t))::BIGINT AS total FROM c GROUP BY lang""")
def best_thresholds(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).withColumn("gain", F.when(F.col("toxic") == 1, 3).otherwise(-1))
    return statistics.fit_threshold(rows, "n_chars", "gain", ["lang"]).select("lang", "threshold", long(F.col("total")).alias("total"))


@query("SELECT source, s::BIGINT AS s, d::BIGINT AS d, i::BIGINT AS i, n, round((s + d + i) / n, 9) AS wer FROM (SELECT source, sum(toxic) AS s, sum(1 - quality) AS d, sum(toxic * quality) AS i, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)")
def operation_rates(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).select("source", F.col("toxic").alias("s"), F.col("low").alias("d"), (F.col("toxic") * F.col("quality")).alias("i"), F.col("one").alias("n"))
    return statistics.rates(rows, ["source"]).select("source", *(long(F.col(c)).alias(c) for c in "sdi"), "n", F.round("wer", 9).alias("wer"))


# --- sources and labels ------------------------------------------------------------------------------------------

@query("SELECT n_name AS edit_id, n_nationkey::VARCHAR AS utterance_start FROM nation")
def csv_scan(spark, sf_dir):
    """Edit rows written as CSV and scanned again, two columns of them."""
    path = scratch(spark, "csv")
    names = [f.split(" ")[0] for f in readers.CORRECTIONS.split(", ")]
    own = {"edit_id": F.col("n_name"), "utterance_start": F.col("n_nationkey").cast("string"), "before_text": F.lit('said "no",\nthen left')}
    table(spark, sf_dir, "nation").select(*(own.get(n, F.lit("x")).alias(n) for n in names)).write.option("header", True).option("escape", '"').csv(path)
    return readers.corrections(spark, path, ["edit_id", "utterance_start"])


@query("SELECT n_name AS name, n_nationkey::BIGINT AS key FROM nation")
def tsv_scan(spark, sf_dir):
    path = scratch(spark, "tsv")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")).write.option("header", True).option("sep", "\t").csv(path)
    return readers.tsv(spark, path, "name string, key long")


@query("SELECT conv_id, turn, text, turn % 3 = 0 AS broken FROM conversations WHERE turn % 3 <> 0 UNION ALL SELECT NULL, NULL, NULL, true FROM conversations WHERE turn % 3 = 0")
def json_lines_scan(spark, sf_dir):
    """JSON lines, a third of them cut short: these are kept and counted, not lost."""
    path = scratch(spark, "json")
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 3 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value")).write.text(path)
    return readers.json_lines(spark, path, "conv_id long, turn long, text string", keep_broken=True).select("conv_id", "turn", "text", F.col("_corrupt").isNotNull().alias("broken"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def split_sink(spark, sf_dir):
    return writers.by_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), scratch(spark, "split"), "lang").select("doc_id", "lang", "n_chars")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS start FROM events WHERE event_id % 2 = 0")
def included_lines(spark, sf_dir):
    path = scratch(spark, "export")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "include").otherwise("exclude").alias("include_status"), F.col("value").alias("start"), F.col("value").alias("end"), F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).alias("adjusted_start"), F.lit(None).cast("double").alias("adjusted_end"))
    writers.export_lines(rows, path)
    return readers.json_lines(spark, path, "event_id long, start double").select("event_id", "start")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def versioned_table(spark, sf_dir):
    path = scratch(spark, "versioned")
    writers.versioned(table(spark, sf_dir, "region"), path, 3, made_by="query")
    return writers.open_versioned(spark, path, 3).select(long(F.col("r_regionkey")).alias("r_regionkey"), "r_name")


@query("SELECT event_id FROM events WHERE event_id % 4 = 0")
def unfinished_work(spark, sf_dir):
    """What has no result, or one of other inputs: three shards hold results, one of them of an older signature."""
    rows = table(spark, sf_dir, "events")
    work = rows.select("event_id", scalars.row_signature(F.col("event_id"), F.col("event_type")).alias("sig"))
    old = rows.filter("event_id % 4 = 0").select("event_id", scalars.row_signature(F.col("event_id"), F.lit("older")).alias("sig"))
    path = scratch(spark, "shards")
    for shard in (work.filter("event_id % 4 = 1"), work.filter("event_id % 4 > 1"), old):
        writers.append_results(shard, path)
    return labels.unfinished(work, spark.read.parquet(path), "event_id", "sig").select("event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id % 4 <> 0")
def valid_results(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    work = rows.select("event_id", scalars.row_signature(F.col("event_id"), F.col("event_type")).alias("sig"))
    shards = work.filter("event_id % 4 <> 0").unionByName(work.filter("event_id % 4 = 1")).unionByName(rows.filter("event_id % 4 = 0").select("event_id", F.lit("older").alias("sig")))
    return labels.valid_results(work, shards, "event_id", "sig").join(rows.select("event_id", "event_type"), "event_id").select("event_id", "event_type")


@query("SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def unreviewed_ids(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("status"))
    return labels.by_status(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id", "unreviewed").select("doc_id")


@query("SELECT user_id, seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events) WHERE seq % 10 = 0")
def journal_faults(spark, sf_dir):
    """Journals of each user whose tenth entries were altered after they were hashed."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", long(F.row_number().over(w)).alias("seq"), "event_type")
    listed = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event_type"))).alias("e"))
    empty = F.array().cast("array<struct<seq:bigint,event_type:string,prev:string,own:string>>")
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["seq"].alias("seq"), x["event_type"].alias("event_type"), F.coalesce(F.try_element_at(acc, F.lit(-1))["own"], F.lit("")).alias("prev"), labels.chain_hash(F.coalesce(F.try_element_at(acc, F.lit(-1))["own"], F.lit("")), x["event_type"]).alias("own"))))
    journal = listed.select("user_id", F.explode(F.aggregate("e", empty, step)).alias("j")).select("user_id", "j.*")
    altered = journal.withColumn("event_type", F.when(F.col("seq") % 10 == 0, "changed").otherwise(F.col("event_type")))
    return labels.broken_links(altered, "seq", "prev", "own", ["event_type"], stream="user_id").select("user_id", "seq")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def table_differences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return guards.difference(rows, rows.filter("doc_id % 5 <> 0")).filter("side = 'missing'").select("doc_id")


@query(f"WITH {_SPANS} SELECT s.event_id FROM spans s WHERE EXISTS (SELECT 1 FROM spans c WHERE c.event_type = 'click' AND c.user_id = s.user_id AND (s.start + s.\"end\") / 2 >= c.start AND (s.start + s.\"end\") / 2 < c.\"end\")")
def scored_utterances(spark, sf_dir):
    """Rows whose midpoint falls in a scored interval."""
    rows = spans(spark, sf_dir)
    scored = intervals.merge(rows.filter("event_type = 'click'").select("user_id", "start", "end"), ["user_id"])
    points = rows.select("user_id", "event_id", ((F.col("start") + F.col("end")) / 2).alias("t"))
    return intervals.point_join(points, scored, ["user_id"], 14400).select("event_id").distinct()


@query(f"""WITH {_SPANS}, e AS (SELECT user_id, start AS t, (event_type = 'click')::INT AS l, (event_type = 'purchase')::INT AS r FROM spans UNION ALL SELECT user_id, "end", -(event_type = 'click')::INT, -(event_type = 'purchase')::INT FROM spans),
g AS (SELECT user_id, t, sum(l) AS l, sum(r) AS r FROM e GROUP BY ALL), c AS (SELECT user_id, t AS start, lead(t) OVER w AS "end", sum(l) OVER w AS l, sum(r) OVER w AS r FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(sum("end" - start), 2) AS seconds FROM c WHERE l > 0 AND r > 0 GROUP BY user_id""")
def common_time(spark, sf_dir):
    rows = spans(spark, sf_dir)
    out = intervals.intersect(rows.filter("event_type = 'click'"), rows.filter("event_type = 'purchase'"), ["user_id"], 14400)
    return out.groupBy("user_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 2).alias("seconds"))


@query(f"WITH t AS (SELECT source, list_distinct({_WORDS}) AS w FROM documents), p AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS term FROM part UNION SELECT 'the' UNION SELECT 'of') SELECT term, count(DISTINCT source) AS meetings FROM p LEFT JOIN t ON list_contains(w, term) GROUP BY term")
def attested_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term")).unionByName(spark.createDataFrame([("the",), ("of",)], "term string"))
    return language.attested(table(spark, sf_dir, "documents"), text.word_tokens(F.col("text")), terms, "source")


@query("""SELECT event_type AS k, sum(n)::BIGINT AS total, count(DISTINCT user_id) AS meetings, sum(CASE WHEN lane = 'a' THEN n ELSE 0 END)::BIGINT AS a, sum(CASE WHEN lane = 'b' THEN n ELSE 0 END)::BIGINT AS b
FROM (SELECT event_type, user_id, 1 AS n, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS lane FROM events) GROUP BY event_type""")
def merged_lanes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.lit(1).cast("long").alias("n"), F.col("user_id").alias("m"), "event_id")
    return matching.merge_lanes({"a": rows.filter("event_id % 2 = 0"), "b": rows.filter("event_id % 2 = 1")}, "k", "n", "m")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'SHORT' WHEN o_orderkey % 8 = 0 THEN 'BACKBONE' WHEN a >= 0.7 AND b >= 0.7 THEN 'DROP' WHEN a <= 0.15 AND b <= 0.15 THEN 'KEEP' WHEN least(a, b) <= 0.35 THEN 'AUDIT' ELSE 'REVIEW' END AS bucket,
  CASE WHEN o_orderkey % 7 = 0 THEN 'empty' WHEN o_orderkey % 6 = 0 THEN 'multi_paragraph' WHEN o_orderkey % 5 = 0 THEN 'meta_marker' WHEN NOT (o_orderkey % 20 / 10) BETWEEN 0.5 AND 1.5 THEN 'length_ratio' WHEN a > 0.5 THEN 'too_far' END AS reason
FROM (SELECT o_orderkey, o_orderkey % 100 / 100 AS a, o_orderkey % 97 / 97 AS b FROM orders)""")
def review_buckets(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b = k % 100 / 100, k % 97 / 97
    out = F.when(k % 7 == 0, "  ").when(k % 6 == 0, "one\n\ntwo").when(k % 5 == 0, "Note: this").otherwise("fine text")
    words = F.greatest(k % 20, F.lit(0))
    reason = classify.post_edit_reason(F.lit("x"), out, a * 10, F.lit(10), F.when(words == 0, 1).otherwise(words))
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", classify.review_bucket(F.when(k % 8 != 0, a), b, k % 9 == 0).alias("bucket"), reason.alias("reason"))


def _slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts that differ by one slip of each kind, of the turns of users in Greek letters."""
    t = F.regexp_replace(greek(F.col("text")), r"[^α-ωa-z ]+", " ")
    words = F.filter(F.split(t, " "), lambda w: F.length(w) > 3)
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), words.alias("w")).filter("size(w) >= 4").withColumn("b", F.array_join("w", " "))
    kind = F.col("doc_id") % 9
    first, rest = F.get("w", F.lit(0)), F.array_join(F.slice("w", F.lit(2), F.size("w")), " ")
    after = (
        F.when(kind == 0, F.col("b")).when(kind == 1, F.concat("b", F.lit("!"))).when(kind == 2, F.concat(F.lit("ά"), F.col("b"))).when(kind == 3, F.concat("b", F.lit(" 12")))
        .when(kind == 4, F.concat(first, rest)).when(kind == 5, rest).when(kind == 6, F.concat(F.lit("ΔΕΗ "), F.col("b"))).when(kind == 7, F.concat(F.left(first, F.lit(3)), F.lit("ξξξ "), rest)).otherwise(F.concat(F.lit("Αθηνα "), rest))
    )
    before = F.when(kind == 2, F.concat(F.lit("α"), F.col("b"))).otherwise(F.col("b"))
    return rows.select("doc_id", kind.alias("kind"), before.alias("before"), after.alias("after"))


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS doc_id, list_filter(string_split(regexp_replace({_GREEK_SQL}, '[^α-ωa-z ]+', ' ', 'g'), ' '), lambda x: length(x) > 3) AS w FROM conversations WHERE role = 'user')
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'no_change' WHEN 1 THEN 'punctuation_capitalization' WHEN 2 THEN 'accent_tonos' WHEN 3 THEN 'number_date' WHEN 4 THEN 'word_boundary' WHEN 5 THEN 'insertion_deletion' WHEN 6 THEN 'acronym_abbreviation'
  WHEN 7 THEN CASE WHEN left(w[1], 3) || 'ξξξ' = w[1] THEN 'no_change' ELSE 'morph_grammar' END ELSE 'named_entity' END AS category FROM w WHERE len(w) >= 4""")
def slip_categories(spark, sf_dir):
    """Each planted slip is told by its category."""
    return _slips(spark, sf_dir).select("doc_id", classify.error_category(F.col("before"), F.col("after")).alias("category"))


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS doc_id, list_filter(string_split(regexp_replace({_GREEK_SQL}, '[^α-ωa-z ]+', ' ', 'g'), ' '), lambda x: length(x) > 3) AS w FROM conversations WHERE role = 'user')
SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 'punctuation_capitalization' WHEN 2 THEN 'accent_tonos' WHEN 4 THEN 'word_boundary' ELSE '' END AS labels FROM w WHERE len(w) >= 4 AND doc_id % 9 < 5""")
def slip_labels(spark, sf_dir):
    """The labels that rules alone are sure of."""
    return _slips(spark, sf_dir).filter("kind < 5").select("doc_id", F.array_join(classify.mechanical_labels(F.col("before"), F.col("after")), ",").alias("labels"))


@query("""WITH RECURSIVE g AS (SELECT lang, source, doc_id, 1 / (1 + abs(n_chars - 2000) / 1000.0) AS s FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY s DESC, doc_id) AS r FROM g) SELECT doc_id, r FROM t WHERE r <= 3""")
def greedy_heads(spark, sf_dir):
    """The only rows that a greedy choice of three can take: the best three of each combination."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (1 / (1 + F.abs(F.col("n_chars") - 2000) / 1000.0)).alias("score"), "lang", "source")
    few = selection.heads(rows, "doc_id", "score", ["lang", "source"], 3)
    place: dict = {}
    out = []
    for r in few:
        place[r["lang"], r["source"]] = place.get((r["lang"], r["source"]), 0) + 1
        out.append((r["doc_id"], place[r["lang"], r["source"]]))
    return spark.createDataFrame(out, "doc_id long, r long")


# --- meeting documents, reports, samples -------------------------------------------------------------------------

def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as one JSON document a meeting, and scanned again."""
    path = scratch(spark, "meetings")
    rows = table(spark, sf_dir, "conversations")
    utterance = F.struct(
        F.when(F.col("turn") % 7 != 6, F.concat_ws("-", "conv_id", "turn")).alias("id"), F.col("text"), F.col("turn").cast("double").alias("startTimestamp"),
        (F.col("turn") + F.when(F.col("turn") % 4 == 3, 0.0).otherwise(0.5)).alias("endTimestamp"), F.when(F.col("role") == "user", F.lit("user")).alias("lastModifiedBy"))
    segment = F.struct(F.concat(F.lit("tag-"), "role").alias("speakerTagId"), F.struct(F.col("role").alias("personId"), F.lit("seat").alias("label")).alias("speakerTag"), F.array(utterance).alias("utterances"))
    people = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(f"Person {k}").alias("name"), F.lit("member").alias("role"), F.lit(None).cast("string").alias("party")) for k in ("user", "assistant")))
    listed = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", segment.alias("s")))), lambda x: x["s"]).alias("transcript"))
    city = F.concat(F.lit("city"), (F.col("conv_id") % 3).cast("string"))
    meeting = F.struct(F.col("conv_id").cast("string").alias("id"), city.alias("cityId"), F.lit("m").alias("name"), F.lit("2025-01-01").alias("dateTime"), F.lit("u").alias("audioUrl"))
    listed.select(meeting.alias("meeting"), F.struct((F.col("conv_id") % 2 == 0).alias("humanReview")).alias("taskStatus"), people.alias("people"), "transcript").write.json(path)
    return spark.read.schema(readers.MEETING).json(path)


_UTTERANCES = """u AS (SELECT 'city' || (conv_id % 3) AS city_id, conv_id::VARCHAR AS meeting_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, conv_id || '-' || turn AS utterance_id, text, role, turn % 4 = 3 AS empty
  FROM conversations WHERE turn % 7 <> 6)"""


@query(f"WITH {_UTTERANCES} SELECT city_id, meeting_id, seq, utterance_id, md5(text) AS text_md5, 'tag-' || role AS speaker_tag, CASE WHEN role IN ('user', 'assistant') THEN 'Person ' || role END AS speaker_name FROM u")
def meeting_utterances(spark, sf_dir):
    out = readers.utterances(_meetings(spark, sf_dir))
    return out.select("city_id", "meeting_id", long(F.col("seq")).alias("seq"), "utterance_id", F.md5("text").alias("text_md5"), "speaker_tag", "speaker_name")


@query(f"WITH {_UTTERANCES} SELECT utterance_id FROM u WHERE role <> 'user' AND NOT empty AND trim(text) <> ''")
def untouched_utterances(spark, sf_dir):
    return readers.never_edited(readers.utterances(_meetings(spark, sf_dir))).select("utterance_id")


@query("SELECT 'city' || (conv_id % 3) AS city_id, conv_id::VARCHAR AS meeting_id, k AS person_id, 'Person ' || k AS name FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['user', 'assistant']) AS k)")
def meeting_people(spark, sf_dir):
    return readers.people(_meetings(spark, sf_dir)).select("city_id", "meeting_id", "person_id", "name")


@query("SELECT 'city' || (conv_id % 3) AS city_id, conv_id::VARCHAR AS meeting_id FROM conversations WHERE conv_id % 2 = 0 GROUP BY ALL")
def reviewed_meetings(spark, sf_dir):
    """Distinct meetings that a person has reviewed."""
    return _meetings(spark, sf_dir).filter("taskStatus.humanReview").select(F.col("meeting.cityId").alias("city_id"), F.col("meeting.id").alias("meeting_id")).distinct()


@query(f"""SELECT item_id::VARCHAR AS item, len(list_distinct({_WORDS}))::BIGINT AS agreed FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 <> 0""")
def common_windows(spark, sf_dir):
    """Benchmark windows for which both providers succeeded, and the tokens that both have."""
    path = scratch(spark, "report")
    said = lambda bad, extra: F.struct(F.when(F.col("item_id") % bad == 0, "failed").otherwise("ok").alias("status"), F.concat_ws(" ", F.array_join("w", " "), F.lit(extra)).alias("hypothesisText"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.word_tokens(F.col("text")).alias("w"))
    item = F.struct(F.col("item_id").cast("string").alias("itemId"), F.create_map(F.lit("a"), said(5, "§first"), F.lit("b"), said(7, "§second")).alias("perProvider"))
    rows.agg(F.collect_list(item).alias("items")).write.json(path)  # one report, as a benchmark run writes it
    items = readers.common_items(readers.report_items(spark, path), ["a", "b"])
    words = lambda p: F.filter(F.split(F.element_at("perProvider", p)["hypothesisText"], " "), lambda t: ~t.startswith("§") & (t != ""))
    return items.select(F.col("itemId").alias("item"), long(F.size(readers.agreed_tokens([words("a"), words("b")]))).alias("agreed"))


@query("""WITH p AS (SELECT doc_id, n_chars / 10000.0 AS s, md5(doc_id || '|5') AS m FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
a AS (SELECT doc_id FROM p WHERE s <= 0.2 ORDER BY m, doc_id LIMIT 30), b AS (SELECT doc_id FROM p WHERE s > 0.2 AND s <= 0.35 ORDER BY m, doc_id LIMIT 10) SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b""")
def two_lane_sample(spark, sf_dir):
    """Rows below a score, and an exploring share above it, none that is labelled already."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 10000).alias("s"))
    return readers.sampled_rows(rows, "doc_id", 40, 5, "s", skip=table(spark, sf_dir, "labels")).select("doc_id")


@query("""WITH a AS (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY md5(concat(doc_id, '|sf')), doc_id LIMIT 20), b AS (SELECT doc_id FROM documents WHERE n_chars > 1500 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY md5(concat(doc_id, '|sl')), doc_id LIMIT 30)
SELECT doc_id, 'f' AS stratum FROM a UNION ALL SELECT doc_id, 'l' FROM b""")
def strata_in_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return selection.strata_union(rows, "doc_id", [("f", F.col("lang") == "fr", 20), ("l", F.col("n_chars") > 1500, 30)], "s").select("doc_id", "stratum")


@query("""WITH RECURSIVE g AS (SELECT source, sum(n_chars)::DOUBLE AS n FROM documents WHERE source IS NOT NULL GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k, sum(n) OVER () AS t FROM g),
p AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS source, 0.0::DOUBLE AS now, false AS taken UNION ALL SELECT o.k, o.source, CASE WHEN now + n <= 0.3 * t THEN now + n ELSE now END, now + n <= 0.3 * t FROM p JOIN o ON o.k = p.k + 1)
SELECT source FROM p WHERE taken""")
def balanced_share(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.sum("n_chars").cast("double").alias("n"))
    return selection.balanced_groups(sums, "source", "n", 0.3)


@query("SELECT c_custkey AS term, min(c_custkey) OVER (PARTITION BY c_custkey // 6) AS family FROM customer")
def term_families(spark, sf_dir):
    """Terms that share an alias, directly or over others: threes share one, and the first of each three shares another with the next three."""
    key = F.col("c_custkey")
    three = F.concat(F.lit("a"), F.floor(key / 3).cast("string"))
    six = F.when(key % 3 == 1, F.concat(F.lit("b"), F.floor(key / 6).cast("string")))
    edges = table(spark, sf_dir, "customer").select(key.alias("term"), F.explode(F.array_compact(F.array(three, six))).alias("alias"))
    return selection.owners(edges, "alias", "term")


@query(f"""WITH {_SPANS}, m0 AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY user_id, event_type ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS b FROM spans),
m1 AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY start, "end", event_id) AS i FROM m0), own AS (SELECT user_id, event_type, min(start) AS s, max("end") AS e FROM m1 GROUP BY user_id, event_type, i),
c AS (SELECT user_id, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS e FROM (SELECT DISTINCT user_id, unnest([s, e]) AS t FROM own)),
a AS (SELECT c.user_id, c.s, c.e, string_agg(DISTINCT o.event_type, '+' ORDER BY o.event_type) AS members FROM c JOIN own o ON o.user_id = c.user_id AND o.s < c.e AND o.e > c.s WHERE c.e IS NOT NULL GROUP BY ALL),
n AS (SELECT *, CASE WHEN lag(members) OVER w = members AND lag(e) OVER w = s THEN 0 ELSE 1 END AS b FROM a WINDOW w AS (PARTITION BY user_id ORDER BY s)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s) AS i FROM n)
SELECT user_id, members, round(min(s), 3) AS start, round(max(e), 3) AS "end" FROM r GROUP BY user_id, members, i""")
def active_members(spark, sf_dir):
    return intervals.active_sets(spans(spark, sf_dir), ["user_id"], "event_type", 14400).select("user_id", "members", *_r("start", "end"))


@query("SELECT event_id FROM (SELECT event_id, user_id, value - 10 AS s, lag(value - 10) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE s < 0 OR s < b")
def disordered_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("pos"), (F.col("value") - 10).alias("start"), (F.col("value") - 5).alias("end"))
    return intervals.invalid_sequences(rows, ["user_id"]).select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND n_chars / 10 > 50")
def exact_cover(spark, sf_dir):
    """What windows own tiles every span, but for those of which the second window is taken away: the third does not begin where the first ends."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0.0).alias("start"), (F.col("n_chars") / 10).alias("end"))
    tiles = intervals.windows(rows, 30, 20)
    return intervals.uncovered(tiles.filter("NOT (doc_id % 3 = 0 AND own_start = 25)"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 'drop' WHEN toxic = 0 THEN 'keep' ELSE 'drop' END AS decision FROM labels")
def release_decisions(spark, sf_dir):
    flagged = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("name"))).when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "labels").select("doc_id", language.final_decision(F.when(F.col("toxic") == 0, "safe").otherwise("unsure"), flagged, found).alias("decision"))


@query("SELECT lr, rank, lr * rank AS score, round(lr * rank - 12, 9)::DOUBLE AS delta, rank % 3 <= 1 AS eligible FROM (SELECT unnest([1.0, 2.0, 4.0])::DOUBLE AS lr) a, (SELECT unnest([4, 8, 16])::BIGINT AS rank) b")
def setting_board(spark, sf_dir):
    """All combinations of settings as a leaderboard; those that regress too far are not eligible."""
    from .experiments import grid, leaderboard

    runs = grid(spark, lr=[1.0, 2.0, 4.0], rank=[4, 8, 16]).select("lr", long(F.col("rank")).alias("rank")).withColumns({"score": F.col("lr") * F.col("rank"), "worse": (F.col("rank") % 3).cast("double")})
    return leaderboard(runs, "score", "worse", 12.0, 1.0).select("lr", "rank", "score", "delta", "eligible")


@query(f"""WITH {_SPANS}, k AS (SELECT event_id % 4 AS shape, event_id FROM events)
SELECT event_id, CASE shape WHEN 0 THEN 'ok' WHEN 1 THEN 'align_failed' WHEN 2 THEN 'suspect_cut_start' ELSE 'suspect_bleed_in' END AS status, round(CASE shape WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 1.4 END, 6)::DOUBLE AS start_off, round(CASE shape WHEN 0 THEN 3.5 WHEN 1 THEN 3.5 WHEN 2 THEN 3.5 ELSE 3.5 END, 6)::DOUBLE AS end_off FROM k""")
def clip_boundaries(spark, sf_dir):
    """Clips of four shapes: sound, without words, cut at the start, with speech before the first word."""
    shape = F.col("event_id") % 4
    word = lambda a: F.array(F.struct(F.lit("a").alias("text"), F.lit(a).alias("start"), F.lit(3.4).alias("end"), F.lit(0.9).alias("score")))
    none, quiet = F.array().cast("array<struct<text:string,start:double,end:double,score:double>>"), F.array().cast("array<struct<start:double,end:double>>")
    words = F.when(shape == 0, word(0.6)).when(shape == 1, none).when(shape == 2, word(0.1)).otherwise(word(1.5))
    speech = F.when(shape == 3, F.array(F.struct(F.lit(0.6).alias("start"), F.lit(1.4).alias("end")))).otherwise(quiet)
    rows = table(spark, sf_dir, "events").select("event_id", words.alias("w"), speech.alias("v"))
    rows = rows.select("event_id", classify.boundary(F.col("w"), F.col("v"), F.lit(3.0), F.lit(4.0)).alias("b"))
    return rows.select("event_id", "b.status", F.round("b.start_off", 6).alias("start_off"), F.round("b.end_off", 6).alias("end_off"))


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS utterance, {_WORDS} AS w FROM conversations WHERE role = 'user' AND len({_WORDS}) >= 3)
SELECT utterance, len(w) + CASE WHEN utterance % 3 = 1 THEN 0 ELSE 1 END AS n, CASE utterance % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 1 END::BIGINT AS errors, utterance % 3 <> 1 AS first_kept, utterance % 3 <> 0 AS last_kept, utterance % 3 = 0 AS lost FROM w""")
def edge_losses(spark, sf_dir):
    """A turn and what a system makes of it: two words more in front and the last one lost, the first one replaced, or one more behind."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance"), text.word_tokens(F.col("text")).alias("w")).filter("size(w) >= 3")
    kind = F.col("utterance") % 3
    mark = lambda *xs: F.array(*map(F.lit, xs))
    rest = F.slice("w", F.lit(2), F.size("w"))
    ref = F.when(kind == 1, F.col("w")).otherwise(F.concat("w", mark("§end")))
    hyp = F.when(kind == 0, F.concat(mark("§a", "§b"), F.col("w"))).when(kind == 1, F.concat(mark("§first"), rest)).otherwise(F.concat("w", mark("§end", "§more")))
    ops = rows.select("utterance", "w", F.size(ref).alias("n"), alignment.align_ops(ref, hyp).alias("o"))
    counts = alignment.op_counts(F.col("o"))
    flags = alignment.edge_flags(F.col("o"))
    return ops.select("utterance", long(F.col("n")).alias("n"), (counts["s"] + counts["d"] + counts["i"]).alias("errors"), (~flags["first"]).alias("first_kept"), (~flags["last"]).alias("last_kept"), F.array_contains(alignment.deleted_places(F.col("o")), F.col("n") - 1).alias("lost"))


# --- streams -----------------------------------------------------------------------------------------------------

def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read_events(spark, sf_dir, glob="events.parquet*")


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_windows(spark, sf_dir):
    """The events as a stream, to the end: windows as ``tumbling_windows`` has them."""
    out = streams.to_table(streams.windowed(_event_stream(spark, sf_dir), "6 hours", late="1000 days"), scratch(spark, "stream"), "complete")
    return out.select("w_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id FROM events GROUP BY event_id")
def streamed_distinct(spark, sf_dir):
    """A stream in which each event comes twice, each once."""
    twice = _event_stream(spark, sf_dir).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    return streams.to_table(streams.recent_distinct(twice, "event_id", "1000 days"), scratch(spark, "stream")).select("event_id")


@query("SELECT user_id::VARCHAR AS user_id, max(event_id) AS last_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def streamed_labels(spark, sf_dir):
    """Labels as state: each event sets its user's status."""
    patches = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.col("event_id").alias("id"), F.create_map(F.lit("status"), F.col("event_type")).alias("patch"))
    out = streams.to_table(streams.label_state(patches, "user_id"), scratch(spark, "stream"), "update")
    newest = out.groupBy("user_id").agg(F.max("last_id").alias("last_id"), F.max_by("label", "last_id").alias("label"))
    return newest.select("user_id", "last_id", F.get_json_object("label", "$.status").alias("status"))


# --- cuts, votes and shards --------------------------------------------------------------------------------------

@query("""WITH RECURSIVE n AS (SELECT doc_id, n_chars / 15e0 AS d, list_transform(range(1, greatest(2, floor(n_chars / 15e0 / 7)::BIGINT + 1)), lambda k: {'a': 7e0 * k, 'b': 7e0 * k + CASE WHEN k % 5 = 0 THEN 5.5e0 WHEN k % 3 = 0 THEN 0.3e0 ELSE 0.6e0 END}) AS q FROM documents),
e AS (SELECT doc_id, d, q, 0e0 AS pos, 0::BIGINT AS i FROM n UNION ALL SELECT doc_id, d, q, coalesce(list_extract(list_reverse_sort(list_filter(c, lambda x: x.l >= 5)), 1).cut, list_extract(list_reverse_sort(list_filter(c, lambda x: x.l >= 0.5)), 1).cut, d), i + 1 FROM (
  SELECT doc_id, d, q, i, list_filter(list_transform(q, lambda s: {'l': round(s.b - s.a, 9), 'e': -s.a, 'cut': CASE WHEN s.a >= pos AND s.a <= least(d, pos + 30) AND least((s.a + s.b) / 2, least(d, pos + 30)) > pos
    THEN least((s.a + s.b) / 2, least(d, pos + 30)) END}), lambda x: x.cut IS NOT NULL) AS c FROM e WHERE d - pos > 30 + 1e-7))
SELECT doc_id, i AS piece, round(pos, 6) AS start, round(coalesce(lead(pos) OVER w, d), 6) AS "end" FROM e WHERE d - pos > 1e-7 OR i = 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def silence_cuts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15).alias("d"))
    last = F.greatest(F.lit(1), F.floor(F.col("d") / 7).cast("int"))
    quiet = F.transform(F.sequence(F.lit(1), last), lambda k: F.struct((k * 7.0).alias("start"), (k * 7.0 + F.when(k % 5 == 0, 5.5).when(k % 3 == 0, 0.3).otherwise(0.6)).alias("end")))
    pieces = matching.cut_longest(F.col("d"), quiet)
    return rows.select("doc_id", F.posexplode(pieces).alias("piece", "s")).select("doc_id", long(F.col("piece")).alias("piece"), F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"))


@query(f"SELECT DISTINCT w AS word, w AS voted FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) WHERE length(w) > 3")
def letter_votes(spark, sf_dir):
    """Two of three spellings of every word have a letter too many, at neighbouring places that differ from word to word; the vote is the word."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.word_tokens(F.col("text"))).alias("w")).filter("length(w) > 3").distinct()
    more = lambda at: F.concat(F.left("w", at), F.lit("§"), F.substring(F.col("w"), at + 1, F.length("w")))
    place = F.pmod(F.crc32(F.col("w").cast("binary")), F.length("w")).cast("int")
    return words.select(F.col("w").alias("word"), alignment.letter_vote(F.col("w"), more(place), more(place + 1)).alias("voted"))


@query(f"SELECT utterance, len(list_filter(range(0, len(w)), lambda i: (i + utterance) % 9 = 3))::INT AS errors FROM (SELECT conv_id * 1000 + turn AS utterance, {_WORDS} AS w FROM conversations WHERE role = 'user') WHERE len(w) >= 2")
def nbest_oracle(spark, sf_dir):
    """A turn in two chunks with three hypotheses each, of which one is right but for words that are wrong in all of them."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance"), text.word_tokens(F.col("text")).alias("w")).filter("size(w) >= 2")
    bad = F.transform("w", lambda t, i: F.when((i + F.col("utterance")) % 9 == 3, F.lit("§wrong")).otherwise(t))
    half = F.floor(F.size("w") / 2).cast("int")
    left, right = F.slice(bad, F.lit(1), half), F.slice(bad, half + 1, F.size("w"))
    odd = F.array(F.lit("§x"), F.lit("§y"))
    chunks = F.array(F.array(odd, left, F.slice(left, 1, 3)), F.array(F.concat(right, odd), odd, right))
    return rows.select("utterance", alignment.nbest_errors_udf(chunks, F.col("w")).alias("errors"))


@query("SELECT c_custkey, c_custkey % 4 < 2 AS same FROM customer")
def surname_cases(spark, sf_dir):
    pick = lambda *w: F.get(F.array(*map(F.lit, w)), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", review.other_case_of(pick("παπαδοπουλου", "νικολαου", "νικολαου", "ου"), pick("παπαδακησ", "νικολαοσ", "γεωργιοσ", "ουρανοσ")).alias("same"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'alignment_artifact' WHEN event_id % 7 = 0 THEN 'numeric_identifier' WHEN event_id % 5 = 0 THEN 'protocol_legal' WHEN event_id % 3 = 0 THEN 'named_entity'
  WHEN event_id % 4 = 0 THEN 'no_target' WHEN event_id % 4 = 1 THEN 'orthography_homophone' WHEN event_id % 4 = 2 THEN 'morphology_suffix_neighbor' WHEN event_id % 13 = 0 THEN 'function_word_pair' ELSE 'different_content_word' END AS class FROM events""")
def reader_classes(spark, sf_dir):
    n = F.col("event_id")
    relation = F.when(n % 11 == 0, "alignment_artifact").otherwise(F.get(F.array(*map(F.lit, ("no_target", "phonemic_key_equivalent", "surface_suffix_neighbor", "unrelated_substitution"))), (n % 4).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", review.reader_class(relation, n % 7 == 0, n % 5 == 0, n % 3 == 0, n % 13 == 0).alias("class"))


@query("SELECT count(*) AS n, count(*) AS ids, sum(n_chars)::BIGINT AS chars FROM documents")
def shard_scan(spark, sf_dir):
    """Two columns of all shards, each row with an id of its own."""
    rows = readers.shard_rows(spark, f"{sf_dir}/documents.parquet", {"id": "doc_id", "size": F.col("n_chars")})
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.sum("size").alias("chars"))


# --- the staged build --------------------------------------------------------------------------------------------

@query(f"""WITH RECURSIVE k AS (SELECT d.doc_id, source, lang, n_chars, {_CANONICAL} AS c FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) <> 0 AND n_chars >= 200
  AND NOT EXISTS (SELECT 1 FROM labels b JOIN documents e USING (doc_id) WHERE b.toxic = 1 AND e.source = d.source AND e.lang = d.lang AND e.doc_id % 9 = 0)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n_chars, doc_id) AS r FROM k) WHERE r = 1),
h AS (SELECT source, md5(source) AS m, 0 AS i, 0::BIGINT AS v FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT source, m, i + 1, (v * 16 + strpos('0123456789abcdef', substr(m, i + 1, 1)) - 1) % 5 FROM h WHERE i < 32)
SELECT doc_id, CASE WHEN v = 0 THEN 'eval' ELSE 'train' END AS split, substr(sha1(doc_id || '|' || n_chars || '|' || coalesce(f.source, '')), 1, 16) AS row_sig, CASE WHEN doc_id % 3 = 0 THEN 'ok' END AS status
FROM f LEFT JOIN h ON h.source = f.source AND h.i = 32""")
def staged_dataset(spark, sf_dir):
    """Two sources as one table, guarded, denied, deduplicated and split; boundaries are joined where they were made of the present row."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("c", F.md5(text.canonical(F.col("text"))))
    sources = [docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1").drop("toxic")]
    toxic = table(spark, sf_dir, "documents").filter("doc_id % 9 = 0").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("source", "lang")
    rows = dataset.stage_rows(sources, {"low": F.col("quality") == 0, "short": F.col("n_chars") < 200}, toxic, ["source", "lang"], ["c"], ["n_chars", "doc_id"], F.col("source"), 0.2)
    work = dataset.stage_work(rows, "doc_id", "doc_id", "n_chars", "source")
    made = work.filter("doc_id % 3 = 0").withColumn("status", F.lit("ok"))
    stale = work.filter("doc_id % 3 = 1").select("doc_id", F.lit("of another row").alias("row_sig"), F.lit("old").alias("status"))
    out = dataset.stage_finalize(rows, "doc_id", work, made.unionByName(stale))
    return out.join(work, "doc_id").select("doc_id", "split", "row_sig", "status")


@query("SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, round(avg(score), 9) AS mean_score, round(max(shift), 9) AS max_shift FROM (SELECT event_type AS status, value / 100 AS score, greatest(0.1, (event_id % 7) / 10) AS shift FROM events) GROUP BY status")
def boundary_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), (F.col("value") / 100).alias("score"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(1.1).alias("c"), (2 + (F.col("event_id") % 7) / 10).alias("d"))
    out = dataset.boundary_report(rows, "status", "score", "c", "d", "a", "b")
    return out.select("status", "n", *(F.round(c, 9).alias(c) for c in ("share", "mean_score", "max_shift")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/new/place/' ELSE '/other/' END || event_type AS path FROM events")
def relocated_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "/old/").otherwise("/other/"), "event_type").alias("path"))
    return dataset.relocated(rows, "path", "/old/", "/new/place/")


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS utterance, {_WORDS} AS w FROM conversations WHERE role = 'user'), x AS (SELECT utterance, w, unnest(range(1, len(w) + 1)) AS i FROM t)
SELECT utterance, (i + 5) // 6 AS cell, CASE WHEN (utterance + (i + 5) // 6) % 3 = 0 THEN 1 ELSE 0 END AS winner, string_agg(w[i], ' ' ORDER BY i) AS words FROM x GROUP BY utterance, (i + 5) // 6""")
def cell_votes(spark, sf_dir):
    """Three streams of words in cells of six seconds: in each cell another one has words of its own; the first of the two that agree wins."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance"), F.posexplode(text.word_tokens(F.col("text"))).alias("pos", "w"))
    odd = (F.col("utterance") + F.floor(F.col("pos") / 6) + 1) % 3
    said = lambda n: F.struct(F.lit(n).alias("stream"), F.when(odd == n, F.concat(F.lit("§"), "w")).otherwise(F.col("w")).alias("token"))
    tokens = rows.select("utterance", "pos", F.col("pos").cast("double").alias("t"), F.explode(F.array(*map(said, range(3)))).alias("x")).select("utterance", "pos", "t", "x.*")
    cuts = rows.filter("pos % 6 = 0").select("utterance", F.col("pos").cast("double").alias("t"))
    out = fusion.partition_vote(tokens, cuts, ["utterance"])
    return out.select("utterance", long(F.col("cell")).alias("cell"), "winner", F.array_join("words", " ").alias("words"))
