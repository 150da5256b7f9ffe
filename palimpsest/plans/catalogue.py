"""Named queries over the driver's tables, and the SQL that states each one independently.

The tables stand in for transcripts: turns of ``conversations`` for edits of a chain, ``events`` with a length for
speech segments of a user, ``documents`` for utterances of a source (meeting) and language (city),
``labels`` for verdicts, ``lineitem`` and ``orders`` for volume.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import distance, scalars, text
from palimpsest.operators import alignment, chains, classify, guards, intervals, labels, language, matching, selection, statistics
from palimpsest.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(x: Column) -> Column:
    return x.cast("long")


# --- edit chains -------------------------------------------------------------------------------------------------

_EDITS = """edits AS (
  SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before_text, text AS after_text, role AS edited_by
  FROM conversations)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lag("text").over(w), F.lit("")).alias("before_text"), F.col("text").alias("after_text"), F.col("role").alias("edited_by"))


@query(f"""WITH {_EDITS}
SELECT conv_id, arg_min(before_text, turn) AS input_raw, arg_max(after_text, turn) AS gold_final, string_agg(edited_by, ',' ORDER BY turn) AS editors,
  bool_or(edited_by = 'user') AS has_task, bool_or(edited_by = 'assistant') AS has_user,
  coalesce(min(turn) FILTER (WHERE edited_by = 'user') < max(turn) FILTER (WHERE edited_by = 'assistant'), false) AS task_then_user, count(*) AS n_edits, true AS links_ok
FROM edits GROUP BY conv_id""")
def chain_build(spark, sf_dir):
    out = chains.reconstruct(edits(spark, sf_dir), "conv_id", ("turn",), machine="user", human="assistant")
    return out.withColumn("editors", F.array_join("edited_by_seq", ",")).drop("edited_by_seq")


@query(f"""WITH {_EDITS}, c AS (SELECT conv_id, bool_or(edited_by = 'user') AS t, bool_or(edited_by = 'assistant') AS u,
  coalesce(min(turn) FILTER (WHERE edited_by = 'user') < max(turn) FILTER (WHERE edited_by = 'assistant'), false) AS tu FROM edits GROUP BY conv_id)
SELECT CASE WHEN tu THEN 'task_then_user' WHEN t AND u THEN 'task_plus_user' WHEN u THEN 'user_only' ELSE 'task_only' END AS edit_class, count(*) AS n FROM c GROUP BY 1""")
def chain_role_flags(spark, sf_dir):
    out = chains.reconstruct(edits(spark, sf_dir), "conv_id", ("turn",), machine="user", human="assistant")
    return out.groupBy(chains.edit_class(F.col("has_task"), F.col("has_user"), F.col("task_then_user")).alias("edit_class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EDITS}, x AS (SELECT *, lag(after_text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM edits)
SELECT conv_id, count(*) AS n, arg_max(edited_by, turn) AS edited_by, bool_and(p IS NULL OR p = before_text) AS consistent FROM x GROUP BY conv_id""")
def edit_groups(spark, sf_dir):
    out = chains.groups(edits(spark, sf_dir), "conv_id", ["turn"], ["turn", "before_text", "after_text", "edited_by"], ["edited_by"])
    return out.select("conv_id", long(F.size("edits")).alias("n"), "edited_by", "consistent")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    return chains.first_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def first_known_per_key(spark, sf_dir):
    return chains.first_known(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type", "value"])


@query("SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS event_type FROM events")
def preferred_value(spark, sf_dir):
    return chains.preferred_value(table(spark, sf_dir, "events"), ["user_id"], "event_type", [F.desc("value"), "event_id"]).select("event_id", "event_type")


# --- text --------------------------------------------------------------------------------------------------------

_CANON = "trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_CANON}) AS canonical_md5, length({_CANON})::BIGINT AS chars FROM documents")
def text_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.canonical(F.col("text")).alias("c"))
    return rows.select("doc_id", F.md5("c").alias("canonical_md5"), long(F.length("c")).alias("chars"))


@query("""SELECT doc_id, len(t)::BIGINT AS tokens, len(list_distinct(t))::BIGINT AS distinct_tokens FROM (
  SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+') AS t FROM documents)""")
def text_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", long(F.size("t")).alias("tokens"), long(F.size(F.array_distinct("t"))).alias("distinct_tokens"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+') AS t FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(t) - 3, 1))) AS i, t FROM w)
SELECT w.doc_id, coalesce(max(n) >= 3, false) AS repeated FROM w LEFT JOIN (SELECT doc_id, array_to_string(t[i:i + 4], ' ') AS g, count(*) AS n FROM g GROUP BY ALL) x ON x.doc_id = w.doc_id GROUP BY w.doc_id""")
def repeated_fivegrams(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", text.repeated_ngram(F.col("t")).alias("repeated"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS chars FROM pages")
def tag_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", long(F.length(text.strip_tags(F.col("html")))).alias("chars"))


@query("""SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS terms FROM (SELECT doc_id, list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda z: list_position(x, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered
  FROM (SELECT doc_id, regexp_extract_all(text, '\\p{Lu}[\\p{L}\\p{N}]+(?:\\s+\\p{Lu}[\\p{L}\\p{N}]+)*') AS x FROM documents))""")
def proper_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.proper_terms(F.col("text")), "|").alias("terms"))


@query("SELECT doc_id, regexp_matches(trim(text), '^\\p{Lu}(?s:.*)[.!?;·…]$') AS complete FROM documents")
def sentence_check(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.complete_sentence(F.col("text")).alias("complete"))


@query(f"""WITH {_EDITS} SELECT conv_id, turn,
  CASE WHEN trim(regexp_replace(before_text, '\\s+', ' ', 'g')) = '' AND trim(regexp_replace(after_text, '\\s+', ' ', 'g')) = '' THEN 'noop_edit'
    WHEN trim(regexp_replace(before_text, '\\s+', ' ', 'g')) = '' THEN 'empty_before' WHEN trim(regexp_replace(after_text, '\\s+', ' ', 'g')) = '' THEN 'empty_after'
    WHEN before_text = after_text THEN 'noop_edit' WHEN trim(regexp_replace(before_text, '\\s+', ' ', 'g')) = trim(regexp_replace(after_text, '\\s+', ' ', 'g')) THEN 'whitespace_only'
    WHEN turn % 3 = 2 THEN 'reversed_timestamps' WHEN contains(before_text, chr(10)) OR contains(after_text, chr(10)) THEN 'multiline_text' ELSE 'clean' END AS category
FROM edits""")
def ingest_classify(spark, sf_dir):
    end = F.when(F.col("turn") % 3 == 2, F.col("turn") - 1).otherwise(F.col("turn") + 1).cast("string")
    row = classify.ingest(F.col("before_text"), F.col("after_text"), F.col("turn").cast("string"), end)
    return edits(spark, sf_dir).select("conv_id", "turn", row["ingest_category"].alias("category"))


_CAPS = "Α-ΡΣ-ΫΆΈ-ΊΌΎΏ"


def _form_sql(side: str, x: str) -> str:
    """The forms of one side of an edit that its category is told by."""
    canon = f"trim(regexp_replace(translate(strip_accents(lower({x})), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
    return f"""trim({x}) AS {side}bare, {canon} AS {side}canon, trim(regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS {side}flat, list_filter(string_split({canon}, ' '), lambda t: t <> '') AS {side}words,
  regexp_extract_all({x}, '[0-9]+') AS {side}digits, regexp_extract_all({x}, '[{_CAPS}]{{2,}}') AS {side}caps, list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_matches(t, '^[{_CAPS}].')) AS {side}names"""


def _beyond_sql(a: str, b: str) -> str:
    """Words of ``a`` that it has more often than ``b``, the later ones of each."""
    return f"list_transform(list_filter(range(1, len({a}) + 1), lambda i: len(list_filter({a}[1:i], lambda y: y = {a}[i])) > len(list_filter({b}, lambda y: y = {a}[i]))), lambda i: {a}[i])"


def _sound_sql(words: str) -> str:
    steps = "w"
    for x, y in (("αι", "ε"), ("ει", "ι"), ("οι", "ι"), ("υι", "ι"), ("[ηιυ]", "ι"), ("ω", "ο")):
        steps = f"regexp_replace({steps}, '{x}', '{y}', 'g')"
    return f"list_transform(list_transform({words}, lambda w: {steps}), lambda v: array_to_string(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i > 1 AND substr(v, i, 1) = substr(v, i - 1, 1) THEN '' ELSE substr(v, i, 1) END), ''))"


_CATEGORIES = f"""{_EDITS}, forms AS (SELECT *, {_form_sql('b_', 'before_text')}, {_form_sql('a_', 'after_text')} FROM edits),
beyond AS (SELECT *, {_beyond_sql('b_words', 'a_words')} AS b_only, {_beyond_sql('a_words', 'b_words')} AS a_only FROM forms),
categories AS (SELECT *, CASE
  WHEN b_canon = a_canon THEN CASE WHEN b_bare = a_bare THEN 'no_change' WHEN b_flat = a_flat THEN 'punctuation_capitalization' WHEN strip_accents(b_flat) = strip_accents(a_flat) THEN 'accent_tonos' WHEN translate(b_flat, 'ς', 'σ') = translate(a_flat, 'ς', 'σ') THEN 'final_sigma' ELSE 'accent_tonos' END
  WHEN b_digits <> a_digits THEN 'number_date' WHEN len(list_filter(a_caps, lambda x: NOT list_contains(b_caps, x))) > 0 THEN 'acronym_abbreviation' WHEN replace(b_canon, ' ', '') = replace(a_canon, ' ', '') THEN 'word_boundary'
  WHEN len(list_filter(a_names, lambda x: NOT list_contains(b_names, x))) > 0 THEN 'named_entity' WHEN len(a_words) <> len(b_words) AND (len(b_only) = 0 OR len(a_only) = 0) THEN 'insertion_deletion'
  WHEN len(b_only) > 0 AND len(b_only) = len(a_only) AND {_sound_sql('b_only')} = {_sound_sql('a_only')} THEN 'homophone'
  WHEN len(b_only) > 0 AND len(b_only) = len(a_only) AND list_transform(b_only, lambda w: left(w, 3)) = list_transform(a_only, lambda w: left(w, 3)) THEN 'morph_grammar' ELSE 'other_lexical' END AS category FROM beyond)"""


@query(f"WITH {_CATEGORIES} SELECT conv_id, turn, category FROM categories")
def error_categorise(spark, sf_dir):
    return edits(spark, sf_dir).select("conv_id", "turn", classify.error_category(F.col("before_text"), F.col("after_text")).alias("category"))


@query()
def mechanical_labels(spark, sf_dir):
    return edits(spark, sf_dir).select("conv_id", "turn", F.array_join(classify.mechanical_labels(F.col("before_text"), F.col("after_text")), ",").alias("labels"))


@query("""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}') AS email, regexp_matches(text, '\\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\\b') AS iban FROM documents""")
def pii_structured(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", language.personal_data(F.col("text")).alias("k"))
    return rows.select("doc_id", F.array_contains("k", "email").alias("email"), F.array_contains("k", "iban").alias("iban"))


# --- guards, joins and sets --------------------------------------------------------------------------------------

@query("""WITH x AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason
  FROM documents LEFT JOIN labels USING (doc_id)) SELECT reason, count(*) AS n FROM x GROUP BY reason""")
def guard_chain_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return guards.drop_counts(rows, {"toxic": F.col("toxic") == 1, "low_quality": F.col("quality") == 0, "short": F.col("n_chars") < 200, "language": F.col("lang") != "en"})


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents e USING (doc_id) WHERE l.toxic = 1 AND e.source = d.source AND e.lang = d.lang)")
def denylist_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bad = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("source", "lang")
    return guards.deny(docs, bad, ["source", "lang"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def heldout_semi(spark, sf_dir):
    return guards.allow(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM (SELECT doc_id, 'toxic' AS reason FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'low' FROM labels WHERE quality = 0) GROUP BY doc_id")
def exclusion_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return guards.reasons_by_key({"toxic": rows.filter("toxic = 1"), "low": rows.filter("quality = 0")}, ["doc_id"]).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return guards.duplicates(table(spark, sf_dir, "documents"), ["source", "lang"])


@query("SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def conflicting_values(spark, sf_dir):
    return guards.conflicts(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def relational_division(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return guards.divided_by(rows, rows.select("event_type"), "user_id", "event_type")


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_CANON} ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r = 1""")
def span_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("c", F.md5(text.canonical(F.col("text"))))
    return chains.first_per_key(rows, ["c"], ["n_chars", "doc_id"]).select("doc_id")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click'), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY user_id) AS n FROM events WHERE event_type = 'purchase')
SELECT a.event_id FROM a JOIN b ON a.user_id = b.user_id AND a.n = b.n""")
def multiset_semijoin(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return guards.multiset_semijoin(rows.filter("event_type = 'click'"), rows.filter("event_type = 'purchase'"), ["user_id"], ["event_id"]).select("event_id")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT d.doc_id, coalesce(quality::BIGINT, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_with_fallback(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(long(F.col("quality")), F.lit(-1).cast("long")).alias("quality"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT lang, n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang, n_chars FROM documents WHERE doc_id % 2 = 1) GROUP BY lang")
def union_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.filter("doc_id % 2 = 0").unionByName(rows.filter("doc_id % 2 = 1").drop("text"), allowMissingColumns=True).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+')) AS w FROM documents)
SELECT a.doc_id, CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 9) END AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def token_jaccard(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.word_tokens(F.col("text"))).alias("w"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return rows.join(after, "doc_id").select("doc_id", F.round(distance.jaccard(F.col("w"), F.col("v")), 9).alias("jaccard"))


# --- aggregations and statistics ---------------------------------------------------------------------------------

@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def grouping_stats(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("palimpsest_documents")
    return spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM palimpsest_documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 9) AS share FROM events GROUP BY user_id")
def edit_fraction(spark, sf_dir):
    return _shares(spark, sf_dir)


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return out.withColumn("share", F.round(F.col("clicks") / F.col("n"), 9))


_SHARE = "s AS (SELECT user_id, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 9) AS share FROM events GROUP BY user_id)"


@query(f"WITH {_SHARE} SELECT cutoff, count(*) FILTER (WHERE share >= cutoff) AS kept, count(*) FILTER (WHERE share < cutoff) AS dropped FROM s, (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS cutoff) GROUP BY cutoff")
def threshold_sweep(spark, sf_dir):
    return statistics.threshold_sweep(_shares(spark, sf_dir), "share", [0.05, 0.1, 0.2, 0.3, 0.5])


@query(f"WITH {_SHARE} SELECT (floor(share * 100 / 5) * 5)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1")
def histogram5(spark, sf_dir):
    return statistics.histogram(_shares(spark, sf_dir), [], F.col("share"))


@query("""SELECT event_type, max(CASE WHEN r = least(n - 1, floor(0.1 * n)) THEN value END) AS p10, max(CASE WHEN r = least(n - 1, floor(0.5 * n)) THEN value END) AS p50, max(CASE WHEN r = least(n - 1, floor(0.9 * n)) THEN value END) AS p90
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type""")
def order_quantiles(spark, sf_dir):
    return statistics.order_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') >= 5")
def eligible_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    return rows.filter("p >= 5").drop("p")


@query("SELECT source, sum(toxic)::BIGINT AS errors, count(*) AS n, round(sum(toxic) / count(*), 9) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def micro_rates(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).groupBy("source").agg(F.sum("toxic").alias("errors"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rate", F.round(F.col("errors") / F.col("n"), 9))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.withColumns({"toxic": long(F.col("toxic")), "low": 1 - long(F.col("quality")), "one": F.lit(1).cast("long")})


@query("""WITH g AS (SELECT source, sum(toxic - (1 - quality)) AS d, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source), t AS (SELECT sum(d) AS d, sum(n) AS n FROM g)
SELECT source, round(g.d / g.n, 9) AS own, round((t.d - g.d) / (t.n - g.n), 9) AS without, round(t.d / t.n, 9) AS delta FROM g, t""")
def loo_delta(spark, sf_dir):
    out = statistics.leave_one_out(_verdicts(spark, sf_dir), "source", "toxic", "low", "one")
    return out.select("source", *(F.round(c, 9).alias(c) for c in ("own", "without", "delta")))


@query("SELECT source, round(abs(g) / sum(abs(g)) OVER (), 9) AS share FROM (SELECT source, sum(n_chars) AS g FROM documents GROUP BY source) ORDER BY abs(g) DESC, source DESC LIMIT 1")
def domination(spark, sf_dir):
    return statistics.domination(table(spark, sf_dir, "documents"), "source", "n_chars").select("source", F.round("share", 9).alias("share"))


@query("""WITH x AS (SELECT lang, n_chars, toxic, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id))
SELECT lang, round((sum(r) FILTER (WHERE toxic = 1) - sum(toxic) * (sum(toxic) + 1) / 2) / nullif(sum(toxic) * (count(*) - sum(toxic)), 0), 9) AS auroc FROM x GROUP BY lang""")
def auroc(spark, sf_dir):
    return statistics.auroc(_verdicts(spark, sf_dir), ["lang"], "n_chars", F.col("toxic") == 1).select("lang", F.round("auroc", 9).alias("auroc"))


@query("""WITH g AS (SELECT lang, n_chars, count(*) AS n, sum(toxic) AS pos FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
c AS (SELECT lang, pos, sum(pos) OVER w / sum(n) OVER w AS precision FROM g WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC))
SELECT lang, round(sum(precision * pos) / nullif(sum(pos), 0), 9) AS average_precision FROM c GROUP BY lang""")
def average_precision(spark, sf_dir):
    return statistics.average_precision(_verdicts(spark, sf_dir), ["lang"], "n_chars", F.col("toxic") == 1).select("lang", F.round("average_precision", 9).alias("average_precision"))


@query("""WITH x AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS a,
  rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS b FROM events)
SELECT event_type, round(corr(a, b), 7) AS spearman FROM x GROUP BY event_type""")
def midranks_spearman(spark, sf_dir):
    return statistics.spearman(table(spark, sf_dir, "events"), ["event_type"], "value", "user_id").select("event_type", F.round("spearman", 7).alias("spearman"))


@query("""WITH g AS (SELECT source, sum(toxic)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9) AS low,
  round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9) AS high FROM g""")
def wilson(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).groupBy("source").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n")).withColumn("w", scalars.wilson(F.col("k"), F.col("n")))
    return rows.select("source", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


_P = "p AS (SELECT source, round((1 + sum(n_chars) % 97) / 2000.0, 9)::DOUBLE AS p FROM documents GROUP BY source)"


def _pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round((1 + F.sum("n_chars") % 97) / 2000.0, 9).alias("p"))


@query(f"""WITH {_P}, i AS (SELECT *, row_number() OVER (ORDER BY p, source) AS i, count(*) OVER () AS m FROM p)
SELECT source, p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i), 9) AS adjusted FROM i""")
def holm(spark, sf_dir):
    return statistics.holm(_pvalues(spark, sf_dir), "source").withColumn("adjusted", F.round("adjusted", 9))


@query(f"""WITH {_P}, i AS (SELECT *, row_number() OVER (ORDER BY p, source) AS i, count(*) OVER () AS m FROM p)
SELECT source, p, round(min(least(1.0, m * p / i)) OVER (ORDER BY i DESC), 9) AS adjusted FROM i""")
def benjamini_hochberg(spark, sf_dir):
    return statistics.benjamini_hochberg(_pvalues(spark, sf_dir), "source").withColumn("adjusted", F.round("adjusted", 9))


@query("SELECT (value >= 10)::BIGINT + (value >= 50)::BIGINT + (value >= 90)::BIGINT AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS wrong FROM events GROUP BY 1")
def bucket_rates(spark, sf_dir):
    out = statistics.bucket_rates(table(spark, sf_dir, "events"), "value", [10, 50, 90], F.col("event_type") == "error")
    return out.select(long(F.col("bucket")).alias("bucket"), "n", "wrong")


@query("SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) <= greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.1)) AS bottom FROM documents")
def bottom_decile(spark, sf_dir):
    return statistics.bottom_share(table(spark, sf_dir, "documents"), ["lang"], "n_chars").select("doc_id", "bottom")


@query("SELECT count(*) FILTER (WHERE toxic < 1 - quality) AS a_better, count(*) FILTER (WHERE toxic = 1 - quality) AS tie, count(*) FILTER (WHERE toxic > 1 - quality) AS b_better FROM labels")
def head_to_head(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(*statistics.head_to_head(F.col("toxic"), 1 - F.col("quality")))


def drawn(columns: str, draws: int, seed: int = 7) -> str:
    """CTEs of SQL that resample the rows of ``g`` (source, columns): per draw the sums of the columns."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in columns.split(" "))
    return f"""k AS (SELECT *, row_number() OVER (ORDER BY md5(source), source) - 1 AS number, count(*) OVER () AS many FROM g),
p AS (SELECT draw, ('0x' || substr(md5({seed} || '|' || draw || '|' || number), 1, 15))::BIGINT % many AS number FROM k, (SELECT unnest(range(1, {draws} + 1)) AS draw)),
r AS (SELECT draw, {sums} FROM p JOIN k USING (number) GROUP BY draw)"""


_DELTAS = "g AS (SELECT source, sum(toxic - (1 - quality))::DOUBLE AS d, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source)"


@query(f"""WITH {_DELTAS}, {drawn('d n', 2000)}, q AS (SELECT quantile_cont(d / n, 0.025) AS low, quantile_cont(d / n, 0.975) AS high FROM r)
SELECT round((SELECT sum(d) / sum(n) FROM g), 9) AS delta, round(low, 9) AS low, round(high, 9) AS high, low > 0 OR high < 0 AS excludes_zero, (SELECT count(*) FROM g) AS n_clusters FROM q""")
def cluster_bootstrap(spark, sf_dir):
    out = statistics.cluster_bootstrap(_verdicts(spark, sf_dir), "source", "toxic", "low", "one", draws=2_000)
    return out.select(*(F.round(c, 9).alias(c) for c in ("delta", "low", "high")), "excludes_zero", "n_clusters")


@query("""WITH g AS (SELECT lang, source, sum(toxic - (1 - quality))::DOUBLE AS d, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
t AS (SELECT lang, sum(d) AS s, sum(n) AS size, count(*) AS n_clusters FROM g GROUP BY lang), m AS (SELECT g.lang, s, size, n_clusters, sqrt(sum((d - s / size * n) ** 2)) / size AS se FROM g JOIN t ON g.lang IS NOT DISTINCT FROM t.lang GROUP BY g.lang, s, size, n_clusters),
v AS (SELECT lang, draw, CASE WHEN ('0x' || substr(md5('1|' || draw || '|' || coalesce(source, '')), 1, 15))::BIGINT % 2 = 1 THEN -d ELSE d END AS d, n FROM g, (SELECT unnest(range(1, 2000)) AS draw)),
u AS (SELECT lang, draw, sum(d) AS s FROM v GROUP BY ALL), x AS (SELECT lang, draw, any_value(u.s) AS s, sqrt(sum((v.d - u.s / size * v.n) ** 2)) / any_value(size) AS e, any_value(size) AS size FROM v JOIN u USING (lang, draw) JOIN t USING (lang) GROUP BY ALL),
h AS (SELECT x.lang, count(*) FILTER (WHERE CASE WHEN e > 1e-12 THEN abs(x.s / x.size / e) ELSE CASE WHEN abs(x.s) < 1e-9 THEN 0 ELSE 1e300 END END >= abs(m.s / m.size / m.se) - 1e-9) AS hits FROM x JOIN m USING (lang) WHERE m.se > 1e-12 GROUP BY x.lang)
SELECT lang, round(s / size, 9) AS delta, round(se, 9) AS se, n_clusters, round(CASE WHEN se > 1e-12 THEN s / size / se ELSE 0 END, 6) AS t, round(CASE WHEN se > 1e-12 THEN (1 + hits) / 2000 WHEN abs(s) < 1e-9 THEN 1 ELSE 1 / 2000 END, 9) AS p FROM m LEFT JOIN h USING (lang)""")
def wild_cluster(spark, sf_dir):
    out = statistics.wild_cluster_test(_verdicts(spark, sf_dir), "lang", "source", "toxic", "low", "one", draws=1_999)
    return out.select("lang", F.round("delta", 9).alias("delta"), F.round("se", 9).alias("se"), "n_clusters", F.round("t", 6).alias("t"), F.round("p", 9).alias("p"))


@query("""WITH g AS (SELECT source, count(*) FILTER (WHERE toxic < 1 - quality) AS wins, count(*) FILTER (WHERE toxic > 1 - quality) AS losses FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) END, 9) AS p FROM g""")
def sign_test(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("toxic") < F.col("low")).alias("wins"), F.count_if(F.col("toxic") > F.col("low")).alias("losses"))
    return rows.withColumn("p", F.round(statistics.exact_sign_p("wins", "losses"), 9))


# --- intervals ---------------------------------------------------------------------------------------------------

_SPANS = """spans AS (SELECT event_id, user_id, event_type, epoch(ts) AS start, epoch(ts) + 7200 * (1 + event_id % 5) AS "end" FROM events)"""
_START = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1e6D"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("start", F.expr(_START))
    return rows.select("event_id", "user_id", "event_type", "start", (F.col("start") + 7200 * (1 + F.col("event_id") % 5)).alias("end"))


def _r(*names: str) -> list[Column]:
    return [F.round(n, 3).alias(n) for n in names]


_ISLANDS = f"""{_SPANS}, f AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY user_id ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS b FROM spans),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY start, "end", event_id) AS i FROM f),
islands AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY user_id, i)"""


@query(f'WITH {_ISLANDS} SELECT user_id, round(start, 3) AS start, round("end", 3) AS "end" FROM islands')
def interval_merge(spark, sf_dir):
    return intervals.merge(spans(spark, sf_dir), ["user_id"]).select("user_id", *_r("start", "end"))


@query(f'WITH {_ISLANDS}, n AS (SELECT user_id, "end" AS start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS "end" FROM islands) SELECT user_id, round(start, 3) AS start, round("end", 3) AS "end" FROM n WHERE "end" - start >= 3600')
def silence_gaps(spark, sf_dir):
    return intervals.gaps(spans(spark, sf_dir), ["user_id"], 3600).select("user_id", *_r("start", "end"))


_SWEEP = f"""{_SPANS}, m0 AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY user_id, event_type ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS b FROM spans),
m1 AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY start, "end", event_id) AS i FROM m0), own AS (SELECT user_id, event_type, min(start) AS start, max("end") AS "end" FROM m1 GROUP BY user_id, event_type, i),
e AS (SELECT user_id, t, sum(d) AS d FROM (SELECT user_id, start AS t, 1 AS d FROM own UNION ALL SELECT user_id, "end", -1 FROM own) GROUP BY ALL HAVING sum(d) <> 0),
sweep AS (SELECT user_id, t AS start, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS "end", sum(d) OVER (PARTITION BY user_id ORDER BY t) AS n FROM e)"""


@query(f'WITH {_SWEEP} SELECT user_id, round(start, 3) AS start, round("end", 3) AS "end", n::BIGINT AS n_members FROM sweep WHERE n > 0')
def overlap_sweep(spark, sf_dir):
    return intervals.sweep(spans(spark, sf_dir), ["user_id"], "event_type").select("user_id", *_r("start", "end"), "n_members")


@query(f'WITH {_SWEEP} SELECT user_id, round(sum("end" - start), 2) AS speech, round(coalesce(sum("end" - start) FILTER (WHERE n >= 2), 0), 2) AS overlap FROM sweep WHERE n > 0 GROUP BY user_id')
def overlap_features(spark, sf_dir):
    rows = intervals.sweep(spans(spark, sf_dir), ["user_id"], "event_type").withColumn("s", F.col("end") - F.col("start"))
    return rows.groupBy("user_id").agg(F.round(F.sum("s"), 2).alias("speech"), F.round(F.coalesce(F.sum(F.when(F.col("n_members") >= 2, F.col("s"))), F.lit(0.0)), 2).alias("overlap"))


@query(f"""WITH {_SPANS}, x AS (SELECT user_id, start, event_type, lag(event_type) OVER w AS before, lag("end") OVER w AS e FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY start, "end", event_type))
SELECT user_id, before, event_type AS after, round((e + start) / 2, 3) AS t FROM x WHERE before <> event_type""")
def handovers(spark, sf_dir):
    return intervals.handovers(spans(spark, sf_dir), ["user_id"], "event_type").select("user_id", "before", "after", *_r("t"))


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spans(spark, sf_dir)
    items = rows.filter("event_type = 'click'").select("user_id", "event_id", "start", "end")
    others = rows.filter("event_type <> 'click'").select("user_id", "event_type", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return items, others


@query(f"""WITH {_SPANS}, o AS (SELECT a.event_id, b.event_type, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS s FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.start < b."end" AND b.start < a."end"
  WHERE a.event_type = 'click' AND b.event_type <> 'click' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(s, 3) DESC, event_type) AS k, lead(s) OVER (PARTITION BY event_id ORDER BY round(s, 3) DESC, event_type) AS second FROM o)
SELECT a.event_id, r.event_type AS member, CASE WHEN r.event_type IS NULL THEN 'non_speech' WHEN round(second, 3) >= round(0.8 * s, 3) THEN 'ambiguous' ELSE 'named' END AS status FROM spans a LEFT JOIN r ON a.event_id = r.event_id AND k = 1 WHERE a.event_type = 'click'""")
def overlap_assign(spark, sf_dir):
    items, others = _items(spark, sf_dir)
    return intervals.assign_members(items, others, ["user_id"], "event_id", "event_type", 14400).select("event_id", F.col("event_type").alias("member"), "status")


@query(f"""WITH {_SPANS} SELECT p.event_id, s.event_id AS span_id FROM spans p JOIN spans s ON p.user_id = s.user_id AND p.start >= s.start AND p.start < s."end" WHERE p.event_id <> s.event_id""")
def point_in_interval(spark, sf_dir):
    rows = spans(spark, sf_dir)
    points = rows.select("user_id", "event_id", F.col("start").alias("t"))
    return intervals.point_join(points, rows.select("user_id", F.col("event_id").alias("span_id"), "start", "end"), ["user_id"], 14400).filter("event_id <> span_id").select("event_id", "span_id")


@query(f"""WITH {_SPANS} SELECT a.event_id, b.event_id AS outer_id FROM spans a JOIN spans b ON a.user_id = b.user_id AND b.start <= a.start AND a."end" <= b."end" WHERE a.event_id <> b.event_id""")
def containment_join(spark, sf_dir):
    rows = spans(spark, sf_dir)
    outer = rows.select("user_id", F.col("event_id").alias("outer_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.interval_join(rows, outer, ["user_id"], 14400, how="within").filter("event_id <> outer_id").select("event_id", "outer_id")


@query(f"""WITH {_SPANS}, c AS (SELECT user_id, event_id, start AS t FROM spans WHERE event_type = 'click'), p AS (SELECT user_id, start AS o FROM spans WHERE event_type = 'purchase'),
x AS (SELECT c.event_id, c.t, b.o AS b, a.o AS a FROM c ASOF LEFT JOIN p b ON c.user_id = b.user_id AND c.t >= b.o ASOF LEFT JOIN p a ON c.user_id = a.user_id AND c.t <= a.o)
SELECT event_id, round(CASE WHEN a IS NULL OR t - b <= a - t THEN b ELSE coalesce(a, b) END, 3) AS near FROM x""")
def asof_nearest(spark, sf_dir):
    rows = spans(spark, sf_dir)
    points = rows.filter("event_type = 'click'").select("user_id", "event_id", F.col("start").alias("t"))
    others = rows.filter("event_type = 'purchase'").select("user_id", F.col("start").alias("other_t"))
    return intervals.nearest(points, others, ["user_id"]).select("event_id", F.round("other_t", 3).alias("near"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS q FROM events)
SELECT user_id, event_type, min(p) AS first_place, max(p) AS last_place, count(*) AS length FROM x GROUP BY user_id, event_type, p - q""")
def equal_runs(spark, sf_dir):
    return intervals.runs(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_type")


@query(f"""WITH {_SPANS}, x AS (SELECT *, CASE WHEN lag(event_type) OVER w <> event_type OR start - lag("end") OVER w >= 3600 THEN 1 ELSE 0 END AS b FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY start, "end")),
y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY start, "end") AS i FROM x) SELECT user_id, event_type, round(min(start), 3) AS start, round(max("end"), 3) AS "end", count(*) AS n FROM y GROUP BY user_id, event_type, i""")
def speaker_turns(spark, sf_dir):
    return intervals.turns(spans(spark, sf_dir), ["user_id"], "event_type", 3600).select("user_id", "event_type", *_r("start", "end"), "n")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS member FROM events")
def fill_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("member", F.when(F.col("event_type") == "click", F.col("event_type")))
    return intervals.fill_forward(rows, ["user_id"], ["ts", "event_id"], "member").select("event_id", "member")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > value AS raised FROM events")
def monotone_times(spark, sf_dir):
    return intervals.monotone(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value", "raised")


@query("""SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS before, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ',') AS after FROM conversations""")
def context_window(spark, sf_dir):
    out = intervals.context(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", 2, 2)
    return out.select("conv_id", "turn", F.when(F.size("before") > 0, F.array_join("before", ",")).alias("before"), F.when(F.size("after") > 0, F.array_join("after", ",")).alias("after"))


@query(f"""WITH {_SPANS}, e AS (SELECT user_id, start AS t, CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END AS l, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS r FROM spans
  UNION ALL SELECT user_id, "end", CASE WHEN event_type <> 'click' THEN -1 ELSE 0 END, CASE WHEN event_type = 'click' THEN -1 ELSE 0 END FROM spans),
g AS (SELECT user_id, t, sum(l) AS l, sum(r) AS r FROM e GROUP BY ALL), c AS (SELECT user_id, t AS start, lead(t) OVER w AS "end", sum(l) OVER w AS l, sum(r) OVER w AS r FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t)),
k AS (SELECT *, CASE WHEN start = lag("end") OVER (PARTITION BY user_id ORDER BY start) THEN 0 ELSE 1 END AS b FROM c WHERE l > 0 AND r = 0), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY start) AS n FROM k)
SELECT user_id, round(min(start), 3) AS start, round(max("end"), 3) AS "end" FROM i GROUP BY user_id, n""")
def interval_subtract(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return intervals.subtract(rows.filter("event_type <> 'click'"), rows.filter("event_type = 'click'"), ["user_id"]).select("user_id", *_r("start", "end"))


@query("""WITH n AS (SELECT doc_id, n_chars / 10 AS e, greatest(1, ceil((n_chars / 10 - 30) / 20) + 1)::BIGINT AS n FROM documents), w AS (SELECT *, unnest(range(0, n)) AS i FROM n)
SELECT doc_id, i AS "window", round(20e0 * i, 6) AS w_start, round(least(20e0 * i + 30, e), 6) AS w_end, round(CASE WHEN i = 0 THEN 0e0 ELSE 20e0 * i + 5 END, 6) AS own_start, round(CASE WHEN i = n - 1 THEN e ELSE 20e0 * i + 25 END, 6) AS own_end FROM w""")
def overlap_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0.0).alias("start"), (F.col("n_chars") / 10).alias("end"))
    ends = ("w_start", "w_end", "own_start", "own_end")
    return intervals.windows(rows, 30, 20).select("doc_id", long(F.col("window")).alias("window"), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ends))


# --- selection ---------------------------------------------------------------------------------------------------

@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id, '|s1')), doc_id) AS r FROM documents) WHERE r <= 50")
def stratified_cap(spark, sf_dir):
    return selection.stratified(table(spark, sf_dir, "documents"), ["lang"], "doc_id", 50, "s1").select("doc_id")


@query("""WITH RECURSIVE h AS (SELECT source, md5(source) AS m, 0 AS i, 0::BIGINT AS v FROM (SELECT DISTINCT source FROM documents) UNION ALL
  SELECT source, m, i + 1, (v * 16 + strpos('0123456789abcdef', substr(m, i + 1, 1)) - 1) % 5 FROM h WHERE i < 32)
SELECT doc_id, CASE WHEN v = 0 THEN 'eval' ELSE 'train' END AS split FROM documents JOIN h USING (source) WHERE i = 32""")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", selection.hash_split(F.col("source"), 0.2).alias("split"))


@query("SELECT 'document' AS split_by, source FROM documents GROUP BY source HAVING bool_or(doc_id // 20 % 5 = 0) AND bool_or(doc_id // 20 % 5 <> 0)")
def leakage_check(spark, sf_dir):
    """Sources on both sides of a split: none if the split is by source, nearly all if it is by document."""
    rows = table(spark, sf_dir, "documents").select("source", selection.hash_split(F.col("source"), 0.2).alias("source_split"), F.when(F.expr("doc_id div 20 % 5 = 0"), "eval").otherwise("train").alias("document_split"))
    leaks = lambda by: guards.leaked(rows.filter(F.col(f"{by}_split") == "eval"), rows.filter(F.col(f"{by}_split") == "train"), ["source"]).select(F.lit(by).alias("split_by"), "source").distinct()
    return leaks("source").unionByName(leaks("document"))


@query("""SELECT doc_id, CASE WHEN r <= round_even(n * 0.25, 0) THEN 'a' ELSE 'b' END AS side FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id, '|s2')), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def share_split(spark, sf_dir):
    return selection.share_split(table(spark, sf_dir, "documents"), ["lang"], "doc_id", 0.25, "s2").select("doc_id", "side")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lineitem) WHERE b < 500""")
def cumulative_until_target(spark, sf_dir):
    out = selection.until_target(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", 500)
    return out.select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY sha256('b|' || doc_id::VARCHAR), doc_id) - 1) // 64)::BIGINT AS batch FROM documents")
def salted_batches(spark, sf_dir):
    return selection.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, "b")


@query("SELECT doc_id, 1 + (r > 1 + (n - 1) * 0.25)::BIGINT + (r > 1 + (n - 1) * 0.5)::BIGINT + (r > 1 + (n - 1) * 0.75)::BIGINT AS quartile FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def rank_quartiles(spark, sf_dir):
    w = Window.partitionBy("lang")
    rank = F.row_number().over(w.orderBy("n_chars", "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", long(selection.quartile(rank, F.count(F.lit(1)).over(w))).alias("quartile"))


@query("SELECT doc_id FROM documents ORDER BY md5(concat(doc_id, '|page')) || '|' || doc_id LIMIT 25")
def seeded_page(spark, sf_dir):
    return selection.seeded_page(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "page", None, 25).select("doc_id")


@query("""WITH RECURSIVE i AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, n_chars / 200 AS l FROM documents),
o AS (SELECT source, doc_id, l, row_number() OVER (PARTITION BY source ORDER BY r * 100.0, r * 100.0 + l, doc_id) AS k FROM i WHERE (r * 100.0 + l) - r * 100.0 BETWEEN 0.02 AND 29.5),
p AS (SELECT source, 0::BIGINT AS k, NULL::BIGINT AS doc_id, 0::BIGINT AS pack, 0.0::DOUBLE AS t_start, 0.0::DOUBLE AS t_end, true AS fresh FROM (SELECT DISTINCT source FROM o)
  UNION ALL SELECT source, k, doc_id, pack, begin_, greatest(round(ceil((begin_ + l) / 0.02 - 1e-9) * 0.02, 2), round(begin_ + 0.02, 2)), false FROM (
    SELECT o.source, o.k, o.doc_id, o.l, p.pack + (NOT fresh AND t_end + 0.4 + o.l > 29.5)::BIGINT AS pack,
      CASE WHEN fresh OR t_end + 0.4 + o.l > 29.5 THEN 0.0 ELSE round(floor((t_end + 0.4) / 0.02 + 1e-9) * 0.02, 2) END AS begin_ FROM p JOIN o ON o.source IS NOT DISTINCT FROM p.source AND o.k = p.k + 1))
SELECT source, doc_id, pack, round(t_start, 2) AS t_start, round(t_end, 2) AS t_end FROM p WHERE k > 0""")
def pack_rows(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", (F.row_number().over(w) * 100.0).alias("start"), (F.row_number().over(w) * 100.0 + F.col("n_chars") / 200).alias("end"))
    return selection.pack(rows, ["source"], "doc_id")


_GREEDY = """WITH RECURSIVE d AS (SELECT doc_id, lang, source, 1 / (1 + abs(n_chars - 2000) / 1000.0::DOUBLE) AS s FROM documents),
p AS (SELECT 0::BIGINT AS rank, [0.0::DOUBLE] AS hit, []::BIGINT[] AS ids, []::VARCHAR[] AS langs, []::VARCHAR[] AS sources
  UNION ALL SELECT rank + 1, hit, list_append(ids, d.doc_id), list_append(langs, lang), list_append(sources, source)
  FROM (SELECT rank, ids, langs, sources, max([{gain}, s, -doc_id::DOUBLE]) AS hit FROM p, d WHERE rank < 100 AND NOT list_contains(ids, doc_id) GROUP BY rank, ids, langs, sources) x JOIN d ON d.doc_id = -hit[3]::BIGINT)"""
_TAKEN = "len(list_filter({0}, lambda x: x = d.{1}))"


@query(_GREEDY.format(gain=f"s * ((1 / sqrt(1 + {_TAKEN.format('langs', 'lang')})) * (1 / sqrt(1 + {_TAKEN.format('sources', 'source')})))") + " SELECT -hit[3]::BIGINT AS doc_id, rank, round(hit[1], 9) AS gain FROM p WHERE rank > 0")
def diverse_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (1 / (1 + F.abs(F.col("n_chars") - 2000) / 1000.0)).alias("score"), "lang", "source")
    return selection.diverse_top(rows, "doc_id", "score", ["lang", "source"], 100).withColumn("gain", F.round("gain", 9))


@query("""WITH RECURSIVE d AS (SELECT doc_id, source || ':' || (doc_id % 7) AS speaker, n_chars / 10 AS seconds FROM documents), t AS (SELECT sum(seconds) AS total FROM d),
o AS (SELECT speaker, s, row_number() OVER (ORDER BY md5(speaker || '|split'), speaker) AS k FROM (SELECT speaker, sum(seconds) AS s FROM d WHERE speaker IS NOT NULL GROUP BY speaker) WHERE s >= 10),
p AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS speaker, 0.0::DOUBLE AS now, false AS taken UNION ALL
  SELECT o.k, o.speaker, CASE WHEN (now + s) / total <= 0.22 THEN now + s ELSE now END, (now + s) / total <= 0.22 FROM p JOIN o ON o.k = p.k + 1, t WHERE now / total < 0.2)
SELECT doc_id, CASE WHEN speaker IN (SELECT speaker FROM p WHERE taken) THEN 'validation' ELSE 'train' END AS split FROM d""")
def speaker_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws(":", "source", F.col("doc_id") % 7).alias("speaker"), (F.col("n_chars") / 10).alias("seconds"))
    return selection.speaker_split(rows, "lang", "speaker", "seconds", ["xx"], "split", floor=10.0).select("doc_id", "split")


# --- distance, alignment, language -------------------------------------------------------------------------------

_PAIR = """pair AS (SELECT conv_id, turn, trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS h,
  trim(regexp_replace(strip_accents(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn))), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS r FROM conversations)"""


@query(f"""WITH {_PAIR} SELECT conv_id, turn, round(CASE WHEN length(coalesce(r, '')) > 0 THEN levenshtein(regexp_replace(h, '[^a-z0-9 ]', 'x', 'g'), regexp_replace(r, '[^a-z0-9 ]', 'x', 'g')) / length(r) WHEN length(h) > 0 THEN 1.0 ELSE 0.0 END, 9) AS cer FROM pair""")
def cer_pair(spark, sf_dir):
    plain = lambda c: F.regexp_replace(text.canonical(F.col(c)), "[^a-z0-9 ]", "x")
    rows = edits(spark, sf_dir)
    return rows.select("conv_id", "turn", F.round(distance.cer(plain("after_text"), plain("before_text")), 9).alias("cer"))


#: Token edit distances: anti-diagonal by anti-diagonal, each one made of the two before it.
_DIAGONALS = """WITH RECURSIVE w AS (SELECT conv_id, turn, coalesce(regexp_extract_all(lower(strip_accents(lag(text) OVER (PARTITION BY conv_id ORDER BY turn))), '[\\p{L}\\p{N}_]+'), []) AS r,
  regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+') AS h FROM conversations),
dp AS (SELECT conv_id, turn, r, h, 0 AS s, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1000000 END) AS a, list_transform(range(0, len(r) + 1), lambda i: 1000000) AS b FROM w
  UNION ALL SELECT conv_id, turn, r, h, s + 1, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN s + 1 - i < 0 OR s + 1 - i > len(h) THEN 1000000 WHEN i = 0 THEN s + 1 WHEN s + 1 = i THEN i
    ELSE least(a[i] + 1, a[i + 1] + 1, b[i] + CASE WHEN r[i] = h[s + 1 - i] THEN 0 ELSE 1 END) END), a FROM dp WHERE s < len(r) + len(h)),
e AS (SELECT conv_id, turn, len(r) AS n, len(h) AS m, a[len(r) + 1] AS d FROM dp WHERE s = len(r) + len(h))
"""


@query(_DIAGONALS + "SELECT conv_id, turn, round(CASE WHEN n > 0 THEN d / n WHEN m > 0 THEN 1.0 ELSE 0.0 END, 9) AS wer FROM e")
def wer_pair(spark, sf_dir):
    return edits(spark, sf_dir).select("conv_id", "turn", F.round(distance.wer(F.col("after_text"), F.col("before_text")), 9).alias("wer"))


def _turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(spark, sf_dir).select("conv_id", "turn", "edited_by", text.word_tokens(F.col("before_text")).alias("ref"), text.word_tokens(F.col("after_text")).alias("hyp"))


@query()
def sdi_ops(spark, sf_dir):
    rows = _turn_tokens(spark, sf_dir).withColumn("c", alignment.op_counts(alignment.align_ops("ref", "hyp")))
    return rows.select("conv_id", "turn", "c.*")


@query(_DIAGONALS + "SELECT conv_id, turn, d::BIGINT AS errors, n::BIGINT AS n, (m - n)::BIGINT AS longer FROM e")
def alignment_errors(spark, sf_dir):
    """What the operations of an alignment add up to: the edit distance, and the difference of the lengths."""
    rows = _turn_tokens(spark, sf_dir).withColumn("c", alignment.op_counts(alignment.align_ops("ref", "hyp")))
    return rows.select("conv_id", "turn", (F.col("c.s") + F.col("c.d") + F.col("c.i")).alias("errors"), "c.n", (F.col("c.i") - F.col("c.d")).alias("longer"))


@query()
def msa_vote(spark, sf_dir):
    rows = _turn_tokens(spark, sf_dir).withColumn("third", F.array_union("ref", "hyp")).withColumn("columns", alignment.progressive_udf("ref", "hyp", "third"))
    return rows.select("conv_id", "turn", F.array_join(alignment.compose(F.col("columns"), 0), " ").alias("fused"), alignment.columns_cost(F.col("columns")).alias("cost"))


@query("""WITH t AS (SELECT source, lang, unnest(list_distinct(regexp_extract_all(text, '\\p{Lu}[\\p{L}\\p{N}]+'))) AS term FROM documents),
c AS (SELECT term, count(DISTINCT source) AS meetings, count(DISTINCT lang) AS cities, min(lang) AS city FROM t GROUP BY term)
SELECT term, meetings, cities, CASE WHEN cities >= 2 THEN 'global' ELSE city END AS scope FROM c WHERE meetings >= 2""")
def glossary_mine(spark, sf_dir):
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{Lu}[\p{L}\p{N}]+)"), F.lit(1)))
    return language.recurrent_terms(table(spark, sf_dir, "documents"), terms, "source", "lang")


@query("""WITH s AS (SELECT list_concat(list_concat(['<s>'], regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+')), ['</s>']) AS w FROM conversations),
g AS (SELECT unnest(w[1:len(w) - 1]) AS context, unnest(w[2:]) AS word FROM s), c AS (SELECT context, word, count(*) AS count FROM g GROUP BY ALL),
d AS (SELECT count(*) FILTER (WHERE count = 1) / (count(*) FILTER (WHERE count = 1) + 2 * count(*) FILTER (WHERE count = 2)) AS d, count(*) AS types FROM c),
x AS (SELECT context, sum(count) AS total, count(*) AS after FROM c GROUP BY context), y AS (SELECT word, count(*) / (SELECT types FROM d) AS continuation FROM c GROUP BY word)
SELECT context, word, count, round(greatest(count - d, 0) / total + d * after / total * continuation, 9) AS p FROM c JOIN x USING (context) JOIN y USING (word), d""")
def kneser_ney(spark, sf_dir):
    out = language.kneser_ney(table(spark, sf_dir, "conversations"), text.word_tokens(F.col("text")))
    return out.withColumn("p", F.round("p", 9))


@query("""WITH w AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+')) AS token FROM benchmark)), t AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS term FROM part),
d AS (SELECT token, term, levenshtein(regexp_replace(token, '[^a-z0-9_]', '~', 'g'), term) AS d FROM w, t WHERE abs(length(token) - length(term)) <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY d, term) AS k, lead(d) OVER (PARTITION BY token ORDER BY d, term) AS second FROM d WHERE d <= 3)
SELECT token, term, d::BIGINT AS distance, second::BIGINT AS second FROM r WHERE k = 1""")
def fuzzy_nearest(spark, sf_dir):
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(text.word_tokens(F.col("text"))).alias("token"))
    terms = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    return language.fuzzy_nearest(tokens, terms).select("token", "term", long(F.col("distance")).alias("distance"), long(F.col("second")).alias("second"))


@query(f"""WITH {_SPANS}, c AS (SELECT event_id, user_id, start AS a, "end" AS b FROM spans WHERE event_type = 'click'), o AS (SELECT user_id, event_type AS speaker, start AS x, "end" AS y FROM spans WHERE event_type <> 'click'),
j AS (SELECT c.event_id, a, b, speaker, x, y, x BETWEEN a AND b OR y BETWEEN a AND b OR (x <= a AND y >= b) AS touches, x <= a AND y >= b AS holds, row_number() OVER (PARTITION BY event_id, speaker ORDER BY x, y) AS i FROM c JOIN o USING (user_id)),
m AS (SELECT *, coalesce(max(i) FILTER (WHERE holds) OVER (PARTITION BY event_id, speaker), 1) AS since, bool_or(holds) OVER (PARTITION BY event_id, speaker) AS holder, sum(touches::INT) OVER (PARTITION BY event_id) AS n FROM j),
s AS (SELECT event_id, speaker, arg_min(CASE WHEN holds THEN 0.0 ELSE sqrt((x - a) ** 2 + (y - b) ** 2) END, (abs(x - a) + abs(y - b), i)) AS drift FROM m WHERE holder AND i >= since GROUP BY ALL),
b AS (SELECT event_id, arg_min(speaker, (drift, speaker)) AS speaker, min(drift) AS drift, count(*) AS k FROM s GROUP BY event_id), d AS (SELECT event_id, any_value(speaker) AS speaker FROM m WHERE n = 1 AND touches GROUP BY event_id)
SELECT u.event_id, coalesce(d.speaker, b.speaker) AS speaker, round(CASE WHEN d.speaker IS NOT NULL THEN 0.0 ELSE b.drift END, 3) AS drift, CASE WHEN d.speaker IS NOT NULL THEN 'direct' WHEN b.k = 1 THEN 'single' WHEN b.k > 1 THEN 'guess' ELSE 'drop' END AS branch
FROM (SELECT DISTINCT event_id FROM j) u LEFT JOIN d USING (event_id) LEFT JOIN b USING (event_id)""")
def speaker_assignment(spark, sf_dir):
    """Each click of a user against the user's other segments, which overlap, contain or miss it."""
    items, others = _items(spark, sf_dir)
    segments = others.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("speaker"), F.col("r_start").alias("start"), F.col("r_end").alias("end")))).alias("segs"))
    rows = items.join(segments, "user_id").withColumn("x", matching.best_speaker(F.col("segs"), F.col("start"), F.col("end"), F.array(F.struct("start", "end"))))
    return rows.select("event_id", "x.speaker", F.round("x.drift", 3).alias("drift"), "x.branch")


@query("""WITH RECURSIVE n AS (SELECT doc_id, n_chars / 15 AS d, greatest(1, floor(n_chars / 15 / 7))::BIGINT AS last FROM documents), e AS (SELECT doc_id, d, last, 0.0::DOUBLE AS pos, 0::BIGINT AS i FROM n
  UNION ALL SELECT doc_id, d, last, CASE WHEN 7 * least(last, floor((pos + 29.2) / 7)) + 0.3 >= pos + 5 THEN 7 * least(last, floor((pos + 29.2) / 7)) + 0.3 ELSE pos + 29.5 END, i + 1 FROM e WHERE d - pos > 29.5 + 1e-7),
f AS (SELECT *, max(i) OVER (PARTITION BY doc_id) AS m, lag(pos) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM e), z AS (SELECT *, i = m AND i > 0 AND d - pos < 5 AS short, greatest(before + 5, d - 29.5) AS lo, least(before + 29.5, d - 5) AS hi FROM f),
y AS (SELECT doc_id, d, i, CASE WHEN short AND lo <= hi THEN coalesce(list_extract(list_sort(list_transform(list_filter(list_transform(range(1, last + 1), lambda k: 7 * k + 0.3), lambda c: c BETWEEN lo AND hi), lambda c: {'far': abs(c - (lo + hi) / 2), 'c': c})), 1).c, (lo + hi) / 2) ELSE pos END AS pos
  FROM z WHERE NOT (short AND d - before <= 29.5))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS piece, round(pos, 6) AS start, round(coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY i), d), 6) AS "end" FROM y""")
def speech_cuts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15).alias("d"))
    quiet = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("d") / 7).cast("int"))), lambda i: F.struct((i * 7.0).alias("start"), (i * 7.0 + 0.6).alias("end")))
    return rows.select("doc_id", F.posexplode(matching.cut_accumulating(F.col("d"), quiet)).alias("piece", "s")).select("doc_id", long(F.col("piece")).alias("piece"), F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"))


@query(_GREEDY.format(gain=f"s / (1 + 8 * greatest(0, {_TAKEN.format('langs', 'lang')} / greatest(1, rank)::DOUBLE - CASE WHEN lang = 'en' THEN 0.4 ELSE 0.15 END)) / sqrt(1 + 0.25 * {_TAKEN.format('sources', 'source')})") + " SELECT -hit[3]::BIGINT AS doc_id, rank AS final_rank FROM p WHERE rank > 0")
def ceiling_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (1 / (1 + F.abs(F.col("n_chars") - 2000) / 1000.0)).alias("score"), "lang", "source")
    return matching.ceiling_top(rows, "doc_id", "score", "lang", {"source": 0.25}, 100, {"en": 0.4})


@query()
def certain_transfer(spark, sf_dir):
    rows = edits(spark, sf_dir).select("conv_id", "turn", text.word_tokens(F.col("after_text")).alias("a"), text.word_tokens(F.col("before_text")).alias("b"))
    return rows.select("conv_id", "turn", long(F.size(F.array_compact(matching.certain_pairs_udf("a", "b")))).alias("certain"))


@query("""WITH g AS (SELECT source, sum(n_chars)::DOUBLE AS v FROM documents GROUP BY source) SELECT source, v, sum(v) OVER () - v AS without, v > 0.05 * sum(v) OVER () AS heavy FROM g""")
def share_of_total(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("v"))
    total = rows.agg(F.sum("v")).first()[0] or 0.0  # one row
    return rows.select("source", "v", (F.lit(total) - F.col("v")).alias("without"), (F.col("v") > 0.05 * F.lit(total)).alias("heavy"))


@query("""SELECT lang, count(*) FILTER (WHERE role_bin = 'short') AS short, count(*) FILTER (WHERE role_bin = 'mid') AS mid, count(*) FILTER (WHERE role_bin = 'long') AS long
FROM (SELECT lang, CASE WHEN n_chars / 15.0 < 5 THEN 'short' WHEN n_chars / 15.0 < 30 THEN 'mid' ELSE 'long' END AS role_bin FROM documents) GROUP BY lang""")
def pivot_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.when(F.col("n_chars") / 15.0 < 5, "short").when(F.col("n_chars") / 15.0 < 30, "mid").otherwise("long").alias("b"))
    return rows.groupBy("lang").pivot("b", ["short", "mid", "long"]).count().na.fill(0)


@query("""SELECT label AS a, count(*) AS n, round(avg(list_dot_product(embedding, embedding)), 3) AS norm FROM embeddings GROUP BY label""")
def embedding_norms(spark, sf_dir):
    dot = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(dot), 3).alias("norm"))


@query("SELECT o_custkey, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def volume_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))


# --- labels and events -------------------------------------------------------------------------------------------

@query("""WITH l AS (SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS status, max(event_id) FILTER (WHERE event_id % 3 = 0) AS n FROM events GROUP BY user_id)
SELECT l.user_id, status, coalesce(e.event_type <> 'error', false) AS has_notes, last_event FROM l LEFT JOIN events e ON e.event_id = l.n""")
def label_log_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    notes = F.when(F.col("event_type") != "error", F.col("event_type"))
    patch = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("status"), F.col("event_type"), F.lit("notes"), notes)).otherwise(F.create_map(F.lit("status"), F.col("event_type")))
    out = labels.replay(rows.withColumn("patch", patch), "user_id", ["event_id"])
    return out.select("user_id", "status", F.col("notes").isNotNull().alias("has_notes"), F.col("last_event.event_id").alias("last_event"))


@query("SELECT event_id, user_id, event_type, ts::VARCHAR AS at, row_number() OVER (ORDER BY ts, event_id, user_id, event_type) AS id FROM events")
def merge_logs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type")
    out = labels.merge_logs(rows.filter("event_id % 3 <> 0"), rows.filter("event_id % 2 = 0 OR event_id % 3 = 0"), ["ts", "event_id", "user_id", "event_type"], "ts")
    return out.select("event_id", "user_id", "event_type", F.col("ts").cast("string").alias("at"), long(F.col("id")).alias("id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5(concat(doc_id, '|next')), doc_id LIMIT 40")
def next_unlabelled(spark, sf_dir):
    return labels.next_batch(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", 40, "next")


@query("""SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark, sf_dir):
    out = streams.windowed(table(spark, sf_dir, "events"), "6 hours", late=None)
    return out.select("w_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS b FROM events), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS s_start, count(*) AS n FROM y GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "2 hours", late=None).select("user_id", "s_start", "n")


# --- the flagship ------------------------------------------------------------------------------------------------

_ASCII = "regexp_replace(translate({0}, 'ßœæøðþ', 'SOAEDT'), '[^ -~]', '~', 'g')"


@query(f"""WITH {_CATEGORIES}, c AS (SELECT conv_id, coalesce(min(turn) FILTER (WHERE edited_by = 'user') < max(turn) FILTER (WHERE edited_by = 'assistant'), false) AS tu FROM edits GROUP BY conv_id)
SELECT edited_by, category, count(*) AS n, round(sum(levenshtein({_ASCII.format('a_canon')}, {_ASCII.format('b_canon')})) / nullif(sum(length(b_canon)), 0), 9) AS cer, round(avg(tu::INT), 9) AS human_ended FROM categories JOIN c USING (conv_id) GROUP BY edited_by, category""")
def correction_report(spark, sf_dir):
    """Edits by editor and error category: number, character error rate over all of them, share of chains that a person ended."""
    rows = edits(spark, sf_dir)
    ends = chains.reconstruct(rows, "conv_id", ("turn",), machine="user", human="assistant").select("conv_id", "task_then_user")
    rows = rows.join(ends, "conv_id").withColumn("category", classify.error_category(F.col("before_text"), F.col("after_text")))
    a, b = text.canonical(F.col("after_text")), text.canonical(F.col("before_text"))
    rate = statistics.micro_rate(F.levenshtein(a, b), F.length(b))
    return rows.groupBy("edited_by", "category").agg(F.count(F.lit(1)).alias("n"), F.round(rate, 9).alias("cer"), F.round(F.avg(F.col("task_then_user").cast("double")), 9).alias("human_ended"))
