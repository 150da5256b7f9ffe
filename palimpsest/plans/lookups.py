"""Queries over fuzzy lookups: retrieval of terms, worst collisions, repair of names. SQL states each by brute force.

Words that recur in the documents stand for a glossary, those of a source for the closed list of its meetings; what is said are
the benchmark's texts and the turns of conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import fuzzy, names, placing
from palimpsest.session import cut

from .catalogue import _CANON, long, query, table


def _lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence of two words of up to 62 letters, as bits of the second."""
    full = f"((1::BIGINT << length({b})::INT) - 1)"
    masks = f"list_transform(string_split({a}, ''), lambda letter: list_sum(list_transform(range(1, length({b}) + 1), lambda k: CASE WHEN substr({b}, k, 1) = letter THEN 1::BIGINT << (k - 1)::INT ELSE 0 END))::BIGINT)"
    return f"(length({b}) - bit_count(list_reduce({masks}, lambda r, m: ((r + (r & m)) | (r & ~m)) & {full}, {full})))"


_RECURRENT = f"""recurrent AS (SELECT w FROM (SELECT DISTINCT doc_id, unnest(string_split({_CANON}, ' ')) AS w FROM documents) WHERE length(w) >= 4 GROUP BY w HAVING count(*) >= 12)"""


def _recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four letters or more in twelve documents or more."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.canonical_tokens(F.col("text")))).alias("w"))
    return rows.filter(F.length("w") >= 4).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 12").select("w")


_WINDOWS = """windows AS (
  SELECT item_id, norm, list_distinct(list_filter(list_transform(range(1 - n, length(norm)), lambda s: substr(norm, greatest(0, s)::BIGINT + 1, (s + n - greatest(0, s))::BIGINT)), lambda x: x <> '')) AS ws, term
  FROM (SELECT item_id, norm, term, length(term) AS n FROM said, phrases WHERE length(norm) >= length(term)))"""


@query(f"""WITH said AS (SELECT item_id, {_CANON} AS norm FROM benchmark), {_RECURRENT},
phrases AS (SELECT DISTINCT p_name AS term FROM part), {_WINDOWS},
tokens AS (SELECT DISTINCT item_id, unnest(string_split(norm, ' ')) AS t FROM said),
pairs AS (SELECT w, t FROM recurrent, (SELECT DISTINCT t FROM tokens WHERE length(t) >= 4) WHERE 112 * length(t) >= 88 * length(w) AND 112 * length(w) >= 88 * length(t)),
near AS (SELECT w, t, 200.0::DOUBLE * {_lcs_sql('w', 't')} / (length(w) + length(t)) AS score FROM pairs WHERE 200 * {_lcs_sql('w', 't')} >= 88 * (length(w) + length(t))),
hits AS (SELECT item_id, w AS term, max(score) AS score FROM near JOIN tokens USING (t) WHERE (item_id, w) NOT IN (SELECT (item_id, t) FROM tokens) GROUP BY item_id, w
  UNION ALL SELECT item_id, term, max(score) FROM (SELECT item_id, term, 200.0::DOUBLE * {_lcs_sql('term', 'x')} / (length(term) + length(x)) AS score FROM (SELECT item_id, term, unnest(ws) AS x FROM windows)) WHERE score >= 62 GROUP BY item_id, term)
SELECT item_id, rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, term)::INT AS rank FROM hits) WHERE rank <= 20""")
def glossary_retrieval(spark, sf_dir):
    """Terms that a benchmark text may mean: recurrent words, and names of parts as phrases."""
    said = table(spark, sf_dir, "benchmark").select("item_id", text.canonical(F.col("text")).alias("norm"))
    pool = _recurrent(spark, sf_dir).select(F.col("w").alias("term"), F.col("w").alias("norm"))
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), text.canonical(F.col("p_name")).alias("norm")).distinct()
    return fuzzy.retrieve(said, pool.unionByName(parts), "item_id", "norm", phrase_cutoff=62)


@query(f"""WITH terms AS (SELECT DISTINCT t FROM (SELECT unnest(string_split({_CANON}, ' ')) AS t FROM benchmark) WHERE length(t) >= 4), {_RECURRENT},
pairs AS (SELECT t, w, 200.0::DOUBLE * {_lcs_sql('t', 'w')} / (length(t) + length(w)) AS s FROM terms JOIN recurrent ON abs(length(t) - length(w)) <= 3 AND t <> w),
best AS (SELECT t, arg_min(w, (-s, w)) AS nearest, max(s) AS score FROM pairs WHERE s > 0 GROUP BY t)
SELECT terms.t AS term, nearest, coalesce(score, 0) AS score, CASE WHEN score >= 90 THEN 'reject' WHEN score >= 80 THEN 'review' ELSE 'clear' END AS verdict FROM terms LEFT JOIN best ON terms.t = best.t""")
def term_collisions(spark, sf_dir):
    """The recurrent word that each of the benchmark's words is most like."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(text.canonical_tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 4)
    out = fuzzy.worst_collision(terms, _recurrent(spark, sf_dir).withColumnRenamed("w", "nearest"), "term", "nearest")
    return out.withColumn("verdict", fuzzy.collision_verdict(F.col("score"), 90, 80))


@query(f"""WITH phrases AS (SELECT DISTINCT p_name AS term FROM part), words AS (SELECT string_split({_CANON}, ' ') AS w FROM benchmark),
said AS (SELECT DISTINCT norm AS item_id, norm FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS norm FROM words)),
longer AS (SELECT item_id, norm, term FROM said, phrases WHERE norm <> term),
windows AS (SELECT item_id, needle, unnest(list_distinct(list_filter(list_transform(range(1 - n, length(hay)), lambda s: substr(hay, greatest(0, s)::BIGINT + 1, (s + n - greatest(0, s))::BIGINT)), lambda x: x <> ''))) AS x, term
  FROM (SELECT item_id, term, CASE WHEN length(norm) >= length(term) THEN term ELSE norm END AS needle, CASE WHEN length(norm) >= length(term) THEN norm ELSE term END AS hay, least(length(norm), length(term)) AS n FROM longer)),
scores AS (SELECT term, item_id AS nearest, max(200.0::DOUBLE * {_lcs_sql('needle', 'x')} / (length(needle) + length(x))) AS s FROM windows GROUP BY term, item_id)
SELECT phrases.term, nearest, coalesce(score, 0) AS score FROM phrases LEFT JOIN (SELECT term, arg_min(nearest, (-s, nearest)) AS nearest, max(s) AS score FROM scores WHERE s > 0 GROUP BY term) b ON phrases.term = b.term""")
def phrase_collisions(spark, sf_dir):
    """The pair of neighbouring benchmark words that each name of a part is most like, by partial ratio."""
    pairs = lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))))
    grams = table(spark, sf_dir, "benchmark").select(F.explode(pairs(text.canonical_tokens(F.col("text")))).alias("nearest")).distinct()
    return fuzzy.worst_collision(table(spark, sf_dir, "part").select(F.col("p_name").alias("term")), grams, "term", "nearest", phrases=True)


# --- names ---------------------------------------------------------------------------------------------------------

# What stands for endings of surnames and for titles in the tables' languages.
_ENDINGS, _TITLES = ("tion", "ent", "ung", "en", "es"), ("the", "le", "der", "la", "de")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("meeting"), "text")


def _source_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a source of four letters, and of six or more: meeting, w, n (documents), said (times; of other sources than src0: documents), and the least and largest hash of their languages. Texts are read once, and travel as counts."""
    docs = table(spark, sf_dir, "documents")
    again = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("_again")))
    repeated = again.count()  # ids that repeat, if any, are counted apart
    if repeated:
        docs = docs.join(F.broadcast(again) if repeated <= placing.FEW else again, F.col("doc_id") == F.col("_again"), "left")
    words = F.filter(F.regexp_extract_all(names.form(F.col("text")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: (F.length(w) == 4) | (F.length(w) >= 6))
    once = F.col("doc_id").isNotNull() & (F.col("_again").isNull() if repeated else F.lit(True))
    rows = docs.select(F.col("source").alias("meeting"), F.xxhash64("lang").alias("lang"), F.col("lang").isNotNull().alias("_told"), once.alias("_once"), *(["_again"] if repeated else []), words.alias("ws"))
    rows = rows.withColumn("ws", F.when(F.col("meeting") == "src0", F.array_sort("ws")).otherwise(F.array_distinct("ws")))
    first = F.col("_once") & ((F.col("i") == 0) | (F.get("ws", F.col("i") - 1) != F.col("w")))
    lang = F.when(F.col("_told"), F.col("lang"))
    each = rows.select("*", F.posexplode("ws").alias("i", "w")).select("meeting", "w", *(["_again"] if repeated else []), first.cast("int").alias("_first"), lang.alias("lang"))
    n = F.sum("_first") + F.count_distinct("_again") if repeated else F.sum("_first")
    return each.groupBy("meeting", "w").agg(n.alias("n"), F.count(F.lit(1)).alias("said"), F.min("lang").alias("least"), F.max("lang").alias("most"))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closed lists (words of six letters or more in three documents of a source, spellings of one term if they begin alike), first names (four letters, in six documents), and words seen often enough to matter.

    A term of documents in one language is one person's, in several (two stand for them) it is nobody's alone."""
    listed, named, often = (F.length("w") >= 6) & (F.col("n") >= 3), (F.length("w") == 4) & (F.col("n") >= 6), (F.col("meeting") == "src0") & (F.col("said") >= names.COMMON)
    by = cut(_source_words(spark, sf_dir).filter(listed | named | often))
    long_ = by.filter(listed).withColumn("term", F.left("w", F.lit(5)))
    persons = long_.groupBy("meeting", "term").agg(F.when(F.min("least") == F.max("most"), 1).when(F.min("least").isNull(), 0).otherwise(2).alias("persons"))
    roster = long_.join(persons, ["meeting", "term"]).select("meeting", "term", F.col("w").alias("place"), F.concat(F.upper(F.left("w", F.lit(1))), F.substring("w", F.lit(2), F.length("w"))).alias("surface"), "persons")
    return roster, by.filter(named).select("meeting", F.col("w").alias("name")), by.filter(often).select(F.col("w").alias("token"), F.col("said").alias("n"))


_FORM = "translate(lower(strip_accents({})), 'ς', 'σ')"
_OSA = """list_reduce(
    list_transform(range(1, length(token) + 1), lambda i: list_concat(
      list_transform(range(1, length(alias) + 1), lambda j: (substr(token, i, 1) <> substr(alias, j, 1))::INT),
      list_transform(range(1, length(alias) + 1), lambda j: (i > 1 AND j > 1 AND substr(token, i, 1) = substr(alias, j - 1, 1) AND substr(token, i - 1, 1) = substr(alias, j, 1))::INT))),
    lambda r, e: list_concat(
      list_transform(range(0, length(alias) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: j - k + CASE WHEN k = 0 THEN r[1] + 1 ELSE
        least(r[k + 1] + 1, r[k] + e[k], CASE WHEN e[length(alias) + k] = 1 THEN r[length(alias) + k] + 1 ELSE 99 END) END))),
      r[1:length(alias) + 1]),
    list_concat(list_transform(range(0, length(alias) + 1), lambda j: j::INT), list_transform(range(0, length(alias) + 1), lambda j: 99)))[length(alias) + 1]"""

_OUTCOMES = rf"""
said AS (SELECT conv_id * 1000 + turn AS utterance, 'src' || (conv_id % 20) AS meeting, text FROM conversations),
each AS (SELECT doc_id, source AS meeting, lang, unnest(regexp_extract_all({_FORM.format('text')}, '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
byword AS (SELECT meeting, w, count(DISTINCT doc_id) AS n FROM each GROUP BY meeting, w),
listed AS (SELECT meeting, w, left(w, 5) AS term FROM byword WHERE length(w) >= 6 AND n >= 3),
persons AS (SELECT meeting, term, count(DISTINCT lang) AS persons FROM listed JOIN each USING (meeting, w) GROUP BY meeting, term),
first_names AS (SELECT meeting, w AS name FROM byword WHERE length(w) = 4 AND n >= 6),
seen AS (SELECT w AS token, count(*) AS n FROM each WHERE meeting = 'src0' GROUP BY w),
tokens AS (SELECT DISTINCT utterance, meeting, unnest(regexp_extract_all({_FORM.format('text')}, '[\p{{L}}\p{{N}}_]+')) AS token FROM said),
pairs AS (SELECT DISTINCT t.meeting, token, term, l.w AS alias FROM (SELECT DISTINCT meeting, token FROM tokens WHERE length(token) >= 6) t JOIN listed l ON t.meeting = l.meeting AND abs(length(token) - length(l.w)) <= 3 AND damerau_levenshtein(token, l.w) <= 3),
dist AS (SELECT *, {_OSA} AS d FROM pairs),
terms AS (SELECT meeting, token, term, min(d) AS d FROM dist WHERE d <= 3 GROUP BY meeting, token, term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY meeting, token ORDER BY d, term) AS r, lead(d) OVER (PARTITION BY meeting, token ORDER BY d, term) AS second, count(*) OVER (PARTITION BY meeting, token, d) AS ties FROM terms),
near AS (SELECT r.meeting, r.token, r.term, r.d, second, ties, persons FROM ranked r JOIN persons p ON r.meeting = p.meeting AND r.term = p.term WHERE r.r = 1),
parts AS (SELECT utterance, meeting, regexp_extract_all(text, '[\p{{L}}\p{{N}}_.]+') AS ws FROM said),
places AS (SELECT utterance, meeting, ws[i] AS word, CASE WHEN i > 1 THEN ws[i - 1] END AS before, ws[i + 1] AS after FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM parts)),
beside AS (SELECT utterance, meeting, {_FORM.format("regexp_replace(word, '[.]$', '')")} AS token, word, before, {_FORM.format('before')} AS x, {_FORM.format('after')} AS y FROM places),
signals AS (SELECT b.utterance, b.token, bool_or(coalesce(left(word, 1) = upper(left(word, 1)) AND left(word, 1) <> lower(left(word, 1)) AND before <> '' AND NOT regexp_matches(before, '[.]$'), false)
    OR coalesce(x IN {_TITLES}, false) OR coalesce(y IN {_TITLES}, false) OR f.name IS NOT NULL OR g.name IS NOT NULL) AS signal
  FROM beside b LEFT JOIN first_names f ON b.meeting = f.meeting AND b.x = f.name LEFT JOIN first_names g ON b.meeting = g.meeting AND b.y = g.name GROUP BY b.utterance, b.token),
joined AS (SELECT t.utterance, t.meeting, t.token, n.term, n.d, n.second, n.ties, n.persons, s.n AS often, g.signal, l.w IS NOT NULL AS valid,
    coalesce(CASE WHEN length(t.token) < 6 THEN false WHEN length(t.token) <= 9 THEN n.d = 1 ELSE n.d <= 2 AND 5 * n.d <= length(t.token) END, false) AS allowed
  FROM tokens t LEFT JOIN near n ON t.meeting = n.meeting AND t.token = n.token LEFT JOIN listed l ON t.meeting = l.meeting AND t.token = l.w LEFT JOIN seen s ON t.token = s.token
    LEFT JOIN signals g ON t.utterance = g.utterance AND t.token = g.token),
spelled AS (SELECT j.*, (SELECT alias FROM dist x WHERE x.meeting = j.meeting AND x.token = j.token AND x.term = j.term AND x.d = j.d ORDER BY alias LIMIT 1) AS alias FROM joined j),
decided AS (SELECT utterance, token, term, d, alias, allowed AND NOT valid AS shown,
  CASE WHEN valid THEN 'abstain_already_valid' WHEN NOT allowed THEN 'no_candidate' WHEN ties > 1 THEN 'abstain_tie' WHEN second < d + 2 THEN 'abstain_margin' WHEN often >= 5 THEN 'abstain_common' WHEN persons <> 1 THEN 'abstain_multi_person'
    WHEN d = 2 AND ({' OR '.join(f"(token LIKE '%{e}' AND length(token) > {len(e)} AND starts_with(alias, left(token, length(token) - {len(e)})))" for e in _ENDINGS)}) THEN 'abstain_suffix_family'
    WHEN d = 2 AND NOT coalesce(signal, false) THEN 'abstain_no_signal' ELSE 'fire' END AS decision FROM spelled)"""


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    said = _said(spark, sf_dir)
    return said, names.outcomes(said, *_lists(spark, sf_dir), "utterance", "meeting", "text", _ENDINGS, _TITLES)


@query(f"WITH {_OUTCOMES} SELECT utterance, token, decision, CASE WHEN shown THEN term END AS term, CASE WHEN shown THEN d ELSE -1 END AS distance FROM decided")
def name_outcomes(spark, sf_dir):
    """What becomes of every word of every turn."""
    return _decided(spark, sf_dir)[1].select("utterance", "token", "decision", "term", F.coalesce("distance", F.lit(-1)).alias("distance"))


@query(rf"""WITH {_OUTCOMES},
pieces AS (SELECT utterance, unnest(p) AS original, unnest(range(1, len(p) + 1)) AS i FROM (SELECT utterance, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS p FROM said)),
placed AS (SELECT *, sum(length(original)) OVER (PARTITION BY utterance ORDER BY i) AS e FROM pieces)
SELECT utterance, (e - length(original))::BIGINT AS start, e::BIGINT AS "end", original, CASE WHEN length(original) > 1 AND original = upper(original) AND original <> lower(original) THEN upper(alias) ELSE upper(left(alias, 1)) || substr(alias, 2) END AS replacement, term, d AS distance
FROM placed JOIN (SELECT * FROM decided WHERE decision = 'fire') f USING (utterance) WHERE {_FORM.format('original')} = f.token""")
def name_changes(spark, sf_dir):
    """Where names are put right, by code points."""
    said, decided = _decided(spark, sf_dir)
    out = names.changes(said, decided, "utterance", "text")
    return out.select("utterance", long(F.col("start")).alias("start"), long(F.col("end")).alias("end"), "original", "replacement", "term", "distance")
