"""Queries over lattices, signatures, assignments, fitting alignments, placed deletions, confidences and gazetteers; SQL states each as a recursion or a plain join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import alignment, classify, fusion, intervals, language, matching, names, placing, review

from . import experiments
from .catalogue import _CANON, _SPANS, long, query, spans, table
from .further import greek
from .lookups import _RECURRENT, _recurrent

_W = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+')"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items, with those of the next three."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.word_tokens(F.col("text")).alias("w0"))
    out = rows
    for k in (1, 2, 3):
        out = out.join(rows.select((F.col("item_id") - k).alias("item_id"), F.col("w0").alias(f"w{k}")), "item_id")
    return out


_ITEMS = f"""b AS (SELECT item_id, {_W} AS w FROM benchmark),
items AS (SELECT a.item_id, a.w AS w0, b.w AS w1, c.w AS w2, d.w AS w3 FROM b a JOIN b ON b.item_id = a.item_id + 1 JOIN b c ON c.item_id = a.item_id + 2 JOIN b d ON d.item_id = a.item_id + 3)"""


def _forward(name: str, order: str) -> str:
    """SQL: a row of distances after each column, made of the one before; ``order`` is the column that comes next after i, and words of the reference in its direction."""
    step, ref = ("i + 1", "ref[j]") if order == "on" else ("n - i", "ref[len(ref) + 1 - j]")
    return f"""{name} AS (SELECT item_id, 0::BIGINT AS i, n, ref, list_transform(range(0, len(ref) + 1), lambda j: j::BIGINT) AS row FROM whole
  UNION ALL SELECT item_id, i + 1, n, ref, list_transform(range(1, len(ref) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: cand[k] + j - k)))
  FROM (SELECT f.item_id, f.i, f.n, f.ref, list_transform(range(0, len(f.ref) + 1), lambda j: least(f.row[j + 1] + CASE WHEN gap THEN 0 ELSE 1 END, CASE WHEN j > 0 THEN f.row[j] + CASE WHEN list_contains(opts, f.{ref}) THEN 0 ELSE 1 END ELSE 1000000 END)) AS cand
    FROM {name} f JOIN cols ON f.item_id = cols.item_id AND cols.place = f.{step} WHERE f.i < f.n))"""


@query(f"""WITH RECURSIVE {_ITEMS},
whole AS (SELECT item_id, w3 AS ref, greatest(len(w0), len(w1), len(w2))::BIGINT AS n FROM items),
cols AS (SELECT item_id, place, list_distinct(list_filter([w0[place], w1[place], w2[place]], lambda x: x IS NOT NULL)) AS opts, place > len(w0) OR place > len(w1) OR place > len(w2) AS gap
  FROM (SELECT *, unnest(range(1, greatest(len(w0), len(w1), len(w2)) + 1)) AS place FROM items)),
{_forward('f', 'on')}, {_forward('g', 'back')},
star AS (SELECT item_id, row[len(ref) + 1] AS best FROM f WHERE i = n),
entries AS (SELECT item_id, place, unnest(opts) AS entry FROM cols UNION ALL SELECT item_id, place, NULL FROM cols WHERE gap),
known AS (SELECT e.item_id, e.place AS e_place, entry, f.ref, f.row AS a, list_reverse(g.row) AS z, best FROM entries e JOIN f ON e.item_id = f.item_id AND f.i = e.place - 1 JOIN g ON e.item_id = g.item_id AND g.i = g.n - e.place JOIN star ON e.item_id = star.item_id),
told AS (SELECT *, list_filter(range(1, len(ref) + 1), lambda j: entry IS NOT NULL AND a[j] + CASE WHEN entry = ref[j] THEN 0 ELSE 1 END + z[j + 1] = best) AS says,
  len(list_filter(range(1, len(ref) + 2), lambda j: a[j] + CASE WHEN entry IS NULL THEN 0 ELSE 1 END + z[j] = best)) > 0 AS alone FROM known)
SELECT item_id, e_place - 1 AS place, coalesce(entry, '') AS entry, best AS distance, len(list_filter(says, lambda j: ref[j] = entry))::BIGINT AS n_exact, len(list_filter(says, lambda j: ref[j] <> entry))::BIGINT AS n_sub,
  alone AND entry IS NOT NULL AS extra, alone OR len(says) > 0 AS on_best FROM told""")
def lattice_entries(spark, sf_dir):
    """Which entries of the columns that three texts make, word by word, lie on a best way to a fourth."""
    rows = _items(spark, sf_dir)
    long_ = F.greatest(F.size("w0"), F.size("w1"), F.size("w2"))
    columns = F.transform(F.sequence(F.lit(0), long_ - 1), lambda i: F.array(F.get("w0", i), F.get("w1", i), F.get("w2", i)))
    told = rows.select("item_id", alignment.lattice_support_udf(columns, F.col("w3")).alias("s"))
    each = told.select("item_id", "s.distance", F.posexplode("s.columns").alias("place", "entries")).select("item_id", "distance", "place", F.explode("entries").alias("e"))
    return each.select("item_id", long(F.col("place")).alias("place"), F.coalesce("e.entry", F.lit("")).alias("entry"), long(F.col("distance")).alias("distance"), long(F.size("e.exact")).alias("n_exact"), long(F.size("e.sub")).alias("n_sub"), "e.extra", F.col("e.any").alias("on_best"))


# --- matching blocks -----------------------------------------------------------------------------------------------

_BLOCKS = f"""u AS (SELECT conv_id, turn, {_W} AS w FROM conversations WHERE role = 'user'),
pair AS (SELECT conv_id, turn, coalesce(lag(w) OVER (PARTITION BY conv_id ORDER BY turn), []) AS a, w AS b FROM u),
aw AS (SELECT conv_id, turn, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS i FROM pair),
bw AS (SELECT conv_id, turn, unnest(b) AS w, unnest(range(1, len(b) + 1)) AS j FROM pair),
eq AS (SELECT conv_id, turn, i, j, i - j AS d FROM aw JOIN bw USING (conv_id, turn, w)),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, d ORDER BY i) AS g FROM eq),
run AS (SELECT conv_id, turn, i, j, max(i) OVER (PARTITION BY conv_id, turn, d, g) - i + 1 AS n FROM isl),
seg AS (SELECT conv_id, turn, 1::BIGINT AS al, len(a)::BIGINT + 1 AS ah, 1::BIGINT AS bl, len(b)::BIGINT + 1 AS bh FROM pair
  UNION ALL SELECT conv_id, turn, CASE WHEN side = 0 THEN al ELSE hit[1] - hit[2] END, CASE WHEN side = 0 THEN -hit[2] ELSE ah END, CASE WHEN side = 0 THEN bl ELSE hit[1] - hit[3] END, CASE WHEN side = 0 THEN -hit[3] ELSE bh END
  FROM (SELECT s.conv_id, s.turn, al, ah, bl, bh, max([least(r.n, ah - i, bh - j), -i, -j]) AS hit FROM seg s JOIN run r ON s.conv_id = r.conv_id AND s.turn = r.turn AND i >= al AND i < ah AND j >= bl AND j < bh GROUP BY ALL) x, (SELECT unnest([0, 1]) AS side) y),
hits AS (SELECT conv_id, turn, max([least(r.n, ah - i, bh - j), -i, -j]) AS hit FROM seg s JOIN run r USING (conv_id, turn) WHERE i >= al AND i < ah AND j >= bl AND j < bh GROUP BY conv_id, turn, al, ah, bl, bh),
blocks AS (SELECT conv_id, turn, -hit[2] AS i, -hit[3] AS j, hit[1] AS n FROM hits UNION ALL SELECT conv_id, turn, len(a) + 1, len(b) + 1, 0 FROM pair),
ends AS (SELECT *, coalesce(lag(i + n) OVER o, 1) AS pi, coalesce(lag(j + n) OVER o, 1) AS pj FROM blocks WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i, j, n DESC)),
ops AS (SELECT e.conv_id, e.turn, e.i, e.j, CASE WHEN pi < i AND pj < j THEN 'replace' WHEN pi < i THEN 'delete' ELSE 'insert' END AS kind,
  left(array_to_string(a[pi:i - 1], ' '), 24) AS x, left(array_to_string(b[pj:j - 1], ' '), 24) AS y FROM ends e JOIN pair p ON e.conv_id = p.conv_id AND e.turn = p.turn WHERE pi < i OR pj < j),
said AS (SELECT conv_id, turn, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS op, arg_min(CASE kind WHEN 'replace' THEN x || '->' || y WHEN 'delete' THEN '-' || x ELSE '+' || y END, [CASE WHEN kind = 'replace' THEN 0 ELSE 1 END, i, j]) AS text FROM ops GROUP BY conv_id, turn),
named AS (SELECT p.conv_id, p.turn, CASE WHEN len(a) > len(b) THEN 'shorter' ELSE 'longer' END AS category, coalesce(op, 'equal') AS op, coalesce(text, '') AS text FROM pair p LEFT JOIN said s ON p.conv_id = s.conv_id AND p.turn = s.turn)"""


@query(f"WITH RECURSIVE {_BLOCKS} SELECT conv_id, turn, category, category || ':' || op AS operation, category || ':' || text AS change FROM named")
def edit_signatures(spark, sf_dir):
    """The signatures of what changes from one user turn to the next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", text.word_tokens(F.col("text")).alias("b"))
    rows = rows.withColumn("a", F.coalesce(F.lag("b").over(w), F.array().cast("array<string>")))
    category = F.when(F.size("a") > F.size("b"), "shorter").otherwise("longer")
    return rows.select("conv_id", "turn", alignment.signatures(F.col("a"), F.col("b"), category).alias("s")).select("conv_id", "turn", "s.category", "s.operation", "s.change")


# --- assignments and fitting ---------------------------------------------------------------------------------------

_PAIR_ROWS = """dp AS (SELECT id, r, h, 0::BIGINT AS i, list_transform(range(0, len(h) + 1), lambda j: CASE WHEN free THEN 0 ELSE j END::BIGINT) AS row FROM pairs
  UNION ALL SELECT id, r, h, i + 1, list_transform(range(1, len(h) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: cand[k] + j - k)))
  FROM (SELECT id, r, h, i, list_transform(range(0, len(h) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(row[j + 1] + 1, row[j] + CASE WHEN r[i + 1] = h[j] THEN 0 ELSE 1 END) END) AS cand FROM dp WHERE i < len(r)))"""


@query(f"""WITH RECURSIVE b AS (SELECT item_id, item_id // 4 AS meeting, item_id % 4 AS s, {_W} AS w FROM benchmark), b4 AS (SELECT * FROM b WHERE meeting IN (SELECT meeting FROM b GROUP BY meeting HAVING count(*) = 4)),
h AS (SELECT meeting, (s * 3 + 1) % 4 AS t, list_filter(w, lambda x: length(x) > 2) AS h FROM b4),
pairs AS (SELECT b4.meeting * 16 + s * 4 + t AS id, w AS r, h, false AS free FROM b4 JOIN h ON b4.meeting = h.meeting), {_PAIR_ROWS},
cost AS (SELECT id // 16 AS meeting, id % 16 // 4 AS s, id % 4 AS t, row[len(h) + 1] AS c FROM dp WHERE i = len(r)),
perms AS (SELECT p.meeting, min(p.c + q.c + u.c + v.c) AS errors FROM cost p JOIN cost q ON p.meeting = q.meeting AND q.t <> p.t JOIN cost u ON p.meeting = u.meeting AND u.t NOT IN (p.t, q.t) JOIN cost v ON p.meeting = v.meeting AND v.t NOT IN (p.t, q.t, u.t)
  WHERE p.s = 0 AND q.s = 1 AND u.s = 2 AND v.s = 3 GROUP BY p.meeting)
SELECT meeting, errors::BIGINT AS errors, (SELECT sum(len(w)) FROM b4 WHERE b4.meeting = perms.meeting)::BIGINT AS n FROM perms""")
def speaker_errors(spark, sf_dir):
    """Four speakers a meeting, heard under other names and without their short words: errors under the best assignment."""
    rows = table(spark, sf_dir, "benchmark").select(F.expr("item_id div 4").alias("meeting"), (F.col("item_id") % 4).alias("s"), text.word_tokens(F.col("text")).alias("w"))
    ref = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("r"), F.col("s").cast("string")), "w")))
    hyp = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("h"), ((F.col("s") * 3 + 1) % 4).cast("string")), F.filter("w", lambda x: F.length(x) > 2))))
    both = rows.groupBy("meeting").agg(F.count(F.lit(1)).alias("k"), ref.alias("ref"), hyp.alias("hyp")).filter("k = 4")
    return both.select("meeting", matching.speaker_errors_udf("ref", "hyp").alias("e")).select("meeting", long(F.col("e.errors")).alias("errors"), long(F.col("e.n")).alias("n"))


@query(f"""WITH RECURSIVE {_ITEMS}, pairs AS (SELECT item_id AS id, list_filter(w1, lambda x: length(x) > 2) AS r, list_concat(list_concat(w0, w1), w2) AS h, true AS free FROM items), {_PAIR_ROWS}
SELECT id AS item_id, list_min(row) AS errors, len(r)::BIGINT AS n FROM dp WHERE i = len(r)""")
def fitting_errors(spark, sf_dir):
    """An item without its short words within itself and both neighbours: what stands before and after costs nothing."""
    rows = _items(spark, sf_dir).select("item_id", F.filter("w1", lambda x: F.length(x) > 2).alias("r"), F.concat("w0", "w1", "w2").alias("h"))
    counts = rows.select("item_id", alignment.op_counts(alignment.fitting_ops("r", "h")).alias("c"))
    return counts.select("item_id", (F.col("c.s") + F.col("c.d") + F.col("c.i")).alias("errors"), F.col("c.n").alias("n"))


# --- placed deletions ----------------------------------------------------------------------------------------------


@query(f"""WITH {_SPANS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS ref_index FROM spans),
dels AS (SELECT user_id, ref_index, event_id, start AS t FROM n WHERE event_type = 'click'),
anchors AS (SELECT user_id, ref_index, start, start + 60 AS "end" FROM n WHERE event_type = 'view' AND event_id % 9 = 0),
props AS (SELECT user_id, ref_index, 'system' || (event_id % 3) AS source, start - 30 AS start, start + 30 AS "end" FROM n WHERE event_id % 4 = 0 UNION ALL
  SELECT user_id, ref_index, 'system' || (event_id % 5), start - 10, start + 50 FROM n WHERE event_id % 6 = 0),
speech AS (SELECT user_id, start AS s, "end" AS e FROM spans WHERE event_type = 'purchase'),
bounds AS (SELECT user_id, min(start) - 100 AS a, max("end") + 100 AS z FROM spans WHERE user_id % 5 <> 0 GROUP BY user_id),
p AS (SELECT d.*, (SELECT min(x.source) FROM props x WHERE x.user_id = d.user_id AND x.ref_index = d.ref_index) AS source,
  (SELECT max(ref_index) FROM anchors x WHERE x.user_id = d.user_id AND x.ref_index < d.ref_index) AS l, (SELECT min(ref_index) FROM anchors x WHERE x.user_id = d.user_id AND x.ref_index > d.ref_index) AS r FROM dels d),
m AS (SELECT p.*, CASE WHEN p.source IS NOT NULL THEN 'proposal' WHEN l IS NOT NULL AND r IS NOT NULL THEN 'bracketed' WHEN l IS NOT NULL THEN 'open_right' WHEN r IS NOT NULL THEN 'open_left' ELSE 'unplaced' END AS method,
  x.start AS ps, x."end" AS pe, a."end" AS ls, z.start AS re, b.a AS ba, b.z AS bz FROM p LEFT JOIN (SELECT user_id, ref_index, source, min(start) AS start, arg_min("end", start) AS "end" FROM props GROUP BY ALL) x ON x.user_id = p.user_id AND x.ref_index = p.ref_index AND x.source = p.source
  LEFT JOIN anchors a ON a.user_id = p.user_id AND a.ref_index = l LEFT JOIN anchors z ON z.user_id = p.user_id AND z.ref_index = r LEFT JOIN bounds b ON b.user_id = p.user_id),
e AS (SELECT *, CASE method WHEN 'proposal' THEN ps WHEN 'bracketed' THEN ls WHEN 'open_right' THEN ls WHEN 'open_left' THEN ba END AS x, CASE method WHEN 'proposal' THEN pe WHEN 'bracketed' THEN re WHEN 'open_right' THEN bz WHEN 'open_left' THEN re END AS y FROM m),
o AS (SELECT *, CASE WHEN x > y THEN y ELSE x END AS st, CASE WHEN x > y THEN x ELSE y END AS en FROM e)
SELECT user_id, event_id, method, round(st, 3) AS start, round(en, 3) AS "end", coalesce(source, '') AS source, method IN ('open_left', 'open_right') AS open_ended,
  CASE WHEN method <> 'proposal' AND st IS NOT NULL AND en IS NOT NULL AND NOT EXISTS (SELECT 1 FROM speech s WHERE s.user_id = o.user_id AND s.e > st AND s.s < en) THEN 'reference_only_no_speech_detected' ELSE 'asr_deletion' END AS label
FROM o WHERE st IS NOT NULL AND en IS NOT NULL""")
def placed_deletions(spark, sf_dir):
    """Clicks as deleted words between views that have a time; those of users without known ends that stay open are left out."""
    rows = spans(spark, sf_dir).withColumn("ref_index", F.row_number().over(Window.partitionBy("user_id").orderBy("start", "event_id")))
    deleted = rows.filter("event_type = 'click'").select("user_id", "ref_index", "event_id")
    anchors = rows.filter("event_type = 'view' AND event_id % 9 = 0").select("user_id", "ref_index", "start", (F.col("start") + 60).alias("end"))
    named = lambda every, of, a, b: rows.filter(F.col("event_id") % every == 0).select("user_id", "ref_index", F.concat(F.lit("system"), (F.col("event_id") % of).cast("string")).alias("source"), (F.col("start") - a).alias("start"), (F.col("start") + b).alias("end"))
    bounds = rows.filter("user_id % 5 <> 0").groupBy("user_id").agg((F.min("start") - 100).alias("start"), (F.max("end") + 100).alias("end"))
    speech = rows.filter("event_type = 'purchase'").select("user_id", "start", "end")
    out = placing.place_deletions(deleted, anchors, named(4, 3, 30, 30).unionByName(named(6, 5, 10, 50)), speech, bounds, ["user_id"], 14_400.0)
    return out.filter("start IS NOT NULL AND end IS NOT NULL").select("user_id", "event_id", "method", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.coalesce("source", F.lit("")).alias("source"), "open_ended", "label")


# --- confidences ---------------------------------------------------------------------------------------------------

_SPREAD = f"""w AS (SELECT conv_id * 1000 + turn AS utterance, {_W} AS w FROM conversations), e AS (SELECT utterance, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS n, len(w) AS size FROM w),
c AS (SELECT utterance, n, token, n + count(*) FILTER (WHERE length(token) = 2) OVER (PARTITION BY utterance ORDER BY n) - 1 AS place FROM e),
t AS (SELECT utterance, n, CASE WHEN utterance % 11 = 0 AND n = 3 THEN token || 'x' ELSE token END AS token, size FROM e WHERE NOT (utterance % 7 = 0 AND n = size)),
bad AS (SELECT utterance, count(c.token)::BIGINT AS n_columns, count(t.token)::BIGINT AS n_tokens, min(n) FILTER (WHERE c.token <> t.token) AS differs_at FROM c FULL JOIN t USING (utterance, n) GROUP BY utterance HAVING count(c.token) <> count(t.token) OR bool_or(c.token <> t.token))"""


def _columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words with a gap before each of two letters, as columns; and as decoded tokens, of which some utterances lose the last or misspell the third."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance"), text.word_tokens(F.col("text")).alias("w"))
    gapped = F.flatten(F.transform("w", lambda x: F.when(F.length(x) == 2, F.array(F.lit(None).cast("string"), x)).otherwise(F.array(x))))
    columns = rows.select("utterance", F.posexplode(gapped).alias("place", "token"))
    said = rows.select("utterance", F.size("w").alias("size"), F.posexplode("w").alias("place", "token")).filter("NOT (utterance % 7 = 0 AND place = size - 1)")
    token = F.when(F.expr("utterance % 11 = 0 AND place = 2"), F.concat("token", F.lit("x"))).otherwise(F.col("token"))
    return columns, said.select("utterance", "place", token.alias("token"), (1.0 / (1 + F.length("token"))).alias("confidence"))


@query(f"""WITH {_SPREAD} SELECT utterance, place::BIGINT AS place, c.token, 1.0 / (1 + length(c.token)) AS confidence FROM c WHERE utterance NOT IN (SELECT utterance FROM bad)""")
def confident_columns(spark, sf_dir):
    """Confidences of decoded words at the columns that hold them; gaps have none."""
    sound, _ = placing.column_confidences(*_columns(spark, sf_dir), ["utterance"])
    return sound.filter("token IS NOT NULL").select("utterance", long(F.col("place")).alias("place"), "token", "confidence")


@query(f"""WITH {_SPREAD} SELECT utterance, n_columns, n_tokens, coalesce(differs_at, 0)::BIGINT AS differs_at FROM bad""")
def unsound_columns(spark, sf_dir):
    """Utterances whose columns and decoded tokens do not fit."""
    _, wrong = placing.column_confidences(*_columns(spark, sf_dir), ["utterance"])
    return wrong.select("utterance", "n_columns", "n_tokens", long(F.coalesce("differs_at", F.lit(0))).alias("differs_at"))


# --- gazetteers ----------------------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT source, {_W} AS w FROM documents), b AS (SELECT source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name FROM d), t AS (SELECT source, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS name FROM d),
names AS (SELECT source, name FROM b GROUP BY source, name HAVING count(*) >= 3 UNION ALL SELECT source, name FROM t GROUP BY source, name HAVING count(*) >= 3),
parts AS (SELECT DISTINCT source, unnest(string_split(name, ' ')) AS part FROM names),
said AS (SELECT conv_id * 1000 + turn AS utterance, 'src' || (conv_id % 20) AS source, {_W} AS w FROM conversations),
words AS (SELECT utterance, source, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM said),
runs AS (SELECT utterance, source, i AS b, k, array_to_string(w[i + 1:i + k], ' ') AS run FROM (SELECT *, unnest(range(0, len(w))) AS i FROM said), (SELECT unnest([2, 3]) AS k) WHERE i + k <= len(w)),
found AS (SELECT r.utterance, r.b, r.k, r.run FROM runs r JOIN (SELECT DISTINCT source, name FROM names) n ON r.source = n.source AND r.run = n.name),
hits AS (SELECT utterance, pos, token FROM words WHERE length(token) >= 5 AND (source, token) IN (SELECT (source, part) FROM parts) AND token NOT IN (SELECT unnest({_W}) FROM benchmark)),
best AS (SELECT h.utterance, h.pos, arg_min(run, (h.pos - f.b, f.b + f.k - h.pos)) AS completed FROM hits h JOIN found f ON h.utterance = f.utterance AND h.pos >= f.b AND h.pos < f.b + f.k GROUP BY h.utterance, h.pos)
SELECT h.utterance, h.pos, h.token, CASE WHEN completed IS NULL THEN 'component' ELSE 'confirmed' END AS status, coalesce(completed, '') AS completed_as FROM hits h LEFT JOIN best b ON h.utterance = b.utterance AND h.pos = b.pos""")
def gazetteer_hits(spark, sf_dir):
    """Recurrent runs of two and three words of a source stand for its names; words of the benchmark are ordinary ones."""
    rows = table(spark, sf_dir, "documents").select("source", text.word_tokens(F.col("text")).alias("tokens"))
    ordinary = table(spark, sf_dir, "benchmark").select(F.explode(text.word_tokens(F.col("text"))).alias("token"))
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("source"), text.word_tokens(F.col("text")).alias("tokens"))
    known = placing.recurrent_names(rows, said, "source", 3, 5, ordinary)
    out = placing.gazetteer_hits(said, known, "utterance", "source", 5, ordinary)
    return out.select("utterance", long(F.col("pos")).alias("pos"), "token", "status", F.coalesce("completed_as", F.lit("")).alias("completed_as"))


# --- rules and rows that had no query of their own -----------------------------------------------------------------


@query(f"""WITH {_SPANS}, x AS (SELECT user_id, event_type AS after, start, lag(event_type) OVER w AS before, lag("end") OVER w AS e FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY start, "end", event_type))
SELECT user_id, before, after, round((e + start) / 2, 3) AS t FROM x WHERE before <> after""")
def handover_times(spark, sf_dir):
    """Where one kind of segment of a user follows another."""
    out = intervals.handovers(spans(spark, sf_dir), ["user_id"], "event_type")
    return out.select("user_id", "before", "after", F.round("t", 3).alias("t"))


@query(f"""WITH {_SPANS}, c AS (SELECT user_id, ("end" + lead(start) OVER (PARTITION BY user_id ORDER BY start)) / 2 AS t FROM spans WHERE event_type = 'click')
SELECT DISTINCT user_id, round(t, 3) AS t FROM c WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.user_id = c.user_id AND s.event_type = 'view' AND c.t >= s.start AND c.t <= s."end")""")
def outer_changes(spark, sf_dir):
    """Times between neighbouring clicks of a user that no view covers."""
    rows = spans(spark, sf_dir)
    kind = lambda k: rows.filter(F.col("event_type") == k).select("user_id", "start", "end")
    return fusion.other_changes(kind("click"), kind("view"), ["user_id"], 14_400.0).select("user_id", F.round("t", 3).alias("t"))


@query("SELECT event_id FROM (SELECT event_id, value / 10 AS seconds, event_id % 3 + 1 AS n FROM events) WHERE CASE WHEN n = 1 THEN seconds >= 1.5 ELSE 2.5 * seconds >= 3 END")
def eligible_stretches(spark, sf_dir):
    """Stretches of one speaker or several in which a lost word could be told."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(0.0).alias("start"), (F.col("value") / 10).alias("end"), (F.col("event_id") % 3 + 1).alias("n"))
    return fusion.eligible(rows, 2.5).select("event_id")


@query("""SELECT event_id, CASE WHEN n < 6 THEN false WHEN n <= 9 THEN d = 1 ELSE d <= 2 AND d / n <= 0.20 END AS allowed FROM (SELECT event_id, event_id % 19 AS n, event_id % 4 AS d FROM events)""")
def allowed_repairs(spark, sf_dir):
    """Edits that a name of so many letters may need."""
    return table(spark, sf_dir, "events").select("event_id", names.length_allows(F.col("event_id") % 19, F.col("event_id") % 4).alias("allowed"))


@query(f"""WITH RECURSIVE {_ITEMS}, pairs AS (SELECT item_id * 2 AS id, w0 AS r, w1 AS h, false AS free FROM items UNION ALL SELECT item_id * 2 + 1, list_reverse(w0), list_reverse(w1), false FROM items), {_PAIR_ROWS},
best AS (SELECT id, row[len(h) + 1] AS c FROM dp WHERE i = len(r) AND id % 2 = 0),
cells AS (SELECT f.id // 2 AS item_id, f.i, len(list_filter(range(1, len(f.h) + 1), lambda j: f.row[j] + CASE WHEN f.r[f.i + 1] = f.h[j] THEN 0 ELSE 1 END + b.row[len(f.h) + 1 - j] = c)) AS partners,
  len(list_filter(range(1, len(f.h) + 2), lambda j: f.row[j] + 1 + b.row[len(f.h) + 2 - j] = c)) AS alone FROM dp f JOIN dp b ON b.id = f.id + 1 AND b.i = len(f.r) - f.i - 1 JOIN best ON best.id = f.id WHERE f.id % 2 = 0 AND f.i < len(f.r))
SELECT item_id, count(*) FILTER (WHERE partners = 1 AND alone = 0) AS certain, count(*) AS n FROM cells GROUP BY item_id""")
def certain_words(spark, sf_dir):
    """Words of an item that have the same partner in the next one in every cheapest alignment."""
    rows = _items(spark, sf_dir).select("item_id", matching.certain_pairs_udf("w0", "w1").alias("c"))
    return rows.select("item_id", long(F.size(F.array_compact("c"))).alias("certain"), long(F.size("c")).alias("n"))


@query(f"""WITH said AS (SELECT item_id, string_split({_CANON}, ' ') AS w FROM benchmark), {_RECURRENT}, tokens AS (SELECT item_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS i FROM said),
near AS (SELECT token, w AS term, levenshtein(token, w) AS d FROM (SELECT DISTINCT token FROM tokens WHERE regexp_full_match(token, '[a-z]+')) JOIN recurrent ON abs(length(token) - length(w)) <= 3 AND regexp_full_match(w, '[a-z]+') WHERE levenshtein(token, w) <= 3),
ranked AS (SELECT *, row_number() OVER o AS r, lead(d) OVER o AS second FROM near WINDOW o AS (PARTITION BY token ORDER BY d, term)),
good AS (SELECT token, term FROM ranked WHERE r = 1 AND d > 0 AND d <= CASE WHEN length(token) < 4 THEN 0 WHEN length(token) <= 5 THEN 1 WHEN length(token) <= 9 THEN 2 ELSE 3 END AND coalesce(second, 99) - d >= 1)
SELECT item_id, string_agg(coalesce(term, tokens.token), ' ' ORDER BY i) AS fixed FROM tokens LEFT JOIN good ON tokens.token = good.token GROUP BY item_id""")
def corrected_texts(spark, sf_dir):
    """Benchmark texts with words put right by the recurrent word that is clearly nearest."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.canonical_tokens(F.col("text")).alias("w"))
    tokens = rows.select(F.explode("w").alias("token")).filter("token RLIKE '^[a-z]+$'")
    terms = _recurrent(spark, sf_dir).filter("w RLIKE '^[a-z]+$'").withColumnRenamed("w", "term")
    fixed = matching.fuzzy_correct(language.fuzzy_nearest(tokens, terms), rows, "item_id", "w")
    return fixed.select("item_id", F.array_join("w", " ").alias("fixed"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_W} AS w FROM conversations), n AS (SELECT p_partkey AS conv_id, string_split(p_name, ' ') AS tokens FROM part),
m AS (SELECT conv_id, turn, token FROM (SELECT conv_id, turn, unnest(w) AS word FROM t) JOIN (SELECT conv_id, unnest(tokens) AS token FROM n) USING (conv_id) WHERE levenshtein(word, token) <= 1 GROUP BY conv_id, turn, token)
SELECT c.conv_id, EXISTS (SELECT 1 FROM m WHERE m.conv_id = c.conv_id GROUP BY turn HAVING count(*) = (SELECT len(list_distinct(tokens)) FROM n WHERE n.conv_id = c.conv_id)) AS named FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE conv_id IN (SELECT conv_id FROM n)""")
def named_in_one_turn(spark, sf_dir):
    """Whether one turn of a conversation has a near match for every word of a part's name."""
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(text.word_tokens(F.col("text")).alias("tokens"))).alias("people"))
    name = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("conv_id"), F.split("p_name", " ").alias("tokens"))
    return said.join(name, "conv_id").select("conv_id", matching.everyone_named(F.col("tokens"), F.col("people")).alias("named"))


# --- guards and arms -----------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, 1 + event_id % 3 AS k,
  list_filter(list_transform(range(0, 1 + event_id % 3), lambda i: CASE WHEN (i + event_id) % 4 <> 0 THEN value + i * (event_id % 5) / 2 END), lambda x: x IS NOT NULL) AS starts FROM events),
f AS (SELECT *, len(starts) >= 2 AND list_max(starts) - list_min(starts) > 1.2 AS disagrees, k = 1 AS thin FROM c),
g AS (SELECT *, disagrees OR thin AS odd, p - row_number() OVER (PARTITION BY user_id, disagrees OR thin ORDER BY p) AS run FROM f),
z AS (SELECT *, odd AND sum(disagrees::INT) OVER (PARTITION BY user_id, odd, run) >= 2 AS drift FROM g)
SELECT event_id, disagrees, thin, drift AS in_zone, drift AND thin AS fires FROM z""")
def drift_guard(spark, sf_dir):
    """Thin columns among others whose times drift apart."""
    k, e = (1 + F.col("event_id") % 3).cast("int"), F.col("event_id")
    starts = F.array_compact(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when((i + e) % 4 != 0, F.col("value") + i * (e % 5) / 2)))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("p"), k.alias("k"), starts.alias("starts"))
    out = fusion.drift_guard(rows, ["user_id"], "p", F.col("k"), F.col("starts"), 1.2)
    return out.select("event_id", "disagrees", "thin", F.col("zone").isNotNull().alias("in_zone"), "fires")


@query("""WITH a AS (SELECT user_id, event_id, ['A', 'B', 'none', NULL][(event_id % 4 + 1)::INT] AS pick, ['major', 'minor'][(event_id % 2 + 1)::INT] AS token, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (value)::INT END AS conf, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
q AS (SELECT user_id, n // 2 AS question, count(*) AS k, bool_or(pick IS NULL OR pick <> 'none' AND conf IS NULL) AS bad, bool_or(pick = 'none') AS abstained, count(DISTINCT token) AS tokens, min(token) AS token, min(conf) AS conf FROM a GROUP BY user_id, n // 2)
SELECT user_id, question, CASE WHEN k < 2 OR bad THEN 'invalid' WHEN abstained THEN 'abstain_explicit' WHEN tokens > 1 THEN 'order_disagree' WHEN token = 'minor' AND conf >= 20 THEN 'override' ELSE 'confirm' END AS outcome FROM q""")
def answer_outcomes(spark, sf_dir):
    """Neighbouring events of a user as the two passes over a question."""
    e = F.col("event_id")
    pick = F.get(F.array(F.lit("A"), F.lit("B"), F.lit("none"), F.lit(None)), (e % 4).cast("int"))
    token = F.get(F.array(F.lit("major"), F.lit("minor")), (e % 2).cast("int"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("n"), F.struct(pick.alias("pick"), token.alias("token"), F.when(e % 11 != 0, F.round("value").cast("int")).alias("conf")).alias("a"))
    answer = lambda i: F.first(F.when(F.col("n") % 2 == i, F.col("a")), ignorenulls=True)
    both = rows.groupBy("user_id", F.expr("n div 2").alias("question")).agg(F.array(answer(0), answer(1)).alias("answers"))
    return both.select("user_id", "question", review.answers_outcome(F.col("answers"), F.lit("minor"), "none", 20).alias("outcome"))


@query(f"""WITH {_SPANS}, a AS (SELECT user_id, start, "end", event_id % 3 = 0 AS busy, lag(start) OVER w AS l, lead("end") OVER w AS h FROM spans WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY start, "end")),
m AS (SELECT user_id, coalesce(l, start) AS s, coalesce(h, "end") AS e FROM a WHERE busy),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM m),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, e) AS i FROM f), mask AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, i),
arms AS (SELECT unnest(['plain', 'turns']) AS arm),
cuts AS (SELECT DISTINCT user_id, start AS t, 'turns' AS arm FROM spans WHERE event_type = 'view'),
dose AS (SELECT user_id, arm, count(*) AS dose FROM cuts c WHERE EXISTS (SELECT 1 FROM mask k WHERE k.user_id = c.user_id AND k.s < c.t AND c.t < k.e) GROUP BY user_id, arm),
w AS (SELECT user_id, event_id, start AS t, 'w' || (event_id % 50) AS token, event_id % 7 <> 0 AS base, EXISTS (SELECT 1 FROM mask k WHERE k.user_id = spans.user_id AND k.s <= start AND start < k.e) AS within FROM spans),
said AS (SELECT user_id, string_agg(token, ' ' ORDER BY t, event_id) FILTER (WHERE within OR base) AS words, count(*) FILTER (WHERE within AND base) AS replaced FROM w GROUP BY user_id)
SELECT said.user_id, arms.arm, words, coalesce(dose, 0)::BIGINT AS dose, replaced FROM said JOIN arms ON true LEFT JOIN dose d ON d.user_id = said.user_id AND d.arm = arms.arm WHERE words IS NOT NULL""")
def overlap_arms(spark, sf_dir):
    """Two arms over the busy stretches of users: the same mask, whole and cut at turns; two of three streams agree in all of them."""
    rows = spans(spark, sf_dir)
    active = rows.filter("event_type = 'click'").select("user_id", "start", "end", F.when(F.col("event_id") % 3 == 0, 2).otherwise(1).alias("n"))
    words = rows.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("start", "event_id")).alias("pos"), F.concat(F.lit("w"), (F.col("event_id") % 50).cast("string")).alias("token"), F.col("start").alias("t"))
    said = lambda n: F.struct(F.lit(n).alias("stream"), F.when(F.col("user_id") % 3 == n, F.concat(F.lit("§"), "token")).otherwise(F.col("token")).alias("token"))
    streams = words.select("user_id", "pos", "t", F.explode(F.array(*map(said, range(3)))).alias("s")).select("user_id", "s.stream", "pos", "s.token", "t")
    base = words.filter("event_id % 7 <> 0").select("user_id", "pos", "token", "t")
    turns = rows.filter("event_type = 'view'").select("user_id", F.col("start").alias("t"))
    out = fusion.overlap_arms(active, streams, base, {"plain": turns.limit(0), "turns": turns}, ["user_id"], 86_400.0)
    return out.select("user_id", "arm", F.array_join("words", " ").alias("words"), long(F.col("dose")).alias("dose"), long(F.col("replaced")).alias("replaced"))


@query()
def error_classes(spark, sf_dir):
    """Classes of the words that change from one user turn to the next, in Greek letters (a ratio of matching blocks decides among them: held by tests)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.regexp_extract_all(greek(F.col("text")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)).alias("hyp"))
    rows = rows.withColumn("ref", F.lag("hyp").over(w)).filter("ref IS NOT NULL")
    words = classify.charged_words(rows, ["conv_id", "turn"], "ref", "hyp")
    return words.select("conv_id", "turn", "place", "ref", "hyp", classify.error_class(F.col("ref"), F.col("hyp")).alias("class"))


@query("""WITH g AS (SELECT source, sum(n_chars) AS s, count(*) AS n, sum(n_chars) FILTER (WHERE lang = 'en') AS e FROM documents GROUP BY source), t AS (SELECT sum(s) AS s, sum(n) AS n, sum(e) AS e FROM g)
SELECT doc_id, round(n_chars / ((t.s - g.s) / (t.n - g.n)), 9) AS relative, round((t.e - coalesce(g.e, 0)) / (t.s - g.s), 9) AS english FROM documents d JOIN g ON d.source IS NOT DISTINCT FROM g.source, t""")
def left_out_rates(spark, sf_dir):
    """A document's length against the mean of all other sources, and their share of English."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    sums = {"s": F.col("n_chars"), "n": F.lit(1), "e": F.when(F.col("lang") == "en", F.col("n_chars"))}
    out = experiments.leave_one_group_out_by_sums(rows, sums, lambda x: F.struct((F.col("n_chars") / (x["s"] / x["n"])).alias("relative"), (x["e"] / x["s"]).alias("english")), "source")
    return out.select("doc_id", F.round("out.relative", 9).alias("relative"), F.round("out.english", 9).alias("english"))
