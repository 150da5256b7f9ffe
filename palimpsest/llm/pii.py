"""Personal data by fixed patterns and by bootstrapped contextual extraction.

Spans that the fixed patterns match are seeds, and so are long hexadecimal strings that something is set to
(secrets, a kind that contexts alone can add). The words around them are lexical patterns, in families from special to
general: two words before, one before and one after, one before. A graph of patterns and the
instances they stand by is scored in rounds, each side from the
other, and the instances by which trusted patterns stand are found although no fixed pattern
matches them. All of it is DataFrame operations and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fold, let

KINDS = ("email", "ip", "card", "phone")
#: All kinds that spans may have: the fixed ones, and the one that contexts alone tell.
NAMES = (*KINDS, "secret")

# Each fixed pattern in a form that matches the same spans in linear time: a start in the midst of a
# run, where the run's own start has failed, is skipped, and nothing is given back in vain.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What contexts may tell to be personal data: any word with a digit or an at sign, and words of digits and marks in a row.
_CANDIDATES = {
    "other": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
    "run": r"(?<![^\x20\x09-\x0D])[+(]*+[0-9][0-9()./+-]*+(?:\x20[(]*+[0-9][0-9()./+-]*+)++(?![^\x20\x09-\x0D.,;:!?)])",
}
#: What stands around the characters of a candidate: an assignment and marks before it, marks after it.
_BEFORE, _AFTER = r"^(?:[^\x20\x09-\x0D=]*+=(?=[^=]))?+[^\p{L}\p{N}+]*+", r"[^\p{L}\p{N}]++$"
_SECRET = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: Cheap conditions without which a text has no valid match.
_GUARDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
    "other": lambda t: t.rlike(r"@|[0-9](?:[^\x20\x09-\x0D0-9]*+[0-9]){3}"),
    "run": lambda t: t.rlike(r"[0-9][()./+-]*+\x20[(]*+[0-9]"),
}
#: Patterns broadcast at most, some 50 bytes each: a frequent one is then no hot key.
BROADCAST_PATTERNS = 50_000
_FOUND = "array<struct<start:int,kind:int,end:int,context:string,after:string,instance:string>>"
_WORDS = r"[\x20\x09-\x0D]+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


_VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$"),
    "card": lambda m: let(_digits(m), lambda d: F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "other": lambda m: m.contains("@") | (F.length(m) - F.length(F.translate(m, "0123456789", "")) >= 4),
    "run": lambda m: F.length(_digits(m)).between(7, 19),
}


def _last_words(before: Column) -> Column:
    """The last two words of what stands before a span, or fewer, whatever stands before these."""
    return let(F.filter(F.split(before, _WORDS), lambda w: w != ""), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - 1), F.lit(2)), " "))


def _matches(text: Column, kind: str) -> Column:
    """Valid matches of a pattern with their places: what a split leaves between matches tells how far each one lies.

    ``context`` is the last two words before, ``after`` the word that follows, both in lower case and null without a
    word; they are of all text around the span, other matches included."""
    pattern, index = _PATTERNS.get(kind) or _CANDIDATES[kind], [*NAMES, "other", "run"].index(kind)
    none = F.array().cast(_FOUND)

    def walk(m: Column) -> Column:
        def between(gaps: Column) -> Column:
            def step(state: Column, i: Column) -> tuple[Column, Column, Column]:
                hit, gap = F.get(m, i), F.get(gaps, i)
                start = state["at"] + F.length(gap)
                before = F.concat(state["tail"], gap)
                bare = hit if kind in KINDS else F.regexp_replace(F.regexp_replace(hit, _BEFORE, ""), _AFTER, "")
                inset = F.lit(0) if kind in KINDS else F.length(hit) - F.length(F.regexp_replace(hit, _BEFORE, ""))
                context = _last_words(F.concat(before, F.translate(F.left(hit, inset), "\"'", "")))
                follows = F.concat(F.substring(hit, inset + F.length(bare) + 1, F.length(hit)), F.get(gaps, i + 1), F.coalesce(F.get(m, i + 1), F.lit("")))
                after = F.regexp_extract(follows, r"^[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)", 1)
                row = F.struct(
                    (start + inset).cast("int").alias("start"),
                    F.lit(index).alias("kind"),
                    (start + inset + F.length(bare)).cast("int").alias("end"),
                    F.when(context != "", F.lower(context)).alias("context"),
                    F.when(after != "", F.lower(after)).alias("after"),
                    bare.alias("instance"),
                )
                whole = F.concat(before, hit)
                tail = F.concat(_last_words(whole), F.when(whole.rlike(r"[\x20\x09-\x0D]\z"), " ").otherwise(""))
                return F.struct((start + F.length(hit)).cast("int").alias("at"), tail.alias("tail")), _VALID[kind](bare), row

            state = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
            return fold(F.sequence(F.lit(0), F.size(m) - 1), state, none, step)["out"]

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), between)).otherwise(none)

    return F.when(_GUARDS[kind](text), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)).otherwise(none)


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans by start, then kind: struct(start, kind, end, context, instance), offsets in code points."""
    return F.array_sort(F.concat(*(_matches(text, k) for k in KINDS)))


def candidates(text: Column) -> Column:
    """Words that may be personal data."""
    return _matches(text, "other")


def runs(text: Column) -> Column:
    """Runs of words of digits that may be personal data together."""
    return _matches(text, "run")


def _apart(base: Column, found: Column) -> Column:
    """Those of ``found`` (by start, disjoint) that overlap none of ``base`` (by start): one walk over both."""
    none = F.array().cast(_FOUND)
    end = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(len(NAMES)).alias("kind"), F.lit(2**31 - 1).alias("end"), F.lit("").alias("context"), F.lit("").alias("after"), F.lit("").alias("instance")).cast(_FOUND[6:-1]))

    def step(state: Column, x: Column) -> tuple[Column, Column, Column]:
        fixed = x["kind"] < len(KINDS)
        held = state["held"]
        clash = fixed & (x["start"] < held["end"])
        free = x["start"] >= state["covered"]
        after = F.struct(
            F.when(fixed, F.greatest(state["covered"], x["end"])).otherwise(state["covered"]).alias("covered"),
            F.when(~fixed & free, x).when(~fixed | clash, F.lit(None)).otherwise(held).alias("held"),
        )
        return after, ~fixed & held.isNotNull(), held

    state = F.struct(F.lit(0).alias("covered"), F.lit(None).cast(_FOUND[6:-1]).alias("held"))
    return F.when(F.size(base) == 0, found).otherwise(let(F.concat(F.array_sort(F.concat(base, found)), end), lambda both: fold(both, state, none, step)["out"]))


def scanned(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``_of`` (the key), ``_tie`` (a hash of the text), ``base`` spans and ``other`` candidates that overlap none of them."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_of"), F.xxhash64(whole).alias("_tie"), whole.alias("_text"))
    out = rows.select("_of", "_tie", base_spans(F.col("_text")).alias("base"), candidates(F.col("_text")).alias("word"), runs(F.col("_text")).alias("run"))
    return checkpoint(out.select("_of", "_tie", "base", F.when(F.size("word") + F.size("run") > 0, F.concat(_apart(F.col("base"), F.col("word")), _apart(F.col("base"), F.col("run")))).otherwise(F.array().cast(_FOUND)).alias("other")))


def _families(x: Column) -> Column:
    """An occurrence's patterns, each with the family it is of."""
    one = F.element_at(F.split(x["context"], " "), -1)
    return F.array_compact(F.array(F.when(x["context"].contains(" "), F.concat(F.lit("2:"), x["context"])), F.concat(F.lit("b:"), one, F.lit(" _ "), x["after"]), F.concat(F.lit("1:"), one)))


def _occurrences(scan: DataFrame, *arrays: str) -> DataFrame:
    """(_of, _tie, x, kind): seeds have a kind below len(NAMES)."""
    x = scan.select("_of", "_tie", F.explode(F.concat(*arrays)).alias("x"))
    secret = F.col("x.instance").rlike(_SECRET) & F.col("x.context").rlike("[=:][\"']*$")
    return x.withColumn("kind", F.when(F.col("x.kind") < len(KINDS), F.col("x.kind")).when(secret, len(KINDS)).otherwise(len(NAMES)))


def trusted_patterns(scan: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.8) -> DataFrame:
    """(pattern, kind) of the lexical patterns that identify a kind, from all occurrences.

    Instances of the seeds have confidence 1 in their kind. In each round a pattern's confidence is the
    sum of its distinct instances' confidences over their number plus one; then an instance's is
    one minus the product of its patterns' doubts. A pattern is trusted from ``support`` distinct
    instances (four times as many for one word alone) and a confidence of ``trust``. Distinct edges are made once
    and checkpointed; sums are partial in each task, so a pattern that a third of all occurrences share is a few rows."""
    seen = _occurrences(scan, "base", "other").filter("x.context IS NOT NULL").select(F.explode(_families(F.col("x"))).alias("pattern"), "x.instance", "kind")
    edges = checkpoint(seen.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    seeds = edges.filter(F.col("kind") < len(NAMES)).select("instance", "kind").distinct().withColumn("belief", F.lit(1.0))
    links = edges.select("pattern", "instance")
    sizes = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.when(F.col("pattern").startswith("1:"), 4 * support).otherwise(support))
    links = checkpoint(links.join(sizes, "pattern"))
    beliefs = seeds
    patterns = None
    for _ in range(rounds):
        patterns = checkpoint(links.join(beliefs, "instance").groupBy("pattern", "n", "kind").agg(F.sum("belief").alias("s")).select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("trust")))
        derived = links.join(patterns, "pattern").groupBy("instance", "kind").agg(F.sum(F.log1p(-F.least("trust", F.lit(0.999999)))).alias("doubt")).select("instance", "kind", (1 - F.exp("doubt")).alias("belief"))
        beliefs = checkpoint(seeds.unionByName(derived).groupBy("instance", "kind").agg(F.max("belief").alias("belief")))
    best = patterns.groupBy("pattern").agg(F.max(F.struct("trust", (-F.col("kind")).alias("k"))).alias("b"))
    return checkpoint(best.filter(F.col("b.trust") >= trust).select("pattern", "b.trust", (-F.col("b.k")).alias("kind")))


def discovered(scan: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_id, _t, more): spans of the candidates by which a trusted pattern stands, for rows that have any; a candidate's kind is that of the most trusted."""
    occurrences = _occurrences(scan, "other").filter("x.context IS NOT NULL").select("_of", "_tie", "x.start", "x.end", F.explode(_families(F.col("x"))).alias("pattern"))
    few = patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    hits = occurrences.join(F.broadcast(patterns) if few else patterns, "pattern").groupBy("_of", "_tie", "start", "end").agg(F.max(F.struct("trust", (-F.col("kind")).alias("k"))).alias("b"))
    spans = hits.groupBy("_of", "_tie").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("b.k")).alias("kind"), "end"))).alias("more"))
    return spans.select(F.col("_of").alias("_id"), F.col("_tie").alias("_t"), "more")


def _spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


_BARE = "array<struct<start:int,kind:int,end:int>>"


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits: float) -> DataFrame:
    """Per row: ``key``, n_email, n_ip, n_card, n_phone (of the fixed patterns), base (their spans as
    'kind:start:end,...'), spans (with those that contexts add) and n_spans (all of them).

    Offsets are code points, the end exclusive. A null text counts as empty and has no spans; rows that
    repeat have equal spans each; null keys are kept; an empty table gives an empty result; further
    columns are left out, whatever their names. Each text is scanned once; all else uses its spans."""
    scan = scanned(docs, text, key)
    more = discovered(scan, trusted_patterns(scan, **limits))
    out = scan.join(more, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t")), "left")
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")  # noqa: E731  a second parameter of the inner one would be the place in the array
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = F.array_sort(F.concat(_bare(F.col("base")), F.coalesce("more", F.array().cast(_BARE))))
    return out.select(F.col("_of").alias(key), *counts, _spans_text(F.col("base")).alias("base"), _spans_text(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits: float) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets ([EMAIL], [IP], [CARD], [PHONE], [SECRET]); overlapping spans become one.

    Fixed patterns are found where the text stands; only the spans that contexts add are joined, to the
    texts they belong to: by broadcast if they are few rows (counted), else by key. Null texts stay null, and empty ones
    empty; rows that repeat are redacted each; null keys are kept; an empty table gives an empty result; further
    columns stay as they are, whatever their names."""
    scan = scanned(docs, text, key)
    more = checkpoint(discovered(scan, trusted_patterns(scan, **limits)))
    few = more.limit(50_001).count() <= 50_000
    whole = F.col("_text")
    rows = docs.select(F.col(f"`{key}`").alias("_of"), F.col(f"`{text}`").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    tie = F.xxhash64(F.coalesce(whole, F.lit("")))
    rows = rows.join(F.broadcast(more) if few else more, F.col("_of").eqNullSafe(F.col("_id")) & (tie == F.col("_t")), "left")
    none = F.array().cast(_BARE)
    spans = F.array_sort(F.concat(_bare(base_spans(whole)), F.coalesce("more", none)))
    last = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("kind"), F.lit(2**31 - 1).alias("end")))

    def join(held: Column, x: Column) -> tuple[Column, Column, Column]:
        apart = held.isNull() | (x["start"] >= held["end"])
        both = F.struct(held["start"].alias("start"), held["kind"].alias("kind"), F.greatest(held["end"], x["end"]).alias("end"))
        return F.when(apart, x).otherwise(both), apart & held.isNotNull(), held

    merged = let(F.concat(spans, last), lambda s: fold(s, F.lit(None).cast(_BARE[6:-1]), none, join)["out"])
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in NAMES))

    def put(m: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)
        pieces = F.transform(m, lambda x, i: F.concat(F.substring(whole, before(i) + 1, x["start"] - before(i)), F.get(tags, x["kind"])))
        rest = F.substring(whole, F.get(m, F.size(m) - 1)["end"] + 1, F.length(whole))
        return F.when(F.size(m) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(whole)

    redacted = F.when(whole.isNotNull(), let(merged, put))
    return rows.select(*(redacted.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns))
