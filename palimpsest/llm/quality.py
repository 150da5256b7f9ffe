"""Host-level quality rules.

Each text is measured by array functions of Spark alone; rule failures are summed by host,
their rates drawn towards what hosts usually have by a beta prior fitted to the hosts
themselves, and the verdicts on hosts joined back to documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, WORD_GAP, call, checkpoint, let

SYMBOLS = "#*$%&|<>"
RULES = ("base", "symbols", "dup_lines")
#: Hosts broadcast at most; a verdict is some 30 bytes.
BROADCAST_HOSTS = 100_000


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    A window's hash and position share one long, so that sorting longs brings equal windows
    together; neighbours count once their words are seen to be equal. The hash keeps all bits
    the position leaves (49 of 64 for a text of 20,000 words)."""

    def of(w: Column) -> Column:
        last = F.size(w) - 3
        bits = F.ceil(F.log2(F.size(w).cast("double"))).cast("int")

        def flagged(packed: Column) -> Column:
            mask = call("shiftleft", F.lit(1).cast("long"), bits) - 1

            def same(a: Column, b: Column) -> Column:
                i, j = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
                equal = reduce(lambda x, y: x & y, [F.get(w, i + k) == F.get(w, j + k) for k in range(3)])
                near = call("shiftrightunsigned", a.bitwiseXOR(b), bits) == 0
                return F.when(near & equal, F.array(i, j))

            pairs = F.zip_with(F.slice(packed, F.lit(1), last), F.slice(packed, F.lit(2), last), same)
            starts = F.array_distinct(F.flatten(F.array_compact(pairs)))
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        packed = F.transform(F.sequence(F.lit(0), last), lambda i: call("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))
        return F.when(last < 1, F.lit(0)).otherwise(let(F.sort_array(packed), flagged))

    return let(words, of).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with word and line counts of each whole text (null: as if empty) and ``base_failed``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(GAP_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "")

    def measure(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    out = docs.withColumns({"_words": let(words, measure), "_lines": let(lines, line_counts)})
    out = out.withColumns({
        "n_words": F.col("_words.n_words"),
        "word_chars": F.length(F.translate(whole, GAP_CHARS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": F.col("_lines.n_lines"),
        "n_dup_lines": F.col("_lines.n_dup_lines"),
        "n_repeat_words": F.col("_words.n_repeat_words"),
    }).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def failures() -> dict[str, Column]:
    """Rule -> whether a measured text fails it."""
    return {
        "base": F.col("base_failed"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        # One repeated heading in a text of three lines is no fault.
        "dup_lines": (F.col("n_dup_lines") >= 5) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    }


def _prior(total: int | None, hosts: int, failed: int | None, squares: float | None) -> tuple[float, float]:
    """Mean and concentration of the beta prior, from the hosts' documents, failures and n * rate**2."""
    if not total:
        return 0.0, 1.0
    m = failed / total
    between = squares / total - m * m - m * (1 - m) * hosts / total
    return m, 10_000.0 if between <= 0 else min(10_000.0, max(1.0, m * (1 - m) / between - 1))


def host_verdicts(measured: DataFrame, host: str = "source", tolerance: float = 0.02, block: float = 0.5) -> DataFrame:
    """One row per host: documents, shrunk failure rate of each rule, ``watched_<rule>`` and ``blocked``.

    A rate f/n becomes (f + m*k)/(n + k): m is the rate over all hosts, and k the concentration
    of the beta distribution that has the mean m and the variance between hosts that sampling does
    not explain (method of moments, k within 1..10,000). A host is watched on a rule when its
    shrunk rate exceeds ``tolerance``, and blocked when that of the base rule exceeds ``block``.
    A null host is a host of its own. The host sums are pre-aggregated in every task, so a host
    that holds a third of all rows is a few partial rows; the table grows with hosts only."""
    sums = measured.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(f.cast("long")).alias(f"_f_{r}") for r, f in failures().items()))
    rates = {r: F.col(f"_f_{r}") / F.col("_n") for r in RULES}
    sums = checkpoint(sums)
    whole = sums.agg(F.sum("_n").alias("total"), F.count(F.lit(1)).alias("hosts"), *(F.sum(f"_f_{r}").alias(f"t_{r}") for r in RULES), *(F.sum(F.col("_n") * (F.col(f"_f_{r}") / F.col("_n")) * (F.col(f"_f_{r}") / F.col("_n"))).alias(f"q_{r}") for r in RULES)).first()  # one row
    out = sums
    for r in RULES:
        m, k = _prior(whole["total"], whole["hosts"], whole[f"t_{r}"], whole[f"q_{r}"])
        out = out.withColumn(f"rate_{r}", (F.col(f"_f_{r}") + F.lit(m * k)) / (F.col("_n") + F.lit(k)))
    return out.select("_host", *(f"rate_{r}" for r in RULES), *((F.col(f"rate_{r}") > tolerance).alias(f"watched_{r}") for r in RULES), (F.col("rate_base") > block).alias("blocked"))


def judge(measured: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """``measured`` with ``kept``: false for a base failure, for any document of a blocked host, and for one
    that fails a rule its host is watched on."""
    few = verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    out = measured.join(F.broadcast(verdicts) if few else verdicts, measured[host].eqNullSafe(verdicts["_host"]), "left")
    bad = reduce(lambda a, b: a | b, [f & F.col(f"watched_{r}") for r, f in failures().items()])
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("blocked") | bad, F.lit(False))
    return out.withColumn("kept", kept)


_OWN = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def score(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", **limits: float) -> DataFrame:
    """Measures and verdict of every document: ``key``, ``host`` and the columns of ``measures`` and ``judge``.

    A null text counts as empty (so it fails the base rule); rows repeat as they come; ties do not
    arise; an empty table gives an empty result; further columns are left out, so their names
    cannot clash. Texts are measured once: their few numbers are checkpointed, and both the host sums
    and the result are made of these."""
    measured = checkpoint(measures(docs.select(F.col(key), F.col(host), F.col(text)), text).drop(text))
    out = judge(measured, checkpoint(host_verdicts(measured, host, **limits)), host)
    return out.select(key, host, *_OWN)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", **limits: float) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Measures are made again rather than joined to the texts, which then need no shuffle."""
    rows = docs.select(F.col(text).alias("_text"), F.col(host).alias("_of"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    verdicts = checkpoint(host_verdicts(measures(rows.select("_text", "_of"), "_text").drop("_text"), "_of", **limits))
    return judge(measures(rows, "_text"), verdicts, "_of").filter("kept").select("_row.*")
