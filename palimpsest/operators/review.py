"""Review queues and reports: filters, queues by category, progress, routing, invariants of packs, censuses, name and term rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import canonical, canonical_tokens, has_overlap_marker

# Former category ids and what they are called now.
LEGACY_CATEGORIES = {
    "asr_phonetic": "substitution_phonetic",
    "domain_term": "legal_admin_term",
    "named_entity": "person_name",
    "punctuation": "punctuation_capitalization",
    "capitalization": "punctuation_capitalization",
    "formatting_only": "punctuation_capitalization",
    "semantic_context": "semantic_rewrite",
    "speaker_or_attribution": "person_name",
    "timestamp_alignment": "timestamp_misalignment",
    "same_or_no_meaningful_change": "unusable",
    "malformed_or_unclear": "unusable",
}


def category_id(raw: Column, known: list[str]) -> Column:
    """A present category id, or what a former one is called now; null for any other."""
    names = F.create_map(*map(F.lit, chain.from_iterable(LEGACY_CATEGORIES.items())))
    return F.when(raw.isin(*known), raw).otherwise(F.element_at(names, raw))


def matches_filter(profile: Column, punctuation_only: Column, drop_punctuation: bool, sources: list[str] | None) -> Column:
    """Whether a group is in the queue: not one of punctuation alone where these are dropped, and of a source that is asked for."""
    wanted = F.lit(True) if sources is None else F.coalesce(profile.isin(*sources), F.lit(False))
    return wanted & ~(F.lit(drop_punctuation) & F.coalesce(punctuation_only, F.lit(False)))


def noted(rows: DataFrame, note: str) -> DataFrame:
    """Rows with a note that is not blank, and whether it marks overlap."""
    text = F.trim(F.col(note))
    return rows.filter(text != "").withColumn("marked", has_overlap_marker(text))


def queue_of(rows: DataFrame, key: str, category: str, wanted: str, order: str) -> DataFrame:
    """Distinct keys of a category by the place where they come first (``place``)."""
    return rows.filter(F.col(category) == wanted).groupBy(key).agg(F.min(order).alias("place"))


def progress(ids: DataFrame, labels: DataFrame, key: str, source: str) -> DataFrame:
    """(what, n): all keys, labelled and remaining ones, and labels by source."""
    total, done = F.count(F.lit(1)), F.count_if(F.col("_done"))
    seen = ids.select(key).join(labels.select(key).distinct().withColumn("_done", F.lit(True)), key, "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    facts = seen.agg(F.array(F.struct(F.lit("total").alias("what"), total.alias("n")), F.struct(F.lit("labeled").alias("what"), done.alias("n")), F.struct(F.lit("remaining").alias("what"), (total - done).alias("n"))).alias("x"))
    return facts.select(F.explode("x").alias("x")).select("x.*").unionByName(labels.groupBy(F.concat(F.lit("source:"), F.col(source)).alias("what")).agg(F.count(F.lit(1)).alias("n")))


def route(category: Column, plain: Column, helped: Column, acoustic: list[str], formatting: list[str]) -> Column:
    """struct(to, effect): where a category's errors are best mended, from the fix rates without and with a glossary."""
    best, lift = F.greatest(plain, helped), helped - plain
    to = F.when(best >= 0.7, "llm_post_correction").when((best < 0.4) & category.isin(*acoustic), "asr_finetune").when(category.isin(*formatting), "rule_based").otherwise("review")
    return F.struct(to.alias("to"), F.when(lift >= 0.05, "helps").when(lift <= -0.05, "hurts").otherwise("none").alias("effect"))


def incumbent_order(rate: str, length: str, name: str, incumbent: str) -> list[Column]:
    """Sort columns: the lowest rate (unknown as 2), the shorter, the incumbent, then the name."""
    return [F.coalesce(F.col(rate), F.lit(2.0)).asc(), F.coalesce(F.col(length), F.lit(10**9)).asc(), (F.col(name) != incumbent).asc(), F.col(name).asc()]


def short_text(text: Column) -> Column:
    """Fewer than 20 letters or 5 words in canonical form."""
    return (F.length(canonical(text)) < 20) | (F.size(canonical_tokens(text)) < 5)


def pack_faults(items: DataFrame, source: DataFrame, item: str, city: str, grid: float = 0.02, longest: float = 30.0, latest: float = 1.0, points: float = 2.0) -> DataFrame:
    """(fault, what) where packs break a rule; none if they are sound. ``items``: pack, ``item``, t_start, t_end; ``source``: ``item``, ``city``, start, end.

    An item is in one pack, a pack fits the window and begins early, times rise and keep the source's lengths to a grid step,
    and each city's share of the seconds is within ``points`` of a hundred of its share in the source."""
    w = Window.partitionBy("pack").orderBy("t_start", "t_end")
    placed = items.join(source.select(item, city, "start", "end"), item).withColumns({"_before": F.lag("t_start").over(w), "_length": F.col("t_end") - F.col("t_start"), "_source": F.col("end") - F.col("start")})
    fault = lambda df, name, what: df.select(F.lit(name).alias("fault"), F.col(what).cast("string").alias("what")).distinct()
    found = fault(items.groupBy(item).agg(F.count_distinct("pack").alias("n")).filter("n > 1"), "repeated", item)
    found = found.unionByName(fault(placed.filter((F.col("t_start") < 0) | (F.col("_length") <= 0) | (F.col("t_start") < F.col("_before"))), "order", "pack"))
    found = found.unionByName(fault(placed.filter(F.abs(F.col("_length") - F.col("_source")) > grid + 1e-9), "length", "pack"))
    ends = items.groupBy("pack").agg(F.min("t_start").alias("a"), F.max("t_end").alias("b"))
    found = found.unionByName(fault(ends.filter(F.col("b") > longest), "too_long", "pack")).unionByName(fault(ends.filter(F.col("a") > latest), "late", "pack"))
    cities = placed.groupBy(city).agg(F.sum("_length").alias("l"), F.sum("_source").alias("s"))
    whole = cities.agg(F.sum("l").alias("l"), F.sum("s").alias("s")).first()  # one row
    share = F.abs(F.col("l") / F.lit(whole["l"] or 1.0) - F.col("s") / F.lit(whole["s"] or 1.0)) * 100
    return found.unionByName(fault(cities.filter(share > points), "share", city))


def census(rows: DataFrame, convention: Column, omission: Column, op: str = "op") -> DataFrame:
    """(bucket, n): each charged edit in one of three buckets, convention before reference omission before ours; insertions alone can be omissions."""
    bucket = F.when((F.col(op) != "I") & F.coalesce(convention, F.lit(False)), "convention").when((F.col(op) == "I") & F.coalesce(omission, F.lit(False)), "ref_omission").otherwise("ours")
    return rows.filter(F.col(op).isin("S", "D", "I")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def keep_rates(rows: DataFrame, score: str, kept: Column, width: float = 0.1) -> DataFrame:
    """Rows, kept rows and their share by score bin."""
    return rows.groupBy((F.floor(F.col(score) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), (F.count_if(kept) / F.count(F.lit(1))).alias("share"))


def near_miss(distance: Column, length: Column) -> Column:
    """Whether a form is near enough to a term to be a slip of it: one edit, two on five letters or more, else up to 34 of 100 letters and four edits."""
    return distance.between(1, 4) & ((distance == 1) | ((distance == 2) & (length >= 5)) | (distance / F.greatest(F.lit(1), length) <= 0.34))


def trimmed(tokens: Column, edge: list[str]) -> Column:
    """``tokens`` without the words of ``edge`` at either end; the last one left stays."""
    keep = lambda t, i: F.struct(i.alias("i"), (~t.isin(*edge)).alias("k"))
    kept = F.transform(F.filter(F.transform(tokens, keep), lambda x: x["k"]), lambda x: x["i"])
    low, high = F.coalesce(F.array_min(kept), F.size(tokens) - 1), F.coalesce(F.array_max(kept), F.size(tokens) - 1)
    return F.when(F.size(tokens) > 0, F.slice(tokens, low + 1, high - low + 1)).otherwise(tokens)


def suffix_neighbours(a: Column, b: Column, least: int = 4, most: int = 4) -> Column:
    """Two different words that share their first ``least`` letters or more and have tails of ``most`` letters or fewer."""
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    shared = F.coalesce(F.get(differ, F.lit(0)) - 1, F.least(F.length(a), F.length(b)))
    return (a != b) & (shared >= least) & (F.length(a) - shared <= most) & (F.length(b) - shared <= most)


def suffix_pairs(words: DataFrame, word: str, least: int = 4, most: int = 4) -> DataFrame:
    """(a, b): all pairs of ``suffix_neighbours`` among different words.

    Two such words share as many letters as the longer one has but for its tail, so they meet by that beginning, of a length
    that both can have; a short beginning that many words share brings only words of its own length together."""
    once = words.select(F.col(word).alias("_w")).filter(F.length("_w") >= least).distinct()
    lengths = F.sequence(F.greatest(F.lit(least), F.length("_w") - most), F.length("_w"))
    keyed = once.select("_w", F.explode(lengths).alias("_k")).withColumn("_stem", F.expr("left(_w, _k)"))
    a, b = keyed.withColumnRenamed("_w", "a"), keyed.withColumnRenamed("_w", "b")
    met = a.join(b, ["_k", "_stem"]).filter((F.col("a") != F.col("b")) & (F.col("_k") == F.greatest(F.lit(least), F.greatest(F.length("a"), F.length("b")) - most)))
    return met.filter(suffix_neighbours(F.col("a"), F.col("b"), least, most)).select("a", "b")


def single_consonants(text: Column, letters: str = "βγδζθκλμνξπρσςτφχψ") -> Column:
    """Runs of one consonant as one letter; vowels stay as they are, for doubled ones are syllables."""
    return F.regexp_replace(text, f"([{letters}])\\1+", "$1")


def edit_kind(before: Column, after: Column, names: Column, terms: Column) -> Column:
    """Kind of one edit operation (token arrays before and after it), the first that holds: number, roster-name, glossary-term, spelling-tweak, other-lexical."""
    both = F.concat(before, after)
    b, a = F.array_join(before, " "), F.array_join(after, " ")
    limit = F.greatest(F.lit(2), F.floor(0.34 * F.greatest(F.length(b), F.length(a))))
    return (
        F.when(F.concat(b, F.lit(" "), a).rlike(r"\d"), "number")
        .when(F.arrays_overlap(both, names), "roster-name")
        .when(F.arrays_overlap(both, terms), "glossary-term")
        .when((F.size(before) > 0) & (F.size(after) > 0) & (F.levenshtein(b, a) <= limit), "spelling-tweak")
        .otherwise("other-lexical")
    )


def ranked_names(rows: DataFrame, keys: list[str], name: str, salt: str) -> DataFrame:
    """Distinct names (by canonical form, the first in order) of a key, ranked from 1 by a salted SHA-256 of the key and the form."""
    form = canonical(F.col(name))
    owner = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    once = rows.withColumn("_form", form).filter("_form <> ''").groupBy(*keys, "_form").agg(F.min(name).alias(name))
    w = Window.partitionBy(*keys).orderBy("_h", "_form")
    return once.withColumn("_h", F.sha2(F.concat(F.lit(salt), owner, F.col("_form")), 256)).withColumn("rank", F.row_number().over(w)).select(*keys, name, "rank")


def present_terms(terms: DataFrame, entries: DataFrame, keys: list[str], term: str, entry: str) -> DataFrame:
    """(keys, term): terms whose form is a word of one of the key's roster entries."""
    words = entries.select(*keys, F.explode(canonical_tokens(F.col(entry))).alias("_w")).distinct()
    return words.join(terms.select(F.col(term), canonical(F.col(term)).alias("_w")).distinct(), "_w").select(*keys, term).distinct()


# Endings of surnames in other cases.
SURNAME_ENDINGS = ("οπουλου", "ιδου", "ακου", "ακη", "ου")


def other_case_of(token: Column, alias: Column, endings: tuple[str, ...] = SURNAME_ENDINGS) -> Column:
    """Whether a token is likely another case of an alias: without one of the endings it is how the alias begins."""
    out = F.lit(False)
    for ending in endings:
        stem = F.left(token, F.length(token) - len(ending))
        out = out | (token.endswith(ending) & (stem != "") & alias.startswith(stem))
    return out


def reader_class(relation: Column, numeric: Column, protocol: Column, entity: Column, function_pair: Column) -> Column:
    """What a difference is to a reader: artefacts first, then kinds of words that matter, then how the words are related."""
    return (
        F.when(relation == "alignment_artifact", "alignment_artifact").when(numeric, "numeric_identifier").when(protocol, "protocol_legal").when(entity, "named_entity")
        .when(relation == "no_target", "no_target").when(relation == "phonemic_key_equivalent", "orthography_homophone")
        .when(relation == "surface_suffix_neighbor", "morphology_suffix_neighbor").when(function_pair, "function_word_pair").otherwise("different_content_word")
    )


def answers_outcome(answers: Column, minority: Column, abstain: str, least: int = 0) -> Column:
    """What the passes over one question come to, the first that holds: invalid (a pass is missing or has neither abstained nor a token), abstain_explicit,
    order_disagree (different tokens), override (the minority's token, and every confidence is ``least`` or more), confirm.

    ``answers``: array of struct(pick, token, conf), one for each pass, null where there is none."""
    bad = lambda a: a.isNull() | a["pick"].isNull() | ((a["pick"] != abstain) & (a["token"].isNull() | a["conf"].isNull()))
    token = F.get(answers, F.lit(0))["token"]
    return (
        F.when((F.size(answers) == 0) | F.exists(answers, bad), "invalid")
        .when(F.exists(answers, lambda a: a["pick"] == abstain), "abstain_explicit")
        .when(F.exists(answers, lambda a: a["token"] != token), "order_disagree")
        .when((token == minority) & F.forall(answers, lambda a: a["conf"] >= least), "override")
        .otherwise("confirm")
    )
