"""Classifiers of edits: ingest categories, error taxonomy, mechanical labels, columns, boundaries, buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.distance import multiset_minus
from palimpsest.functions.text import (
    FILLERS,
    canonical,
    canonical_tokens,
    collapse_space,
    fold_sigma,
    no_punctuation,
    phonetic_skeleton,
    strip_marks,
    strip_reasoning,
    vowel_skeleton,
)

from .alignment import block_ratio, charged_pairs_udf

_ACUTE = ("άέήίόύώΆΈΉΊΌΎΏΐΰ", "αεηιουωΑΕΗΙΟΥΩϊϋ")  # fixed values: letters with and without the acute, diaeresis kept


def times(start: Column, end: Column, tolerance: float = 0.05) -> Column:
    """struct(start, end, swapped, invalid): ends reversed by less than ``tolerance`` are swapped, others are invalid; unreadable text is invalid."""
    a, b = start.try_cast("double"), end.try_cast("double")
    swap = (b < a) & (a - b < tolerance)
    bad = a.isNull() | b.isNull() | ((b < a) & ~swap)
    return F.struct(F.when(swap, b).otherwise(F.coalesce(a, F.lit(0.0))).alias("start"), F.when(swap, a).otherwise(F.coalesce(b, F.lit(0.0))).alias("end"), F.coalesce(swap, F.lit(False)).alias("swapped"), F.coalesce(bad, F.lit(True)).alias("invalid"))


def ingest(before: Column, after: Column, start: Column, end: Column) -> Column:
    """struct(ingest_category, cleaning_applied, before_text, after_text, start, end) of a raw edit row: the first category that holds."""
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    span, bare = times(start, end), strip_reasoning(b)
    stripped = bare != b
    clean_b, clean_a = collapse_space(bare), collapse_space(a)
    blank_b, blank_a = collapse_space(b) == "", collapse_space(a) == ""
    category = (
        F.when(stripped, "embedded_reasoning")
        .when(blank_b & blank_a, "noop_edit")
        .when(blank_b, "empty_before")
        .when(blank_a, "empty_after")
        .when(b == a, "noop_edit")
        .when(collapse_space(b) == clean_a, "whitespace_only")
        .when(span["invalid"], "reversed_timestamps")
        .when(b.contains("\n") | a.contains("\n"), "multiline_text")
        .otherwise("clean")
    )
    tags = F.array_compact(F.array(F.when(span["swapped"], F.lit("timestamps_swapped")), F.when(stripped, F.lit("reasoning_stripped")), F.when((clean_b != bare) | (clean_a != a), F.lit("whitespace_normalised"))))
    return F.struct(category.alias("ingest_category"), F.array_join(tags, ",").alias("cleaning_applied"), clean_b.alias("before_text"), clean_a.alias("after_text"), span["start"].alias("start"), span["end"].alias("end"))


def _let(value: Column, body) -> Column:
    """Evaluate once, use often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_CAPITALS = "Α-ΡΣ-ΫΆΈ-ΊΌΎΏ"


def _forms(x: Column) -> Column:
    """The forms of one text that the categories compare."""
    found = lambda pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    return F.struct(
        F.trim(x).alias("bare"),
        canonical(x).alias("canon"),
        collapse_space(no_punctuation(F.lower(F.trim(x)))).alias("flat"),
        canonical_tokens(x).alias("tokens"),
        found(r"\d+").alias("digits"),
        found(rf"[{_CAPITALS}]{{2,}}").alias("acronyms"),
        found(rf"(?<![\p{{L}}\p{{N}}_])[{_CAPITALS}][\p{{L}}\p{{N}}_]+").alias("names"),
    )


def error_category(before: Column, after: Column) -> Column:
    """One of twelve error categories of an edit: formatting first, then lexical kinds in order."""

    def formatting(b: Column, a: Column) -> Column:
        return (
            F.when(b["bare"] == a["bare"], "no_change")
            .when(b["flat"] == a["flat"], "punctuation_capitalization")
            .when(strip_marks(b["flat"]) == strip_marks(a["flat"]), "accent_tonos")
            .when(fold_sigma(b["flat"]) == fold_sigma(a["flat"]), "final_sigma")
            .otherwise("accent_tonos")
        )

    def lexical(b: Column, a: Column) -> Column:
        new = lambda kind: F.size(F.array_except(a[kind], b[kind])) > 0

        def by_tokens(only: Column) -> Column:
            paired = (F.size(only["b"]) == F.size(only["a"])) & (F.size(only["b"]) > 0)
            all_pairs = lambda same: F.forall(F.zip_with(only["b"], only["a"], same), lambda x: x)
            return (
                F.when((F.size(a["tokens"]) != F.size(b["tokens"])) & ((F.size(only["b"]) == 0) | (F.size(only["a"]) == 0)), "insertion_deletion")
                .when(paired & all_pairs(lambda x, y: phonetic_skeleton(x) == phonetic_skeleton(y)), "homophone")
                .when(paired & all_pairs(lambda x, y: F.left(x, F.lit(3)) == F.left(y, F.lit(3))), "morph_grammar")
                .otherwise("other_lexical")
            )

        only = F.struct(multiset_minus(b["tokens"], a["tokens"]).alias("b"), multiset_minus(a["tokens"], b["tokens"]).alias("a"))
        return (
            F.when(b["digits"] != a["digits"], "number_date")
            .when(new("acronyms"), "acronym_abbreviation")
            .when(F.translate(b["canon"], " ", "") == F.translate(a["canon"], " ", ""), "word_boundary")
            .when(new("names"), "named_entity")
            .otherwise(_let(only, by_tokens))
        )

    pair = F.struct(_forms(F.coalesce(before, F.lit(""))).alias("b"), _forms(F.coalesce(after, F.lit(""))).alias("a"))
    return _let(pair, lambda p: F.when(p["b"]["canon"] == p["a"]["canon"], formatting(p["b"], p["a"])).otherwise(lexical(p["b"], p["a"])))


def _no_acute(x: Column) -> Column:
    return F.translate(x, *_ACUTE)


def _core(x: Column) -> Column:
    return _no_acute(fold_sigma(F.lower(x)))


def mechanical_labels(before: Column, after: Column) -> Column:
    """Labels that an edit earns by mechanical rules alone; none where anything is uncertain. Several may hold at once."""
    a, b = collapse_ends(before), collapse_ends(after)
    same_core = _core(a) == _core(b)
    words = lambda x: F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")
    bare = lambda x: F.lower(collapse_space(F.regexp_replace(x, r"[^\p{L}\p{N}\s]+", "")))
    tight = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    homophones = F.zip_with(words(a), words(b), lambda x, y: F.when((x == y) | (_core(x) == _core(y)), 0).when((F.length(x) == F.length(y)) & (vowel_skeleton(x) == vowel_skeleton(y)), 1).otherwise(2))
    labels = [
        ("accent_tonos", same_core & (fold_sigma(F.lower(a)) != fold_sigma(F.lower(b)))),
        ("final_sigma", same_core & (_no_acute(F.lower(a)) != _no_acute(F.lower(b)))),
        ("word_boundary", (tight(a) == tight(b)) & (a != b)),
        ("homophone", (F.size(words(a)) == F.size(words(b))) & F.forall(homophones, lambda x: x < 2) & F.exists(homophones, lambda x: x == 1)),
        ("acronym_abbreviation", _acronym(a, b) | _acronym(b, a)),
        ("disfluency_cleanup", _disfluency(F.transform(words(a), lambda t: bare(_no_acute(t))), F.transform(words(b), lambda t: bare(_no_acute(t))))),
        ("punctuation_capitalization", bare(a) == bare(b)),
    ]
    out = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in labels)))
    none = F.array().cast("array<string>")
    return F.when((a == "") | (b == "") | (a == b) | a.contains("\n") | b.contains("\n") | a.isNull() | b.isNull(), none).otherwise(out)


def collapse_ends(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _disfluency(before: Column, after: Column) -> Column:
    """Whether ``after`` is ``before`` without some hesitation sounds and immediate repeats, matched greedily in order."""

    def walk(v: Column) -> Column:
        b, a = v["b"], v["a"]

        def step(acc: Column, i: Column) -> Column:
            x = F.get(b, i)
            hit = F.coalesce(x == F.get(a, acc["j"]), F.lit(False))
            fault = ~hit & ~(x.isin(*FILLERS) | F.coalesce(F.get(b, i - 1) == x, F.lit(False)))
            return F.struct((acc["j"] + hit.cast("int")).alias("j"), (acc["ok"] & ~fault).alias("ok"))

        end = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.struct(F.lit(0).alias("j"), F.lit(True).alias("ok")), step)
        return F.when((F.size(a) > 0) & (F.size(a) < F.size(b)), end["ok"] & (end["j"] == F.size(a))).otherwise(False)

    return _let(F.struct(before.alias("b"), after.alias("a")), walk)


def _acronym(spaced: Column, joined: Column) -> Column:
    """A run of three or more single Greek letters written as one upper-case word, the rest equal."""
    run = r"(?<!\S)(?:[α-ωΑ-Ω] ){2,}[α-ωΑ-Ω](?!\S)"
    s, j = collapse_space(spaced), collapse_space(joined)
    letters = F.regexp_extract(s, run, 0)
    return (letters != "") & (F.replace(s, letters, F.upper(F.translate(letters, " ", ""))) == j)


def column_class(column: Column) -> Column:
    """Class of three aligned entries (null is a gap): unanimous, two_of_three, all_different, pair, pair_split, single, empty."""
    words = F.array_compact(column)
    kinds = F.size(F.array_distinct(words))
    three = F.when(kinds == 1, "unanimous").when(kinds == 2, "two_of_three").otherwise("all_different")
    return F.when(F.size(words) == 3, three).when(F.size(words) == 2, F.when(kinds == 1, "pair").otherwise("pair_split")).when(F.size(words) == 1, "single").otherwise("empty")


def homophone_column(column: Column) -> Column:
    """Different words of one sound."""
    words = F.array_distinct(F.array_compact(column))
    return (F.size(words) > 1) & (F.size(F.array_distinct(F.transform(words, phonetic_skeleton))) == 1)


def boundary(words: Column, speech: Column, raw: Column, clip: Column, margin: float = 0.5, pad: float = 0.1, edge: float = 0.15, bleed: float = 0.3, ok_shift: float = 0.25, least_score: float = 0.3) -> Column:
    """struct(status, start_off, end_off, mean_score) of a clip from its aligned words and its speech segments."""
    sane = F.filter(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull() & ~F.isnan(w["start"]) & ~F.isnan(w["end"]) & (w["start"] >= 0) & (w["start"] < w["end"]) & (w["end"] <= clip + 1e-6) & (F.coalesce(w["text"], F.lit("")) != "<star>"))
    scored = F.filter(sane, lambda w: w["score"].isNotNull())
    mean = F.when(F.size(scored) > 0, F.aggregate(scored, F.lit(0.0), lambda acc, w: acc + w["score"]) / F.size(scored)).otherwise(0.0)
    low, high = F.lit(margin), F.least(F.lit(margin) + raw, clip)
    first = F.array_min(F.transform(sane, lambda w: w["start"]))
    last = F.array_max(F.transform(sane, lambda w: w["end"]))
    inside = lambda a, b: F.aggregate(speech, F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), F.least(s["end"], b) - F.greatest(s["start"], a)))
    start, end = F.greatest(F.lit(0.0), first - pad), F.least(clip, last + pad)
    failed = (F.size(sane) == 0) | (mean < least_score) | (last - first < 0.3 * (high - low)) | (last - first > clip)
    status = (
        F.when(failed, "align_failed")
        .when(first < low - edge, "suspect_cut_start")
        .when(last > high + edge, "suspect_cut_end")
        .when((inside(low, first) >= bleed) | (inside(last, high) >= bleed), "suspect_bleed_in")
        .when(F.greatest(F.abs(start - low), F.abs(end - high)) <= ok_shift, "ok")
        .otherwise("adjusted")
    )
    return F.struct(status.alias("status"), F.when(failed, low).otherwise(start).alias("start_off"), F.when(failed, high).otherwise(end).alias("end_off"), F.when(F.size(sane) > 0, mean).otherwise(0.0).alias("mean_score"))


def review_bucket(cer_backbone: Column, cer_second: Column, short: Column, keep: float = 0.15, audit: float = 0.35, drop: float = 0.7) -> Column:
    """Priority bucket of a row from two error rates."""
    return (
        F.when(short, "SHORT").when(cer_backbone.isNull(), "BACKBONE").when((cer_backbone >= drop) & (cer_second >= drop), "DROP")
        .when((cer_backbone <= keep) & (cer_second <= keep), "KEEP").when(F.least(cer_backbone, cer_second) <= audit, "AUDIT").otherwise("REVIEW")
    )


def post_edit_reason(source: Column, output: Column, distance: Column, source_words: Column, output_words: Column, low: float = 0.5, high: float = 1.5, most: float = 0.5) -> Column:
    """Why a rewritten transcript is rejected: the first reason, null if it is accepted."""
    out = F.coalesce(output, F.lit(""))
    return (
        F.when(F.trim(out) == "", "empty").when(out.contains("\n\n"), "multi_paragraph").when(F.lower(out).rlike(r"^\s*(note|explanation|corrected)\s*:"), "meta_marker")
        .when(output_words == 0, "no_tokens").when(~(output_words / F.greatest(F.lit(1), source_words)).between(low, high), "length_ratio")
        .when(distance / F.greatest(F.lit(1), source_words) > most, "too_far")
    )


def first_paragraph(text: Column) -> Column:
    return F.split_part(text, F.lit("\n\n"), F.lit(1))


def stepped(x: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    """The value of the first step whose upper bound is not exceeded."""
    return reduce(lambda out, s: F.when(x <= s[0], s[1]).otherwise(out), reversed(steps), F.lit(rest))


def base_score(weight: Column, cer_proxy: Column, n_edits: Column, word_diff: Column, char_diff: Column, duration: Column, class_weight: Column) -> Column:
    """Interest of a candidate: a product of step scores; fixed values below."""
    magnitude = F.greatest(F.lit(0.05), F.least(F.lit(1.0), (cer_proxy - 0.08) / 0.22))
    chain = stepped(n_edits, [(1, 1.0), (2, 0.95), (3, 0.8), (5, 0.55)], 0.25)
    words = stepped(word_diff, [(1, 1.1), (2, 1.0), (3, 0.75), (5, 0.45)], 0.15)
    seconds = F.when(duration.between(1.5, 12), 1.0).when((duration > 12) & (duration <= 25), 0.85).when((duration >= 0.8) & (duration < 1.5), 0.6).when(duration > 25, 0.55).otherwise(0.25)
    guard = F.when(word_diff >= 8, 0.0).when(cer_proxy >= 0.55, 0.15).when(char_diff <= 2, 0.25).otherwise(1.0)
    return weight * magnitude * chain * words * seconds * class_weight * guard


# --- error classes of a benchmark ----------------------------------------------------------------------------------

# Number words and function words; spellings of one sound, applied in this order.
NUMBER_WORDS = "μηδέν ένα ενός μία μια δύο δυο τρία τρεις τέσσερα τέσσερις πέντε έξι εφτά επτά οχτώ οκτώ εννιά εννέα δέκα έντεκα δώδεκα είκοσι τριάντα σαράντα πενήντα εξήντα εβδομήντα ογδόντα ενενήντα εκατό διακόσια τριακόσια χίλια χιλιάδες εκατομμύρια εκατομμύριο".split()
FUNCTION_WORDS = "ο η το του της των τον την τα οι ένας μια ένα στο στη στην στον στα στους στις σε με και κι που πως ως για από ή αν να θα δεν μη μην αυτό αυτή αυτός εγώ εμείς εσείς μας σας τους τις".split()
SOUNDS = (("ει", "ι"), ("οι", "ι"), ("υι", "ι"), ("η", "ι"), ("υ", "ι"), ("ω", "ο"), ("αι", "ε"), ("μπ", "b"), ("ντ", "d"), ("γκ", "g"), ("γγ", "g"), ("αυ", "af"), ("ευ", "ef"))


def sound_key(word: Column) -> Column:
    """A word by its sounds; what an earlier rule has changed a later one sees."""
    out = fold_sigma(strip_marks(F.lower(word)))
    for a, b in SOUNDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def error_class(ref: Column, hyp: Column) -> Column:
    """The class of one charged word, the first that holds: deletion, insertion, identical, final_sigma, accent_tonos, homophone, number_date, article_pronoun,
    acronym_abbreviation, inflection_or_nearmiss, substitution_phonetic_or_word. A word that is missing is null."""
    r, h = F.lower(ref), F.lower(hyp)
    bare_r, bare_h = strip_marks(r), strip_marks(h)
    n, longest = F.least(F.length(r), F.length(h)), F.greatest(F.length(r), F.length(h))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.substring(bare_r, i, F.lit(1)) != F.substring(bare_h, i, F.lit(1)))
    stem = F.coalesce(F.get(differs, F.lit(0)) - 1, n)
    near = (stem >= F.greatest(F.lit(3), F.floor(0.6 * longest))) | (block_ratio(bare_r, bare_h) >= 0.75)
    return (
        F.when(hyp.isNull(), "deletion").when(ref.isNull(), "insertion").when(r == h, "identical").when(fold_sigma(r) == fold_sigma(h), "final_sigma").when(bare_r == bare_h, "accent_tonos")
        .when(fold_sigma(bare_r) == fold_sigma(bare_h), "final_sigma").when(sound_key(r) == sound_key(h), "homophone")
        .when(r.isin(NUMBER_WORDS) | h.isin(NUMBER_WORDS) | F.concat(r, h).rlike(r"\d"), "number_date").when(r.isin(FUNCTION_WORDS) & h.isin(FUNCTION_WORDS), "article_pronoun")
        .when(n <= 2, "acronym_abbreviation").when(near, "inflection_or_nearmiss").otherwise("substitution_phonetic_or_word")
    )


def charged_words(rows: DataFrame, keys: list[str], ref: str, hyp: str) -> DataFrame:
    """(keys, place, ref, hyp) of every word between the matching blocks of two token arrays: words of a replaced run in pairs as long as both have one."""
    pairs = rows.select(*keys, F.explode(charged_pairs_udf(ref, hyp)).alias("_p"))
    return pairs.select(*keys, F.col("_p.place").alias("place"), F.col("_p.ref").alias("ref"), F.col("_p.hyp").alias("hyp"))
