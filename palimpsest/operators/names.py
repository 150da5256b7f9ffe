"""Repair of names against a meeting's closed list: nearest and second nearest spelling, abstentions, and the rewritten text.

Every word of a text gets one outcome. It is repaired only where one name of the list is near enough
for its length, clearly nearer than any other, borne by one person, and, if two edits away, vouched for by
what stands around it; in every other case the outcome says why the word was left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import WORD_CLASS, fold_sigma, plain
from palimpsest.session import cut

from .fuzzy import name_blocks, swap_pairs
from .review import SURNAME_ENDINGS, other_case_of

# Words before a name; how often a word must be seen to count as common.
TITLES = ("κ.", "κ", "κυριοσ", "κυρια", "κυριε")
COMMON = 5

OUTCOMES = ("fire", "abstain_tie", "abstain_margin", "abstain_multi_person", "abstain_common", "abstain_already_valid", "abstain_no_signal", "abstain_suffix_family", "no_candidate")


def form(text: Column) -> Column:
    """The form in which names are compared: no marks, lower case, one sigma."""
    return fold_sigma(plain(text))


def length_allows(length: Column, distance: Column) -> Column:
    """One edit from 6 letters on, two from 10 on if they are a fifth of the letters at most."""
    return F.when(length < 6, False).when(length <= 9, distance == 1).otherwise((distance <= 2) & (5 * distance <= length))


def nearest_names(tokens: DataFrame, roster: DataFrame, meeting: str, token: str = "token") -> DataFrame:
    """Of each (meeting, token) that may be repaired by its length the nearest name: term, alias, surface, persons, distance, ties (names as near) and second (the distance of the next, null from two edits more on).

    Tokens of up to 9 letters may need one edit, longer ones two. One edit more is looked at for tokens that one name alone is as near to, to see whether a second
    is: most tokens are settled before, and words within three edits of each other are many.

    ``roster``: meeting, term, place (order of a term's spellings), surface, persons, and alias, the compared form, if it is made already. A term's distance is that of its nearest spelling, the first
    of equals; of terms as near the least stands for them."""
    spelled = roster if "alias" in roster.columns else cut(roster.withColumn("alias", form(F.col("surface"))))
    theirs = name_blocks(spelled, meeting, "alias")
    short = F.length(token) <= 9

    def within(rows: DataFrame, few: int) -> DataFrame:
        """Names within ``few`` edits of short tokens, one more of others."""
        return swap_pairs(name_blocks(rows, meeting, token, F.when(short, few).otherwise(few + 1)), theirs, meeting, token, "alias").join(spelled, [meeting, "alias"])

    each = within(cut(tokens.select(meeting, token).distinct()), 1).groupBy(meeting, token, "term").agg(F.min(F.struct("distance", "place", "alias", "surface", "persons")).alias("n"))
    w = Window.partitionBy(meeting, token).orderBy("n.distance", "term")
    ranked = each.select(meeting, token, "term", "n.*", F.row_number().over(w).alias("_r"), F.lead("n.distance").over(w).alias("second"), F.count(F.lit(1)).over(Window.partitionBy(meeting, token, "n.distance")).alias("ties"))
    best = cut(ranked.filter((F.col("_r") == 1) & length_allows(F.length(token), F.col("distance"))).select(meeting, token, "term", "alias", "surface", "persons", "distance", "ties", "second"))
    alone = best.filter(F.col("second").isNull() & (F.col("distance") == F.when(short, 1).otherwise(2))).select(meeting, token, F.col("term").alias("_own"))
    more = within(alone, 2).join(alone, [meeting, token]).filter(~F.col("term").eqNullSafe(F.col("_own"))).groupBy(meeting, token).agg(F.min("distance").alias("_next"))
    return best.join(more, [meeting, token], "left").withColumn("second", F.coalesce("second", "_next")).drop("_next")


def signals(texts: DataFrame, first_names: DataFrame, key: str, meeting: str, text: str, titles: tuple[str, ...] = TITLES) -> DataFrame:
    """Of each (key, token) whether any of its places has a capital within a sentence, a title beside it, or a first name (meeting, name) beside it."""
    word = rf"([{WORD_CLASS}.]+)"
    around = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get(ws, i - 1)).alias("before"), F.get(ws, i + 1).alias("after")))
    words = F.get(F.transform(F.array(F.regexp_extract_all(F.col(text), F.lit(word), F.lit(1))), around), F.lit(0))
    rows = texts.select(F.col(key).alias("_key"), F.col(meeting).alias("_in"), F.explode(words).alias("w")).select("_key", "_in", "w.*")
    rows = rows.select("_key", "_in", "word", "before", form(F.regexp_replace("word", r"\.$", "")).alias("token"), F.explode(F.array_compact(F.array(form(F.col("before")), form(F.col("after")), F.lit("")))).alias("beside"))
    names = first_names.select(F.col(meeting).alias("_of"), form(F.col("name")).alias("_name")).filter("_name <> ''").distinct()
    joined = rows.join(names, (F.col("_in") == F.col("_of")) & (F.col("beside") == F.col("_name")), "left")
    letter = F.left("word", F.lit(1))
    capital = (letter == F.upper(letter)) & (letter != F.lower(letter)) & (F.col("before") != "") & ~F.col("before").rlike(r"[.;!?]$")
    found = joined.groupBy("_key", "token").agg(F.max(F.coalesce(capital, F.lit(False)) | F.col("beside").isin(*titles) | F.col("_name").isNotNull()).alias("signal"))
    return found.select(F.col("_key").alias(key), "token", "signal")


def outcomes(texts: DataFrame, roster: DataFrame, first_names: DataFrame, seen: DataFrame, key: str, meeting: str, text: str, endings: tuple[str, ...] = SURNAME_ENDINGS, titles: tuple[str, ...] = TITLES, common: int = COMMON) -> DataFrame:
    """(key, token, decision, term, surface, distance) for every different word of every text, in its compared form; one of ``OUTCOMES``.

    ``seen``: token, n, how often a word was seen elsewhere. A text whose meeting has no list gives ``no_candidate`` for all its words; null and empty
    texts have no words. ``term``, ``surface`` and ``distance`` are those of the nearest name where it is near enough to be looked at."""
    tokens = texts.select(F.col(key).alias("_key"), F.col(meeting).alias("_in"), F.explode(F.array_distinct(F.regexp_extract_all(form(F.col(text)), F.lit(f"([{WORD_CLASS}]+)"), F.lit(1)))).alias("token"))
    roster = cut(roster.withColumn("alias", form(F.col("surface"))))
    valid = roster.select(F.col(meeting).alias("_in"), F.col("alias").alias("token")).distinct()
    per = tokens.filter(F.length("token") >= 6).select("_in", "token").distinct().join(valid, ["_in", "token"], "left_anti")
    near = nearest_names(per.withColumnRenamed("_in", meeting), roster, meeting).withColumnRenamed(meeting, "_in")
    often = seen.groupBy("token").agg(F.sum("n").alias("_n"))
    two = F.col("distance") == 2
    decision = (
        F.when(F.col("ties") > 1, "abstain_tie")
        .when(F.col("second") < F.col("distance") + 2, "abstain_margin")
        .when(F.col("_n") >= common, "abstain_common")
        .when(F.col("persons") != 1, "abstain_multi_person")
        .when(two & other_case_of(F.col("token"), F.col("alias"), endings), "abstain_suffix_family")
        .when(two, "abstain_no_signal")  # unless the text has one
        .otherwise("fire")
    )
    judged = near.join(often, "token", "left").select("_in", "token", decision.alias("_as"), "term", "surface", "distance")
    judged = cut(judged.unionByName(valid.withColumn("_as", F.lit("abstain_already_valid")), allowMissingColumns=True))  # a word of a meeting is judged once
    rows = tokens.join(judged, ["_in", "token"], "left")
    unsure = tokens.join(judged.filter("_as = 'abstain_no_signal'").select("_in", "token"), ["_in", "token"], "left_semi")
    heard = signals(texts.join(unsure.select(F.col("_key").alias(key)).distinct(), key, "left_semi"), first_names, key, meeting, text, titles).filter("signal").select(F.col(key).alias("_key"), "token", "signal")
    rows = rows.join(heard, ["_key", "token"], "left")
    settled = F.when((F.col("_as") == "abstain_no_signal") & F.col("signal"), "fire").otherwise(F.coalesce("_as", F.lit("no_candidate")))
    return rows.select(F.col("_key").alias(key), "token", settled.alias("decision"), "term", "surface", "distance")


def in_case_of(original: Column, replacement: Column) -> Column:
    """All capitals if the original word has only these, else a first capital if it has one."""
    first = F.left(original, F.lit(1))
    capital = (first == F.upper(first)) & (first != F.lower(first))
    all_of_it = (F.length(original) > 1) & (original == F.upper(original)) & (original != F.lower(original))
    return F.when(all_of_it, F.upper(replacement)).when(capital, F.concat(F.upper(F.left(replacement, F.lit(1))), F.substring(replacement, F.lit(2), F.length(replacement)))).otherwise(replacement)


def _fires(decided: DataFrame, key: str) -> DataFrame:
    return decided.filter("decision = 'fire'").select(F.col(key).alias("_k"), F.col("token").alias("_t"), "term", "surface", "distance")


def changes(texts: DataFrame, decided: DataFrame, key: str, text: str) -> DataFrame:
    """Where texts are changed: key, start, end (code points), original, replacement, term, distance. ``decided``: ``outcomes``. A word that has the name's form already is none."""
    fires = cut(_fires(decided, key))
    parts = texts.join(fires.select(F.col("_k").alias(key)).distinct(), key, "left_semi").select(key, F.posexplode(F.regexp_extract_all(text, F.lit(rf"([{WORD_CLASS}]+|[^{WORD_CLASS}]+)"), F.lit(1))).alias("_i", "original"))
    placed = parts.withColumn("end", F.sum(F.length("original")).over(Window.partitionBy(key).orderBy("_i"))).withColumn("start", F.col("end") - F.length("original"))
    hit = placed.join(fires, (F.col(key) == F.col("_k")) & (form(F.col("original")) == F.col("_t"))).withColumn("replacement", in_case_of(F.col("original"), F.col("surface")))
    return hit.filter("replacement <> original").select(key, "start", "end", "original", "replacement", "term", "distance")


def repaired(texts: DataFrame, decided: DataFrame, key: str, text: str) -> DataFrame:
    """``texts`` with names put right in ``text``; all else stays as it is, letter for letter. Keys are unique; null texts stay null."""
    fires = _fires(decided, key).groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_t", "surface"))).alias("_names"))  # words of one text
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"([{WORD_CLASS}]+|[^{WORD_CLASS}]+)"), F.lit(1))
    new = F.array_join(F.transform(pieces, lambda p: F.coalesce(in_case_of(p, F.element_at("_names", form(p))), p)), "")
    return texts.join(fires, F.col(key) == F.col("_k"), "left").withColumn(text, F.when(F.col("_names").isNull(), F.col(text)).otherwise(new)).drop("_k", "_names")
