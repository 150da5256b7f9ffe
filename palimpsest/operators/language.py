"""Terms and n-gram models: recurrence, attestation, dictionary matching, Kneser-Ney counts, fuzzy lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut


def recurrent_terms(rows: DataFrame, terms: Column, meeting: str, city: str, least: int = 2) -> DataFrame:
    """Terms by distinct meetings and cities, of ``least`` meetings or more; global from two cities on."""
    seen = rows.select(F.explode(terms).alias("term"), meeting, city)
    counts = seen.groupBy("term").agg(F.count_distinct(meeting).alias("meetings"), F.count_distinct(city).alias("cities"), F.min(city).alias("city"))
    return counts.filter(F.col("meetings") >= least).select("term", "meetings", "cities", F.when(F.col("cities") >= 2, "global").otherwise(F.col("city")).alias("scope"))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined by spaces. The tokens are evaluated once, not again for each run."""
    runs = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(tokens), runs), F.lit(0))


def attested(rows: DataFrame, tokens: Column, terms: DataFrame, meeting: str, longest: int = 4) -> DataFrame:
    """For each term of up to ``longest`` words the distinct meetings that have it: exploded n-grams joined by equality.

    N-grams are made of the lengths only that terms have, and each counts once a meeting before it travels to the join."""
    found = terms.select(F.size(F.split("term", " ")).alias("n")).filter(F.col("n").between(1, longest)).distinct().collect()  # ``longest`` rows at most
    sizes = sorted(r["n"] for r in found) or [1]
    every = lambda t: F.array_distinct(F.flatten(F.array(*(ngrams(t, n) for n in sizes))))
    grams = rows.select(meeting, F.explode(F.get(F.transform(F.array(tokens), every), F.lit(0))).alias("term")).distinct()
    return terms.select("term").distinct().join(grams, "term", "left").groupBy("term").agg(F.count_distinct(meeting).alias("meetings"))


def kneser_ney(sentences: DataFrame, tokens: Column) -> DataFrame:
    """Interpolated Kneser-Ney bigrams: (context, word, count, p), by counts and joins.

    p = max(count - discount, 0) / count(context) + discount * types(context) / count(context) * share of
    bigram types that end in the word; the discount is n1 / (n1 + 2 n2), 0.5 if undefined, within 1e-4 of 0 and 1."""
    padded = F.concat(F.array(F.lit("<s>")), tokens, F.array(F.lit("</s>")))
    pairs = sentences.select(F.explode(F.arrays_zip(F.slice(padded, F.lit(1), F.size(padded) - 1).alias("context"), F.slice(padded, F.lit(2), F.size(padded)).alias("word"))).alias("g")).select("g.*")
    counts = pairs.toDF("context", "word").groupBy("context", "word").agg(F.count(F.lit(1)).alias("count"))
    counts = cut(counts)  # totals, contexts, words and the result are all made of it
    once = counts.agg(F.count_if(F.col("count") == 1).alias("n1"), F.count_if(F.col("count") == 2).alias("n2"), F.count(F.lit(1)).alias("types")).first()
    discount = once["n1"] / (once["n1"] + 2 * once["n2"]) if once["n1"] else 0.5
    discount = min(1 - 1e-4, max(1e-4, discount))
    contexts = counts.groupBy("context").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("after"))
    words = counts.groupBy("word").agg((F.count(F.lit(1)) / F.lit(once["types"] or 1)).alias("continuation"))
    p = F.greatest(F.col("count") - discount, F.lit(0.0)) / F.col("total") + F.lit(discount) * F.col("after") / F.col("total") * F.col("continuation")
    return counts.join(contexts, "context").join(words, "word").select("context", "word", "count", p.alias("p"))


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Place from 0 and size of the i-th of ``parts`` even segments of a word of ``length`` letters."""
    start = F.floor(length * i / parts).cast("int")
    return start, F.floor(length * (i + 1) / parts).cast("int") - start


def _term_keys(term: Column, most: int) -> Column:
    """A term's segments, each with its number and the term's length."""

    def key(i: Column) -> Column:
        start, size = _segment(F.length(term), i, most + 1)
        return F.concat_ws("|", F.length(term).cast("string"), i.cast("string"), F.substring(term, start + 1, size))

    return F.transform(F.sequence(F.lit(0), F.lit(most)), key)


def _token_keys(token: Column, most: int) -> Column:
    """What the segments of a term within ``most`` edits can be in a token: for each length, segment and shift the letters there."""
    n = F.length(token)

    def at(length: Column, i: Column, shift: Column) -> Column:
        start, size = _segment(length, i, most + 1)
        inside = (start + shift >= 0) & (start + shift + size <= n)
        return F.when(inside, F.concat_ws("|", length.cast("string"), i.cast("string"), F.substring(token, start + shift + 1, size)))

    each = lambda length: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda s: at(length, i, s))))
    lengths = F.sequence(F.greatest(F.lit(0), n - most), n + most)
    return F.array_distinct(F.array_compact(F.flatten(F.transform(lengths, each))))


def fuzzy_nearest(tokens: DataFrame, terms: DataFrame, most: int = 3, token: str = "token", term: str = "term") -> DataFrame:
    """For each token the nearest term within ``most`` edits, with the second distance; ties to the least term.

    Of a term's ``most`` + 1 segments one at least stands unchanged in any word within ``most`` edits, moved by ``most`` letters at
    most, so terms and tokens meet by an equality join on segments, and a bounded edit distance is the filter:
    lossless, and without comparing all words of a length. Tokens with equal distances are kept apart by their terms."""
    a = tokens.select(token).distinct().withColumn("_key", F.explode(_token_keys(F.col(token), most)))
    b = terms.select(term).distinct().withColumn("_key", F.explode(_term_keys(F.col(term), most)))
    met = a.join(b, "_key").select(token, term).distinct()
    near = met.withColumn("distance", F.levenshtein(token, term, most)).filter("distance >= 0")
    w = Window.partitionBy(token).orderBy("distance", term)
    ranked = near.select(token, term, "distance", F.row_number().over(w).alias("_r"), F.lead("distance").over(w).alias("second"))
    return ranked.filter("_r = 1").select(token, term, "distance", "second")


def personal_data(text: Column) -> Column:
    """Kinds of structured personal data in a text: email, iban, mobile, and digits near a keyword that names them."""
    # Keywords that make a run of digits an identifier.
    keyword, digits = r"(?i)(?:\bafm\b|\bamka\b|\btax id\b|\bpassport\b|ΑΦΜ|ΑΜΚΑ)", r"[0-9]{8,12}"
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"), ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"), ("mobile", r"\b69[0-9]{8}\b"), ("identifier", rf"{keyword}[\s\S]{{0,40}}{digits}|{digits}[\s\S]{{0,40}}{keyword}")]
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in kinds)))


def final_decision(verdict: Column, flagged: Column, structured: Column) -> Column:
    """keep only what is shown to be safe."""
    return F.when((F.size(structured) > 0) | (F.coalesce(F.size(flagged), F.lit(0)) > 0), "drop").when(verdict == "safe", "keep").otherwise("drop")
