"""Text normalisation, tokens and string scalars as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script (Java's \w is ASCII).
WORD_CLASS = r"\p{L}\p{N}_"


@cache
def mark_table() -> tuple[str, str]:
    """Every BMP character that decomposes into one base and combining marks, and those bases."""
    composed, bases = [], []
    for point in range(0xC0, 0xFFFF):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]) and unicodedata.category(parts[0]) != "Mn":
            composed.append(chr(point))
            bases.append(parts[0])
    return "".join(composed), "".join(bases)


def strip_marks(text: Column) -> Column:
    """Without accents and other combining marks, whether composed or not."""
    composed, bases = mark_table()
    return F.regexp_replace(F.translate(text, composed, bases), r"\p{Mn}", "")


def fold_sigma(text: Column) -> Column:
    return F.translate(text, "ς", "σ")


def collapse_space(text: Column) -> Column:
    """White space of any script as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def canonical(text: Column) -> Column:
    """Lower case, no marks, one sigma, punctuation as space, collapsed; null counts as empty. The form edits are compared in."""
    plain = fold_sigma(strip_marks(F.lower(F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(plain, rf"[^{WORD_CLASS}]+", " "))


def plain(text: Column) -> Column:
    """No marks, lower case; sigma stays. The form transcripts are scored in: not to be mixed with ``canonical``."""
    return F.lower(strip_marks(F.coalesce(text, F.lit(""))))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def canonical_tokens(text: Column) -> Column:
    return _split(canonical(text))


def word_tokens(text: Column) -> Column:
    """Runs of word characters of the ``plain`` form."""
    return F.regexp_extract_all(plain(text), F.lit(f"([{WORD_CLASS}]+)"), F.lit(1))


# Hesitation sounds, without accents.
FILLERS = ("ε", "εε", "εεε", "εμ", "εμμ", "αα", "μμ", "χμ")


def content_tokens(text: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """``word_tokens`` without hesitation sounds."""
    return F.filter(word_tokens(text), lambda t: ~t.isin(*fillers))


def no_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, rf"[^{WORD_CLASS}\s]", "")


def phonetic_skeleton(token: Column) -> Column:
    """Spellings of one sound made equal: digraphs, then vowel classes, then doubled letters."""
    t = no_punctuation(fold_sigma(strip_marks(F.lower(F.trim(token)))))
    # Digraphs and vowels of one sound.
    steps = [("αι", "ε"), ("ει", "ι"), ("οι", "ι"), ("υι", "ι"), ("[ηιυ]", "ι"), ("ω", "ο"), (r"(.)\1+", "$1")]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, t)


def vowel_skeleton(token: Column) -> Column:
    """Vowels by sound class (I, O, E, A, U), digraphs first in reading order; the form homophones are matched in."""
    t = fold_sigma(strip_marks(F.lower(token)))
    t = F.regexp_replace(t, "ει|οι", "I")
    t = F.regexp_replace(F.regexp_replace(t, "αι", "E"), "ου", "U")
    return F.translate(t, "ηιυωοεα", "IIIOOEA")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


# Latin letters and the Greek ones they look like.
_LOOKALIKES = ("ABEHIKMNOPTXYZaeioptxyvnu", "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖαειορτχυνημ")


def fix_homoglyphs(text: Column) -> Column:
    """Latin lookalikes as Greek letters, in words that mix both scripts only."""
    mixed = lambda w: w.rlike("[A-Za-z]") & w.rlike(r"\p{IsGreek}")
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(mixed(w), F.translate(w, *_LOOKALIKES)).otherwise(w)), " ")


def greek_to_latin(text: Column) -> Column:
    """Letter by letter; theta, chi and psi give two letters each."""
    t = strip_marks(F.lower(text))
    for a, b in (("θ", "th"), ("χ", "ch"), ("ψ", "ps")):  # fixed values
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.translate(t, "αβγδεζηικλμνξοπρσςτυφω", "avgdeziiklmnxoprsstyfo")


def fold_ascii(text: Column) -> Column:
    return strip_marks(F.lower(text))


def upper_without_marks(text: Column) -> Column:
    return F.upper(strip_marks(text))


# Openings of a model's reasoning that leaks into a transcript, in the order they are tried.
REASONING_MARKERS = (
    r"(?i)\n\nWait,?\s+let\s+me\s+reconsider",
    r"(?i)\n\n</?think>",
    r"(?i)\n\nActually,?\s+let\s+me",
    r"(?i)\n\nHmm,?\s+let\s+me",
    r"(?i)\n\nLet\s+me\s+re(consider|think|check)",
)


def strip_reasoning(text: Column) -> Column:
    """What stands before the first marker, of the first marker in order that occurs; unchanged without one."""
    out = text
    for marker in reversed(REASONING_MARKERS):
        out = F.when(text.rlike(marker), F.rtrim(F.get(F.split(text, marker, 2), F.lit(0)))).otherwise(out)
    return out


def has_overlap_marker(note: Column) -> Column:
    """A Latin c that stands alone."""
    return F.coalesce(note.rlike(r"(?<![A-Za-z])[cC](?![A-Za-z])"), F.lit(False))


def complete_sentence(text: Column) -> Column:
    """Begins in upper case and ends with a terminal mark."""
    return F.coalesce(F.trim(text).rlike(r"^\p{Lu}[\s\S]*[.!?;·…]$"), F.lit(False))


def repeated_ngram(tokens: Column, n: int = 5, times: int = 3) -> Column:
    """Whether some word n-gram occurs at least ``times`` times."""
    grams = F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    sorted_ = lambda g: F.array_sort(g)
    body = lambda g: F.when(F.size(g) >= times, F.exists(F.zip_with(F.slice(g, F.lit(1), F.size(g) - times + 1), F.slice(g, F.lit(times), F.size(g) - times + 1), lambda a, b: a == b), lambda x: x)).otherwise(False)
    return F.get(F.transform(F.array(sorted_(grams)), body), F.lit(0))


def proper_terms(text: Column) -> Column:
    """Capitalised words and their consecutive runs as phrases, acronyms included, each once in order of first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:\p{Lu}[\p{L}\p{N}]+)(?:\s+\p{Lu}[\p{L}\p{N}]+)*)"), F.lit(1)))


def name_tokens(name: Column, least: int = 4, stop: tuple[str, ...] = ()) -> Column:
    """Distinct canonical tokens of a name in order, short ones and stop words left out."""
    kept = F.filter(canonical_tokens(name), lambda t: (F.length(t) >= least) & ~(t.isin(*stop) if stop else F.lit(False)))
    return F.array_sort(F.array_distinct(kept))


# Nominative endings of surnames and the endings of their other cases, first match wins.
SURNAME_CASES = (("οπουλος", ("οπουλος", "οπουλου", "οπουλο")), ("ος", ("ος", "ου", "ο")), ("ης", ("ης", "η")), ("ας", ("ας", "α")), ("ις", ("ις", "ι")))


def inflections(surname: Column) -> Column:
    """Case forms of a surname; itself alone where no ending is known."""
    out = F.array(surname)
    for ending, forms in reversed(SURNAME_CASES):
        stem = F.left(surname, F.length(surname) - len(ending))
        out = F.when(surname.endswith(ending), F.array(*(F.concat(stem, F.lit(f)) for f in forms))).otherwise(out)
    return F.array_distinct(out)
