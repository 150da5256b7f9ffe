"""Substring dedup by sliding sentence spans.

Runs of several consecutive sentences are hashed and joined over the whole corpus by their hash, and
sentences that a repeated run covers are removed where that run is not the first. Every run counts, of any number
of sentences, by the shortest runs inside it: a run of sentences is covered by the shortest runs that begin at one
of its sentences or end with its last one, so two of these for each sentence stand for all. Passages that hold
no run are found by runs that content chooses, wherever sentences begin.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .shingles import Words
from .spans import SPAN_SCHEMA, repeats, run_hasher, span_rows, spanned

#: A run has this many sentences, and this many words, at least.
SENTENCES, RUN_WORDS = 2, 16
#: A sentence of so many words is a run of its own too.
LONG = 30
#: Of so many runs of LONG words in a row that begin at neighbouring words, the one of least hash is chosen.
CHOICE = 11


def sentence_starts(of: Words) -> np.ndarray:
    """Words that begin a sentence: the first of a text, one after a stop mark, and one after a line break."""
    begins = np.zeros(len(of.hashes), bool)
    if not len(begins):
        return np.zeros(0, np.int64)
    begins[of.first[:-1][of.counts > 0]] = True
    last = of.data[of.ends - 1]
    stop = np.isin(last, np.frombuffer(b".!?", np.uint8))
    lines = np.cumsum(of.data == 10)
    begins[1:] |= stop[:-1] | (lines[of.starts[1:]] > lines[of.ends[:-1] - 1])
    return np.flatnonzero(begins)


def sentence_runs(of: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of the shortest runs that begin at each sentence or end with it, and of the long sentences."""
    starts = sentence_starts(of)
    if not len(starts):
        return starts, starts
    number = np.arange(len(starts))
    border = np.concatenate([starts, [len(of.hashes)]])
    text = np.searchsorted(of.first, starts, side="right") - 1
    text_begin, text_end = of.first[text], of.first[text + 1]
    to = np.maximum(number + SENTENCES, np.searchsorted(border, starts + RUN_WORDS))
    after = border[np.minimum(to, len(starts))]
    whole = (to <= len(starts)) & (after <= text_end)
    since = np.minimum(number + 1 - SENTENCES, np.searchsorted(border, border[1:] - RUN_WORDS, side="right") - 1)
    before = border[np.maximum(since, 0)]
    back = (since >= 0) & (before >= text_begin)
    long_ = border[1:] - starts >= LONG
    a = np.concatenate([starts[whole], before[back], starts[long_]])
    b = np.concatenate([after[whole], border[1:][back], border[1:][long_]])
    once = np.unique(a << 32 | b)
    return once >> 32, once & 0xFFFFFFFF


def chosen_runs(of: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of LONG words: the first of least hash of each CHOICE neighbours within a text.

    The choice depends on the LONG + CHOICE - 1 words alone, so equal passages of that length hold an equal one."""
    n = len(of.hashes) - LONG + 1
    if n < CHOICE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.arange(n)
    windows = np.lib.stride_tricks.sliding_window_view(run_hasher(of)(every, every + LONG), CHOICE)
    begin = every[: len(windows)]
    within = begin + CHOICE - 1 + LONG <= of.first[np.searchsorted(of.first, begin, side="right")]
    at = np.unique((begin + windows.argmin(axis=1))[within])
    return at, at + LONG


def all_runs(of: Words) -> tuple[np.ndarray, np.ndarray]:
    """``sentence_runs`` and ``chosen_runs``."""
    (a, b), (c, d) = sentence_runs(of), chosen_runs(of)
    return np.concatenate([a, c]), np.concatenate([b, d])


def repeated_sentences(docs: DataFrame, text: str = "text", key: str = "doc_id", anywhere: bool = False) -> DataFrame:
    """``repeats`` of the sentence runs of whole texts; ``without`` removes them.

    A run is two sentences or more with 16 words or more, so any shared passage that holds such a
    run counts, whatever stands around it; words count without the white space between them. With
    ``anywhere`` every shared passage of 40 words counts too, wherever its sentences begin and end: 30 of its
    words at least, and all but 10 at either end. Rows that
    repeat key and text are one document; texts that share a key, or have none, are a document each, told
    apart by ``text_hash``; null and short texts
    have no runs; an empty table gives an empty result; further columns are left out."""
    return repeats(spanned(docs, text, key).mapInArrow(span_rows(all_runs if anywhere else sentence_runs), SPAN_SCHEMA)).withColumnRenamed("doc_id", key)
