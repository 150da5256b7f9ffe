"""Best-fit packing of tokenised documents into training sequences, under several capacities at once.

A sequence has room for so many tokens, so many documents and so much attention cost (the sum of
squared lengths). Pieces are placed longest first, each in an open sequence in which it keeps
every capacity: the one whose residual vector is nearest to the piece (norm of what would be left)
or has the largest weighted dot product with it. Pieces are dealt into shards by hash, so that
each shard has the table's own mix of lengths, and a shard is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored

#: Pieces of a shard: an open sequence that a shard ends with is one in some ten thousand.
SHARD_PIECES = 32_768


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and weights of what is left of them. The defaults of documents and attention are what the tokens imply, so
    that they never cost a sequence; their small weights decide among sequences with equal room for tokens."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096**2
    weights: tuple[float, float, float] = (1.0, 1e-8, 1e-8)


def place(lengths: np.ndarray, limits: Limits, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece. Longest first, ties in the order given; of equal sequences the one that was opened first.

    A piece that is beyond a capacity by itself has a sequence of its own."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    n = len(lengths)
    of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return of, offset
    full = np.array([limits.tokens, limits.documents, limits.attention], np.int64)
    weight = np.asarray(limits.weights) / full.astype(float) ** 2
    left = np.zeros((3, 1024), np.int64)  # of open sequences, in the order in which they were opened
    number = np.zeros(1024, np.int64)
    least, open_, opened = int(lengths.min()), 0, 0
    used: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        need = (size, 1, size * size)
        room = left[:, :open_]
        fit = np.flatnonzero((room[0] >= size) & (room[1] >= 1) & (room[2] >= need[2]))
        if len(fit):
            near = room[:, fit]
            if rule == "norm":
                at = fit[np.argmin(sum(w * (r - d) ** 2.0 for w, r, d in zip(weight, near, need, strict=True)))]
            else:
                at = fit[np.argmax(sum(w * r * float(d) for w, r, d in zip(weight, near, need, strict=True)))]
        else:
            if open_ == left.shape[1]:
                left, number = np.concatenate([left, np.zeros_like(left)], 1), np.concatenate([number, np.zeros_like(number)])
            at = open_
            left[:, at], number[at] = full, opened
            open_, opened = open_ + 1, opened + 1
            used.append(0)
        of[i] = k = number[at]
        offset[i] = used[k]
        used[k] += size
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:  # nothing fits any more
            left[:, at : open_ - 1], number[at : open_ - 1] = left[:, at + 1 : open_].copy(), number[at + 1 : open_].copy()
            open_ -= 1
    return of, offset


class Ids:
    """Ids of many texts at once. The tokenizer neither joins nor looks across white space, so a text's ids are those of its chunks between ASCII
    white space, one after the other: each different chunk of the texts is encoded once, and chunks are numbers from then on.

    ASCII case makes no difference, and a last ASCII character after letters is a pre-token of its own, so most chunks are a word and at
    most one such character. Nothing is kept from call to call."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True  # the strings of special tokens are ordinary text
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _encoded(self, texts: list[str], together: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by text); the library's own records, many times as large, are held for ``together`` texts."""
        ids, counts = [np.zeros(0, np.uint32)], []
        for k in range(0, len(texts), together):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[k : k + together], add_special_tokens=False)]
            ids.append(np.array([i for x in found for i in x], np.uint32))
            counts += map(len, found)
        return np.concatenate(ids), np.array(counts, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by text) of every text by itself."""
        return self._encoded(texts, _TOGETHER)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters, each one pre-token: they are encoded side by side and cut after the tokens that end a word. (Should
        a word be more than one after all, each is encoded by itself.)"""
        ids, _ = self._encoded([" ".join(words[k : k + _TOGETHER]) for k in range(0, len(words), _TOGETHER)], 4)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) else self._each(words)

    def _units(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all units, their number by unit, first unit, second unit or -1) of different chunks."""
        low = pc.if_else(pc.string_is_ascii(chunks), pc.ascii_lower(chunks), chunks)
        head, last = pc.utf8_slice_codeunits(low, 0, -1), pc.utf8_slice_codeunits(low, -1)
        plain = ~np.asarray(pc.match_substring(chunks, "\u0130"))  # the one letter whose lower case ends with a mark
        whole = plain & np.asarray(pc.utf8_is_alpha(low))
        ending = plain & ~whole & np.asarray(pc.and_(pc.utf8_is_alpha(head), pc.string_is_ascii(last)))
        word = pc.if_else(pa.array(whole), low, head).filter(pa.array(whole | ending)).dictionary_encode()
        other = pa.concat_arrays([low.filter(pa.array(~whole & ~ending)), last.filter(pa.array(ending))]).dictionary_encode()
        parts = [self._letters(word.dictionary.to_pylist()), self._each(other.dictionary.to_pylist())]
        first, second = np.full(len(chunks), -1, np.int64), np.full(len(chunks), -1, np.int64)
        first[whole | ending] = np.asarray(word.indices)
        places = np.asarray(other.indices) + len(word.dictionary)
        n = len(chunks) - int((whole | ending).sum())
        first[~whole & ~ending], second[ending] = places[:n], places[n:]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]), first, second

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian ids of every text. Chunks are counted over all of them; a few texts at a time become ids."""
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        ids, held, first, second = self._units(chunks.dictionary)
        begins = np.concatenate([[0], np.cumsum(held)])
        starts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + _CHUNKS, side="right")) - 1)
            at = np.asarray(chunks.indices[starts[low] : starts[high]])
            units = np.stack([first[at], second[at]], 1).ravel()
            lengths = np.where(units >= 0, held[units], 0)
            upto = np.concatenate([[0], np.cumsum(lengths)])
            data = ids[np.repeat(begins[units] - upto[:-1], lengths) + np.arange(upto[-1])].astype("<u4").tobytes()
            cuts = (4 * upto[2 * (starts[low : high + 1] - starts[low])]).tolist()
            yield from (data[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True))
            low = high


_IDS: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    """One for a worker, which runs many tasks."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


#: Pieces of a batch.
_SLICE = 512
#: Words that are encoded in one string, bytes of texts whose chunks are counted together (a longer text is by itself), and chunks that become ids at once.
_TOGETHER, _BYTES, _CHUNKS = 4096, 20 << 20, 1 << 17


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of texts that are encoded together."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, side="right")))
        yield at, to
        at = to


def _cutter(key: str, text: str, path: str, end: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = _ids(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(text).cast(pa.string()).fill_null("")
            for low, high in _runs(texts):
                row, piece, start, ids = [], [], [], []
                for i, found in enumerate(known.of(texts.slice(low, high - low)), low):
                    whole = found + last
                    for k, x in enumerate(range(0, len(whole), 4 * most)):
                        row.append(i)
                        piece.append(k)
                        start.append(x // 4)
                        ids.append(whole[x : x + 4 * most])
                    if len(row) >= _SLICE:
                        yield told(batch, row, piece, start, ids)
                        row, piece, start, ids = [], [], [], []
                if row:
                    yield told(batch, row, piece, start, ids)

    def told(batch: pa.RecordBatch, row: list[int], piece: list[int], start: list[int], ids: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row, pa.int32())), *columns], [key, "piece", "start", "length", "ids"])

    return run


def pieces(docs: DataFrame, path: str, end: int = 1, most: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, piece, start, length and ids (little-endian unsigned 32-bit) of the pieces of every document: its text's ids and then ``end``, cut
    after every ``most`` ids.

    A null text is an empty one, whose only id is ``end``; texts are whole, of any length; rows that repeat are cut each; null keys stay;
    an empty table gives an empty result; further columns are left out, whatever their names. ``path``, a file of the tokenizers
    library, must be readable on the workers, as an installed package's files are."""
    source = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    schema = source.select(key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("ids")).schema
    return source.mapInArrow(_cutter(key, "_text", path, end, most), schema)


def pack(table: DataFrame, limits: Limits | None = None, rule: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``table``, whose rows have a ``length``, with ``sequence_id`` and ``offset``: pieces follow each other without gaps in every sequence.

    Only numbers and lengths are dealt to the shards; the rows' other columns, whatever their names but ``_row`` and ``_shard``, are joined to
    the places. The table is written once to the shared folder, so that a task that is run again deals the same rows. An
    empty table has no sequences; equal lengths go in the order of the rows' numbers; a null length counts as 0."""
    limits = limits or Limits()
    rows = stored(table.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()))
    shards = max(1, -(-rows.count() // shard_pieces))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("_row")
        of, offset = place(group["length"].to_numpy(), limits, rule)
        shard = group["_shard"][0].as_py()
        return pa.table({"_row": group["_row"], "sequence_id": pa.array((shard << 32) + of), "offset": pa.array(offset)})

    dealt = rows.select("_row", F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.pmod(F.xxhash64("_row"), F.lit(shards)).alias("_shard"))
    places = dealt.groupBy("_shard").applyInArrow(packed, "_row long, sequence_id long, offset long")
    return rows.join(places, "_row").drop("_row")


def sequences(docs: DataFrame, path: str, end: int = 1, limits: Limits | None = None, rule: str = "norm", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``sequence_id``, n_tokens, n_documents and ids (little-endian unsigned 32-bit) of every sequence; nulls and the rest as in ``pieces`` and ``pack``."""
    limits = limits or Limits()
    packed = pack(pieces(docs, path, end, limits.tokens, text, key), limits, rule)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence's own pieces
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), parts.alias("parts"))
    joined = F.aggregate(F.col("parts"), F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", "n_tokens", "n_documents", joined.alias("ids"))
