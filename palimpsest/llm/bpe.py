"""Byte-level BPE encoding and decoding.

The rank of the pair that starts at each byte position is kept in a segment tree whose root
is the leftmost pair of minimum rank. A merge changes three leaves (the merged pair, its left
neighbour, the token that vanished), so a piece of n bytes costs O(n log n) however long it
is: a page of base64 without a space is no worse than prose of its size.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NONE = 1 << 62


def _put(tree: list[int], k: int, key: int) -> None:
    """Change a leaf, and the minima above it as far as they change."""
    tree[k] = key
    while k > 1:
        other = tree[k ^ 1]
        k >>= 1
        low = key if key < other else other
        if tree[k] == low:
            return
        tree[k] = key = low


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = n - 1
    tree = [_NONE] * size
    get = ranks.get
    for i in range(size):
        rank = get(piece[i : i + 2])
        tree.append(_NONE if rank is None else rank * n + i)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    while (root := tree[1]) < _NONE:
        i = root % n
        j = end[i]
        k = end[i] = end[j]
        before[k] = i
        if j < size:
            _put(tree, size + j, _NONE)
        rank = get(piece[i : end[k]]) if k < n else None
        _put(tree, size + i, _NONE if rank is None else rank * n + i)
        if i:
            p = before[i]
            rank = get(piece[p:k])
            _put(tree, size + p, _NONE if rank is None else rank * n + p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """A tokenizer's rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _splitter(pattern: str) -> regex.Pattern:
    # \s must be Unicode's White_Space alone: the regex module adds the separators U+001C..U+001F.
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


#: Longest pre-token that is kept.
_KEPT = 64


class _Pieces(dict):
    """Pre-token -> its ids as text. A new one waits in ``new`` and is kept when it is asked for again, so that pre-tokens met once
    don't fill the memory. Both those that wait and those that are kept are in two generations of ``limit`` entries at most: when the
    younger is full it becomes the older one, from which entries that are asked for again come back."""

    def __init__(self, ranks: dict[bytes, int], limit: int):
        self.ranks, self.limit, self.older, self.new, self.waiting = ranks, limit, {}, {}, {}

    def __missing__(self, piece: str) -> str:
        ids = self.new.pop(piece, None) or self.waiting.pop(piece, None) or self.older.get(piece)
        if ids is None:
            ids = " ".join(map(str, merge_piece(piece.encode("utf-8"), self.ranks)))
            if len(piece) <= _KEPT:
                if len(self.new) >= self.limit:
                    self.waiting, self.new = self.new, {}
                self.new[piece] = ids
            return ids
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


@lru_cache(maxsize=1)
def _pieces(ranks_path: str, limit: int) -> _Pieces:
    """A worker's pre-tokens, from one task to the next."""
    return _Pieces(load_ranks(ranks_path), limit)


@lru_cache(maxsize=1)
def _tokens(ranks_path: str) -> dict[str, bytes]:
    """Decimal id -> its bytes."""
    return {str(rank): token for token, rank in load_ranks(ranks_path).items()}


def encode_text(text: str, ranks: dict[bytes, int], pattern: str, cache: _Pieces | None = None) -> str:
    """Decimal token ids, joined by single spaces."""
    cache = _Pieces(ranks, 1 << 16) if cache is None else cache
    return " ".join(map(cache.__getitem__, _splitter(pattern).findall(text)))


def decode_ids(ids: str | None, tokens: dict[str, bytes]) -> bytes:
    """The bytes that decimal ids, joined by single spaces, stand for."""
    return b"".join(map(tokens.__getitem__, ids.split(" "))) if ids else b""


def _by_rows(docs: DataFrame, keep: list[str], function: Callable, returns: dict[str, str], of: str) -> DataFrame:
    """``keep``, and the fields ``returns`` of ``function`` of the column ``of``.

    Rows travel pickled, 100 at a time: an Arrow batch of whole texts is up to 64 MB, three times over (in the JVM's vectors, in
    its buffer for the worker, in the worker), and all of it beside the heap. Not deterministic for Spark means called once a row."""
    out = next(c for c in map("_coded{}".format, itertools.count()) if c not in keep)
    kind = StructType()
    for name, of_kind in returns.items():
        kind = kind.add(name, of_kind)
    made = F.udf(function, kind, useArrow=False).asNondeterministic()(F.col(f"`{of}`")).alias(out)
    return docs.select(*_columns(keep), made).select(*_columns(keep), *(F.col(out)[c].alias(c) for c in returns))


def _columns(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", cache_size: int = 65_536) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens`` long and ``token_ids`` string (decimal ids joined by a space).

    A null or empty text has no tokens and the empty id string. Texts are whole, of any length;
    rows repeat as they come, and other columns pass through untouched, whatever their names,
    but for ``n_tokens`` and ``token_ids``, which are replaced. ``ranks_path`` must be readable on
    the workers, as an installed package's files are. ``cache_size`` bounds a worker's memory: four times
    as many pre-tokens are held at most, none of more than 64 characters."""

    def coded(value: str | None) -> tuple[int, str]:
        ids = encode_text(value or "", load_ranks(ranks_path), pattern, _pieces(ranks_path, cache_size))
        return ids.count(" ") + 1 if ids else 0, ids

    keep = [c for c in docs.columns if c not in (text, "n_tokens", "token_ids")]
    return _by_rows(docs, keep, coded, {"n_tokens": "long", "token_ids": "string"}, text)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ``ids`` stand for in ``out``; null or empty ids give no bytes."""

    def back(value: str | None) -> tuple[bytes]:
        return (decode_ids(value, _tokens(ranks_path)),)

    return _by_rows(encoded, [c for c in encoded.columns if c != out], back, {out: "binary"}, ids)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", cache_size: int = 65_536) -> DataFrame:
    """``encode`` and ``decode`` one after the other in the same worker: ids need not leave it in between."""

    def both(value: str | None) -> tuple[int, str, bytes]:
        ids = encode_text(value or "", load_ranks(ranks_path), pattern, _pieces(ranks_path, cache_size))
        return ids.count(" ") + 1 if ids else 0, ids, decode_ids(ids, _tokens(ranks_path))

    keep = [c for c in docs.columns if c not in (text, "n_tokens", "token_ids", "decoded")]
    return _by_rows(docs, keep, both, {"n_tokens": "long", "token_ids": "string", "decoded": "binary"}, text)
