"""Near-duplicate classes by BagMinHash.

A text is the multiset of its word shingles. Each shingle carries Poisson processes over its
weight: the unit levels 0..1, 1..2, 2..4, 4..8, ... each have a process of their own, seeded by the
shingle and the level, whose points carry a time, a register and a weight position. A text of
multiplicity c sees the points whose position is below c, so that two texts see the same points
for the weight they share, and a register's earliest point is equal in both with the probability
of their weighted Jaccard similarity. Points come in order of time and only the earliest
matter, so about m ln m are drawn for a text however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, compact, shuffle_parts, stored
from .components import components
from .shingles import blocks, mix64, shingles, words

#: Bands and rows: a pair of similarity 0.8 shares no band with probability 3e-5.
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
_LOW48 = np.uint64((1 << 48) - 1)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), of 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _draw(owner: np.ndarray, seed: np.ndarray, low: np.ndarray, size: np.ndarray, weight: np.ndarray, until: np.ndarray, m: int, out: np.ndarray) -> None:
    """Points up to the time ``until`` of their text; ``out`` (texts x m, flat) keeps the earliest of each register."""
    time, step = np.zeros(len(seed)), 0
    while len(seed):
        x = mix64(seed + np.uint64((0x9E3779B97F4A7C15 * (3 * step + 1)) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(_uniform(x)) / size
        live = time <= until[owner]
        owner, seed, low, size, weight, time, x = (v[live] for v in (owner, seed, low, size, weight, time, x))
        y = mix64(x ^ np.uint64(0xA0761D6478BD642F))
        seen = np.ones(len(y), bool) if len(size) == 0 or size.max() == 1 else low + np.floor(_uniform(mix64(y)) * size) < weight
        slot = owner[seen] * m + ((y[seen] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, slot, time[seen])
        step += 1


def signatures(hashes: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (texts x m) of the shingle multisets ``hashes[first[i]:first[i + 1]]``; inf for a text without shingles."""
    n = len(first) - 1
    total = np.diff(first).astype(np.float64)
    out = np.full(n * m, np.inf)
    if not len(hashes):
        return out.reshape(n, m)
    key = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(first)) << np.uint64(48)) | (hashes & _LOW48))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(new)
    weight = np.diff(np.concatenate([at, [len(key)]])).astype(np.float64)
    owner, seed = (key[at] >> np.uint64(48)).astype(np.int64), key[at] & _LOW48
    parts, level = [(owner, mix64(seed), np.zeros(len(at)), np.ones(len(at)), weight)], 0
    while True:
        low = 2.0**level
        more = weight > low
        if not more.any():
            break
        level += 1
        owner, seed, weight = owner[more], seed[more], weight[more]
        parts.append((owner, mix64(seed + np.uint64(level << 48)), np.full(len(seed), low), np.full(len(seed), low), weight))
    owner, seed, low, size, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    until = np.where(total > 0, m * (np.log(m) + 3) / np.maximum(total, 1), 0)
    open_ = np.ones(len(seed), bool)
    while open_.any():
        _draw(owner[open_], seed[open_], low[open_], size[open_], weight[open_], until, m, out)
        missing = np.isinf(out.reshape(n, m)).any(1) & (total > 0)
        until = np.where(missing, 2 * until, 0)  # a register without a point: draw on, from the start
        open_ = missing[owner]
    return out.reshape(n, m)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(registers).view(np.uint64)
    out = np.zeros((len(registers), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(registers), b + 1, np.uint64)
        for r in range(rows):
            x = mix64(x * np.uint64(0x9FB21C651E98DF25) + bits[:, b * rows + r])
        out[:, b] = x
    return out.view(np.int64)


#: A quick look at a pair: 4 bits of each register above, and 1 bit of each of 2,048 for texts of groups that need a sharper
#: one. Estimates have a standard error of 0.040 and 0.0133 at a similarity of 0.8; the bounds lie four of them
#: below, so that a link is passed over with probability 3e-5.
BITS, BOUND = 4, 0.64
SHARP, SHARP_BOUND = 2048, 0.747
#: Finer bands, of more registers each, for texts of crowded buckets: a pair of similarity 0.8 shares none with probability 8e-6.
FINE, FINE_ROWS = 64, 8
#: Texts of a block: in a fine bucket those that are not of its commonest component are cut into blocks of about so many, and each
#: block meets all other texts of the bucket, in shares of as many (SPREAD at least), so that no task holds more than a block and a share.
AHEAD, SPREAD = 1024, 256
#: Texts (their hashes and keys, some 100 bytes each) that are broadcast at most; more are joined.
FEW = 200_000


def register_bits(registers: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` (1 or 4) bits of each register, packed in longs (texts x longs)."""
    mixed = mix64(np.ascontiguousarray(registers).view(np.uint64))
    each = np.unpackbits((mixed & np.uint64((1 << bits) - 1)).astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(registers), -1)
    packed = np.packbits(each, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.int64)


def sharp_bits(texts: DataFrame, width: int = 5) -> DataFrame:
    """(key, bits, fine) of (key, text), from many registers: a bit of each, and the keys of the finer bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column("text"), 1 << 18):
                hashes, first = shingles(words(data, offsets), width)
                registers, none = signatures(hashes, first, SHARP), np.diff(first) == 0
                lists = [_lists(x, none) for x in (register_bits(registers, 1), band_keys(registers, FINE, FINE_ROWS))]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), *lists], ["key", "bits", "fine"])

    return texts.select("key", "text").mapInArrow(run, "key binary, bits array<long>, fine array<long>")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of band, chunk, salt and probe: (a, b, low, high, differ) of texts with different labels and like bits, of which one is no
    probe, that share no fine bucket before this one (``at`` is its place in ``fine``). Low and high are their labels, differ counts unequal bits.

    A pair that shares several buckets is told once; those of one block are told at salt 0."""
    limit, held = int(SHARP * (1 - SHARP_BOUND) / 2), None

    def told(batch: pa.RecordBatch, upto: int, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        label, at, salt, probe, key = np.asarray(batch.column("label")), np.asarray(batch.column("at")), np.asarray(batch.column("salt")), np.asarray(batch.column("probe")), batch.column("key")
        bits, fine = (np.asarray(batch.column(c).flatten()).view(np.uint64).reshape(batch.num_rows, -1) for c in ("bits", "fine"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, b, differ = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            return pa.RecordBatch.from_arrays([key.take(pa.array(a)), key.take(pa.array(b)), pa.array(low), pa.array(high), pa.array(differ)], _ACROSS_NAMES)

        for start, end in zip(first, [*first[1:], upto], strict=True):
            block = start + int(np.count_nonzero(probe[start:end] == 0))
            for j in range(start, block):
                b = np.arange(j + 1 if salt[j] == 0 else block, end)
                b = b[label[b] != label[j]]
                differ = np.bitwise_count(bits[b] ^ bits[j]).sum(1, dtype=np.int32)
                like = differ <= limit
                if like.any():
                    b, differ = b[like], differ[like]
                    once = ((fine[b] == fine[j]) & (fine[j] != 0)).argmax(1) == at[j]
                    found.append((np.full(int(once.sum()), j), b[once], differ[once]))
                if sum(len(x[1]) for x in found) >= 1 << 16:
                    yield out()
        if found:
            yield out()

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        group = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("band", "chunk", "salt")])
        first = np.concatenate([[0], 1 + np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0))])
        if len(first) > 1:
            yield from told(batch, int(first[-1]), first[:-1])
        held = batch.slice(int(first[-1]))  # the next batch may go on with it
    if held is not None:
        yield from told(pa.Table.from_batches([held]).combine_chunks().to_batches()[0], held.num_rows, np.zeros(1, np.int64))


_ACROSS_SCHEMA = "a binary, b binary, low long, high long, differ int"
_ACROSS_NAMES = [x.split(" ")[0] for x in _ACROSS_SCHEMA.split(", ")]


def _alike(a: Column, b: Column, bits: int, least: float) -> Column:
    """Whether two texts' register bits put their similarity at ``least`` or more: bits of unequal registers differ in half of all cases."""
    differ = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(-(-bits // 64))), F.lit(0))
    return differ <= int(bits * (1 - least) / 2)


def _lists(rows: np.ndarray, none: np.ndarray) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))
    return pc.if_else(pa.array(none), pa.scalar(None, lists.type), lists)


def banded(docs: DataFrame, key: Column, text: str, width: int = 5) -> DataFrame:
    """(doc_id, key binary, bands array<long>, bits array<long>): the identity of each text, its band keys and register bits, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b, data, offsets in blocks(column):
                hashes, first = shingles(words(data, offsets), width)
                registers = signatures(hashes, first)
                none = np.diff(first) == 0
                raw = data.tobytes()
                ids = [hashlib.md5(raw[x:y]).digest() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                lists = [_lists(x, none) for x in (band_keys(registers), register_bits(registers, BITS))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary()), *lists], ["doc_id", "key", "bands", "bits"])

    return docs.select(key.cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, key binary, bands array<long>, bits array<long>")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of hashes: shared occurrences over all."""
    x, n = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], k[j]).sum())
    whole = len(a) + len(b) - both
    return both / whole if whole else 1.0


def verified(pairs: DataFrame, texts: DataFrame, least: float, width: int = 5, share: int = 256) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (key, text) have an overlap of ``least``.

    ``a`` may be the hub of very many pairs: its text is then sent to a task for each ``share`` of them."""
    hubs, _ = compact(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")
    left = pairs.join(hubs, "a").join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), "b").select("a", "b", "text_b", salt.alias("salt"))
    right = hubs.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sides = []
                for c in ("text_a", "text_b"):
                    found: list[np.ndarray] = []
                    for _, _, data, offsets in blocks(batch.column(c)):
                        hashes, first = shingles(words(data, offsets), width)
                        found += [hashes[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
                    sides.append(found)
                good = [overlap(x, y) >= least for x, y in zip(*sides, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return left.join(right, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``class_id``, the least key among its near duplicates.

    Rows of equal text are one node (so copies are never paired), known by the MD5 of the text.
    Nodes that share a band are compared with the band's hub, the text that shares most bands with others: a
    bucket of n texts gives n - 1 pairs. Texts of buckets that then still hold several components are
    banded again, by more registers a band; in each of these finer buckets, however large, the register bits of all texts of different components
    are held against each other, block by block (``_blocks``). Pairs whose register bits differ too much are passed over
    before their texts are read. Buckets of the same texts count once. Classes are the components of the links. A text of fewer than
    five words is one shingle. A text without words, and null, is near its equals only (null counts as empty).
    Rows that repeat are kept; null keys are ignored in the choice of a class's key, and the class is
    null if there is no other. Extra columns are left out; an empty table gives an empty result."""
    return nodes(docs, text, key, least).select(F.col("doc_id").alias(key), "class_id")


def _links(buckets: DataFrame, bits: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Verified (a, b) that connect texts which share a band (``buckets``: band, key, hub) and are near."""
    parts = shuffle_parts(buckets.sparkSession)
    pairs = buckets.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    sides = [bits.withColumnsRenamed({"key": k, "bits": f"bits_{k}"}) for k in "ab"]
    pairs = pairs.join(sides[1], "b").join(sides[0], "a").filter(_alike(F.col("bits_a"), F.col("bits_b"), BITS * REGISTERS, BOUND)).select("a", "b")
    tested, _ = compact(pairs)
    links, _ = compact(verified(tested, texts, least))
    named, _ = compact(components(links).withColumnsRenamed({"node": "key", "component": "label"}))
    label = F.xxhash64(F.coalesce("label", "key")).alias("label")
    open_ = stored(buckets.select("band", "key").join(named, "key", "left").select("band", "key", label))
    several = open_.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band")
    open_, n = compact(open_.join(stored(several), "band").select("key", "label").distinct())
    if not n:
        return links
    # A text costs as much time here as a hundred times its bytes do elsewhere, so tasks are made by their number, not by their size.
    sharp = stored(sharp_bits(texts.join(open_.select("key"), "key").repartition(parts)))
    fine = stored(open_.join(sharp.select("key", "fine"), "key").select("key", "label", F.posexplode("fine").alias("at", "band")))
    rows = _blocks(fine, sharp)
    rows = rows.repartitionByRange(parts, "band", "chunk", "salt").sortWithinPartitions("band", "chunk", "salt", "probe").mapInArrow(_across, _ACROSS_SCHEMA)
    pairs = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "low", "high", "differ").distinct()
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs, n = compact(pairs.join(known, ["a", "b"], "left_anti"))
    return compact(links.unionByName(_nearest_first(pairs, texts, least)))[0] if n else links


def _members() -> list[Column]:
    """Of a bucket: its number of texts, and two hashes that are equal for equal sets of texts."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")]


def _blocks(fine: DataFrame, sharp: DataFrame) -> DataFrame:
    """Rows of fine buckets (key, label, at, band) that hold several labels, as often as they are met: with band, chunk, salt, probe, and ``fine``, their
    buckets of this kind by place. Of buckets with the same texts one stays.

    Two texts of different labels meet in every bucket that both are in: texts of the commonest label are probes of all
    chunks, the others stand in a chunk of their own and are probes of those before it. Chunks are copied for each salt, probes are dealt over salts."""
    counts = fine.groupBy("band", "label").agg(*_members())
    sums = [F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("top")]
    crowded = counts.groupBy("band").agg(*sums).filter("labels > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "top")).alias("b"))
    others = F.col("n") - F.col("b.top.n")
    crowded = stored(crowded.select("b.band", F.col("b.top.label").alias("top"), F.ceil(others / AHEAD).cast("int").alias("chunks"), F.ceil(F.col("n") / F.greatest(F.lit(SPREAD), F.least(others, F.lit(AHEAD)))).cast("int").alias("salts")))
    rows = stored(fine.join(crowded, "band"))
    places = rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", "band"))).alias("m"))
    places = places.select("key", F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda i: F.coalesce(F.get(F.map_values(F.map_filter("m", lambda k, _: k == i)), F.lit(0)), F.lit(0))).alias("fine"))
    own, mine = F.pmod(F.xxhash64("key", "band"), "chunks").cast("int"), F.pmod(F.xxhash64("band", "key"), "salts").cast("int")
    probes = lambda n: F.transform(F.slice(F.sequence(F.lit(0), F.col("chunks")), F.lit(1), n), lambda c: F.struct(c.alias("chunk"), mine.alias("salt"), F.lit(1).alias("probe")))
    block = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(own.alias("chunk"), s.alias("salt"), F.lit(0).alias("probe")))
    copies = F.when(F.col("label") == F.col("top"), probes(F.col("chunks"))).otherwise(F.concat(block, probes(own)))
    return rows.select("key", "label", "at", "band", F.explode(copies).alias("c")).select("key", "label", "at", "band", "c.*").join(sharp.select("key", "bits").join(stored(places), "key"), "key")


def _nearest_first(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Verified (a, b) of ``pairs`` (a, b, low, high, differ) that join the labels low and high, by way of others or directly.

    Of the pairs of two labels that with the likest bits is verified first; the others only if that has not joined
    their labels, so two groups that are near are not compared pair by pair."""
    best, _ = compact(pairs.groupBy("low", "high").agg(F.min(F.struct("differ", "a", "b")).alias("best")).select("low", "high", F.col("best.a").alias("a"), F.col("best.b").alias("b")))
    found, n = compact(verified(best.select("a", "b"), texts, least))
    rest = pairs.join(best.select("a", "b"), ["a", "b"], "left_anti")
    if n:
        joined = components(best.join(found, ["a", "b"]).select(F.col("low").alias("a"), F.col("high").alias("b")))
        joined, _ = compact(joined)
        for side in ("low", "high"):
            rest = rest.join(joined.withColumnsRenamed({"node": side, "component": f"of_{side}"}), side, "left")
        rest = rest.filter(F.coalesce("of_low", "low") != F.coalesce("of_high", "high"))
    rest, n = compact(rest.select("a", "b"))
    return compact(found.unionByName(verified(rest, texts, least)))[0] if n else found


def nodes(docs: DataFrame, text: str, key: str, least: float) -> DataFrame:
    """(doc_id, key, class_id, class_key) for each row: class_key is the text that stands for the class."""
    rows = stored(banded(docs, F.col(key), text))
    node = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    each = node.filter("bands IS NOT NULL").select("key", "rep", F.explode("bands").alias("band"))
    sizes = each.groupBy("band").agg(*_members()).filter("n > 1").groupBy("n", "x", "y").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("times"))
    buckets = stored(each.join(stored(sizes.select("band", (F.col("n") * F.col("times")).alias("n"))), "band"))
    # The text that most others share bands with is the likeliest to be near them: the middle of its group.
    central = stored(buckets.groupBy("key").agg(F.sum("n").alias("c")))
    hubs = buckets.join(central, "key").groupBy("band").agg(F.max(F.struct("c", F.xxhash64("key").alias("o"), "key")).alias("hub"))
    buckets = stored(buckets.join(stored(hubs.select("band", F.col("hub.key").alias("hub"))), "band").select("band", "key", "rep", "hub"))
    wanted = stored(buckets.select("key", "rep").distinct().withColumnsRenamed({"key": "_key", "rep": "_rep"}))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted  # else the texts of all rows are shuffled
    of_rep = (F.col("key") == F.col("_key")) & F.col("rep").eqNullSafe(F.col("_rep"))
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = stored(texts.join(wanted, of_rep).select("key", "text").dropDuplicates(["key"]))
    bits = stored(rows.withColumnRenamed("doc_id", "rep").join(wanted, of_rep).select("key", "bits").dropDuplicates(["key"]))
    links = _links(buckets, bits, texts, least)
    named = rows.groupBy("key").agg(F.min("doc_id").alias("rep"))
    comp, _ = compact(components(links))
    named = named.join(comp.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("comp"))
    best, _ = compact(named.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("best")))
    named = named.join(best, "comp").select("key", F.col("best.rep").alias("class_id"), F.col("best.key").alias("class_key"))
    return rows.select("doc_id", "key").join(stored(named), "key")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each near-duplicate class, with all its columns: that of the class's least key.

    Of rows that repeat both key and text the one whose further columns hash least stays, so that reruns agree;
    null texts count as empty, rows with null keys stand for a class only where it has no other, and an
    empty table gives an empty result. Columns may have any names."""
    best = checkpoint(nodes(docs, text, key, least).select(F.col("class_id").alias("_id"), F.col("class_key").alias("_key")).distinct())
    quoted = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_of"), F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))).alias("_is"), F.struct(*quoted).alias("_row"))
    kept = rows.join(best, (F.col("_is") == F.col("_key")) & F.col("_of").eqNullSafe(F.col("_id"))).select("_is", "_of", "_row")
    order = F.xxhash64("_row")
    return kept.groupBy("_is", "_of").agg(F.min_by("_row", order).alias("_row")).select("_row.*")
