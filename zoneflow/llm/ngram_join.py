"""Near-duplicate documents: Jaccard join of word shingles as a sparse product.

The document by shingle incidence matrix times its transpose holds every overlap.
Only the entries that can reach the threshold are worth computing, so the product is
taken over prefixes: each document's rarest shingles, as many as any partner must
share one of. What is rare is told by a count of all shingles in hash buckets, a table
of fixed size. The product is made in blocks:

* a shingle of few documents is a block, which adds one to each of its pairs;
* the documents of a common shingle are dealt into blocks by size, and each pair of
  blocks is a product of its own over the whole prefixes, so its overlaps are final.

Overlap counts below the bound that follows from the two sizes are discarded; what is
left is checked on the whole sets. Documents with equal sets are one class throughout.
Before the product over common shingles gives all its pairs, it gives a few partners
of each class, drawn by hash, and pairs that the links found so already join are left
out afterwards: a large group of near copies never becomes all of its pairs.

A class is known by two sums over its shingles' 64-bit hashes, and its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.common import fresh, membership_bits, might_be_in, stored
from zoneflow.llm.components import components
from zoneflow.llm.shingles import chunks, mix, shingle_sets

SKETCH_BITS = 20
SKETCH_ROWS = 64
PARTNERS = 4
DRAWS = 2
HOT_TOKENS = 1 << 14
STRIP = 256


@dataclass(frozen=True)
class Threshold:
    """At least ``percent`` per cent of the union are shared, in whole numbers.

    A shingle of more than ``common`` prefixes is common; blocks of its product have
    about ``block`` classes. Neither changes the result.
    """

    percent: int = 80
    common: int = 64
    block: int = 2048

    def least_size(self, n):
        """The smallest partner of a set of ``n``."""
        return -(-self.percent * n // 100)

    def prefix(self, n):
        """Of any set of ``n``, so many have to be looked at to meet every partner."""
        return n - self.least_size(n) + 1

    def overlap(self, a, b):
        """What sets of these sizes must share at least."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix_overlap(self, a, b):
        """What their prefixes must share at least.

        The prefix that ends first misses no shared shingle before its end, and at
        most ``size - overlap`` of its own are not shared.
        """
        need = self.overlap(a, b)
        return np.maximum(
            1, np.minimum(self.prefix(a) - (a - need), self.prefix(b) - (b - need))
        )

    def linked(self, shared, a, b):
        return 100 * shared >= self.percent * (a + b - shared)


# -- counts of all shingles


def shingle_counts(docs: DataFrame, words: int, text_col: str = "text") -> np.ndarray:
    """How many documents' shingles fall in each of ``2 ** SKETCH_BITS`` buckets.

    Tasks send their counts in compressed slices, which are added up by slice; the
    table that comes to the driver has the same size for any input.
    """
    size = (1 << SKETCH_BITS) // SKETCH_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for run in chunks(batch.column(0).to_pylist()):
                value, _ = shingle_sets(run, words)
                total += np.bincount(_bucket(value), minlength=len(total))
        slices = [zlib.compress(x.tobytes(), 1) for x in total.reshape(SKETCH_ROWS, size)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_ROWS), pa.int32()), pa.array(slices, pa.binary())], ["part", "counts"]
        )

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                have = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
                sums[part] = sums[part] + have if part in sums else have
        rows = [(k, zlib.compress(v.tobytes(), 1)) for k, v in sums.items()]
        yield pd.DataFrame(rows, columns=["part", "counts"])

    schema = "part int, counts binary"
    made = docs.select(F.col(text_col)).mapInArrow(count, schema)
    summed = made.repartition(SKETCH_ROWS, "part").mapInPandas(add, schema).collect()
    total = np.zeros((SKETCH_ROWS, size), dtype=np.int64)
    for row in summed:
        total[row["part"]] += np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return total.reshape(-1)


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _signed(value: np.ndarray) -> pa.Array:
    return pa.array(value.view(np.int64))


def _set_hash(value: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """Hash of a set: the sum of its mixed hashes, and its size."""
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(mix(value ^ np.uint64(seed)), out=total[1:])
    size = np.diff(bounds).astype(np.uint64)
    return mix(total[bounds[1:]] - total[bounds[:-1]] + size * np.uint64(0x9E3779B97F4A7C15))


def _set_id(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return _set_hash(value, bounds, 0)


def _set_check(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A second hash, so that sets are known by 128 bits in all."""
    return _set_hash(value, bounds, 0x5851F42D4C957F2D)


def _told_apart(known: DataFrame) -> DataFrame:
    """The rows with ids of their own for sets that have one hash but not the other.

    Such sets are a chance in 2^64 for any two; a class's id stays one number.
    """
    chance = known.groupBy("set_id").agg(F.min("check").alias("lo"), F.max("check").alias("hi"))
    chance = stored(chance.where("lo <> hi").select("set_id", F.lit(True).alias("clash")), "clashes")
    named = known.withColumn("hash", F.col("set_id"))
    if chance.isEmpty():
        return named
    own = F.when(F.col("clash"), F.xxhash64("set_id", "check")).otherwise(F.col("set_id"))
    return named.join(chance, "set_id", "left").withColumn("set_id", own).drop("clash")


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, rule: Threshold) -> DataFrame:
    """Per document: ``doc_id``, hash of the text, ``set_id``, ``check``, size ``n``, ``prefix``.

    ``prefix`` has the set's rarest shingles, rarest first, ties by hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for run in chunks(batch.column(2).to_pylist()):
                value, bounds = shingle_sets(run, words)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(run)), n)
                order = np.lexsort((value, shared.value[_bucket(value)], owner))
                kept = np.where(n > 0, rule.prefix(n), 0)
                ahead = np.arange(len(value)) - bounds[:-1][owner] < kept[owner]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()),
                    _signed(value[order][ahead]),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(run)),
                        batch.column(1).slice(done, len(run)),
                        _signed(_set_id(value, bounds)),
                        _signed(_set_check(value, bounds)),
                        pa.array(n, pa.int32()),
                        lists,
                    ],
                    ["doc_id", "text_id", "set_id", "check", "n", "prefix"],
                )
                done += len(run)

    schema = "doc_id long, text_id long, set_id long, check long, n int, prefix array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(make, schema)


# -- the product over shingles that few documents share


_LISTED = "token long, a long, na int, b long, nb int, shared long"
_LISTED_ARROW = pa.schema(
    [("token", pa.int64()), ("a", pa.int64()), ("na", pa.int32()), ("b", pa.int64()), ("nb", pa.int32()), ("shared", pa.int64())]
)


def _listed(**columns: np.ndarray) -> pa.RecordBatch:
    size = len(columns["a"])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
            for f in _LISTED_ARROW
        ],
        schema=_LISTED_ARROW,
    )


def _pairs_of_runs(run: np.ndarray, set_id: np.ndarray, n: np.ndarray, rule: Threshold) -> pa.RecordBatch:
    """Pairs within runs, their sizes near enough, and how often each was met."""
    left, right = [], []
    for gap in range(1, rule.common):
        at = np.flatnonzero(run[gap:] == run[:-gap]) if gap < len(run) else np.empty(0, np.int64)
        if not len(at):
            break
        at = at[n[at] >= rule.least_size(n[at + gap])]
        left.append(at)
        right.append(at + gap)
    i = np.concatenate([np.empty(0, np.int64), *left])
    j = np.concatenate([np.empty(0, np.int64), *right])
    order = np.lexsort((set_id[j], set_id[i]))
    i, j = i[order], j[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (set_id[i][1:] != set_id[i][:-1]) | (set_id[j][1:] != set_id[j][:-1])
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(i)))
    i, j = i[start], j[start]
    return _listed(a=set_id[i], na=n[i], b=set_id[j], nb=n[j], shared=times)


def lists(classes: DataFrame, rule: Threshold) -> DataFrame:
    """The product over shingles of at most ``rule.common`` documents, and the other lists.

    Rows with ``shared`` are pairs and part of their overlap. The others, with a
    ``token``, are entries ``a`` of a common shingle's list. Entries are
    range-partitioned by shingle and size, so that one list may span many tasks;
    shingles at a task's edges count as common.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))
        held, long_run = empty, None
        first = True

        def done(rows, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, long_run, first
            token, n, set_id = rows
            if not len(token):
                return
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(start, len(token)))
            whole = np.repeat(size, size)
            run = np.repeat(np.arange(len(start)), size)
            many = whole > rule.common
            if long_run is not None:
                many |= token == long_run
            if first or last:
                many |= (first & (run == 0)) | (last & (run == len(start) - 1))
            tail = run == len(start) - 1 if not last else np.zeros(len(run), dtype=bool)
            first = first and len(start) == 1
            wait = tail & ~many
            held = (token[wait], n[wait], set_id[wait])
            if not last:
                long_run = token[-1] if many[-1] else None
            if many.any():
                yield _listed(token=token[many], a=set_id[many], na=n[many])
            few = ~many & ~wait & (whole > 1)
            if few.any():
                yield _pairs_of_runs(run[few], set_id[few], n[few], rule)

        for batch in batches:
            if batch.num_rows:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                rows = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                yield from done(rows, False)
        yield from done(held, True)

    entries = classes.select(F.explode("prefix").alias("token"), "n", "set_id")
    order = ("token", "n", "set_id")
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, _LISTED)


# -- the product over common shingles, block by block


def blocks(entries: DataFrame, parts: DataFrame, rule: Threshold, draw: int | None = None) -> DataFrame:
    """Common shingles' entries as they meet in blocks: all that must meet, or a draw.

    ``entries``: common shingles' lists (token, a, na). ``parts``: classes (node)
    known to belong together (component). A list whose classes all belong together
    needs no product. A long list is dealt into blocks by size and hash; those whose
    sizes cannot match never meet. Classes of a list's largest component have no need to
    meet each other: an entry of it goes to the blocks of the others only, which are few
    once the links of a draw are known. In a draw an entry meets its own block alone.

    The few shingles with very many entries are not gathered to be dealt: what there is
    to know of a list is one row, sent to all tasks for those shingles.
    """
    named = (
        entries.select("token", F.col("a").alias("node"), F.col("na").alias("n"))
        .join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    spans = stored(
        named.groupBy("token", "component")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("token")
        .agg(
            F.sum("size").alias("size"),
            F.max(F.struct("size", "component")).alias("main"),
            F.count(F.lit(1)).alias("components"),
        )
        .where("components > 1")
        .select("token", "size", "main.component", F.col("main.size").alias("main_size"))
        .withColumnRenamed("component", "main"),
        "spans",
    )
    total = spans.agg(F.sum("size").alias("n")).first()["n"] or 0
    if draw is None:
        main_parts = F.ceil(F.col("main_size") / rule.block).cast("int")
        other_parts = F.ceil((F.col("size") - F.col("main_size")) / rule.block).cast("int")
        whole = F.col("size") <= rule.block
    else:
        main_parts, whole = F.lit(0), F.lit(False)
        other_parts = F.ceil(F.col("size") / rule.block).cast("int")
    dealing = spans.select(
        "token", "size", "main", main_parts.alias("k_main"), other_parts.alias("k"), whole.alias("whole")
    )
    hot = dealing.where(F.col("size") > max(total // HOT_TOKENS, rule.block)).drop("size")
    cold = dealing.where(F.col("size") <= max(total // HOT_TOKENS, rule.block)).drop("size")
    is_hot = F.broadcast(hot.select("token"))
    rows = named.join(F.broadcast(hot), "token").unionByName(
        named.join(is_hot, "token", "left_anti").join(cold, "token")
    )
    step = float(np.log(100 / rule.percent))
    # A partner's size is at most one step away; the margin is for rounding.
    step *= 1.000001
    in_main = (F.col("component") == F.col("main")) if draw is None else F.lit(False)
    hashed = F.xxhash64("node") if draw is None else F.xxhash64("node", F.lit(draw))
    part = F.when(in_main, F.pmod(hashed, F.greatest("k_main", F.lit(1)))).otherwise(
        F.col("k_main") + F.pmod(hashed, F.greatest("k", F.lit(1)))
    )
    own = F.struct(
        F.floor(F.log(F.col("n").cast("double")) / step).cast("int").alias("size"),
        part.cast("int").alias("part"),
    )
    meets = (
        F.sequence(F.when(in_main, F.col("k_main")).otherwise(F.lit(0)), F.col("k_main") + F.col("k") - 1)
        if draw is None
        else F.array(F.col("own.part"))
    )
    others = F.flatten(
        F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)),
            lambda d: F.transform(
                meets, lambda p: F.struct((F.col("own.size") + d).alias("size"), p.cast("int").alias("part"))
            ),
        )
    )
    alone = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("part")))
    return (
        rows.withColumn("own", F.when(F.col("whole"), F.element_at(alone, 1)).otherwise(own))
        .withColumn("other", F.explode(F.when(F.col("whole"), alone).otherwise(others)))
        .select(
            "token",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") <= F.col("other")).alias("is_low"),
            (F.col("own") >= F.col("other")).alias("is_high"),
            "node",
            "n",
            "component",
        )
    )


def _overlaps(
    lists_: pa.ChunkedArray, rows: np.ndarray, columns: np.ndarray, below: int | None = None
) -> np.ndarray:
    """How many values the lists of ``rows`` share with those of ``columns``: only those ``below``."""
    made = lists_.combine_chunks()
    if isinstance(made, pa.ChunkedArray):
        made = pa.concat_arrays(made.chunks)
    value = made.flatten().to_numpy()
    owner = np.repeat(np.arange(len(made)), np.asarray(made.value_lengths()))
    if below is not None:
        value, owner = value[value < below], owner[value < below]
    _, code, times = np.unique(value, return_inverse=True, return_counts=True)
    useful = times[code] > 1
    _, code = np.unique(code[useful], return_inverse=True)
    owner = owner[useful]
    shared = np.zeros((len(rows), len(columns)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    values, width = int(code[-1]) + 1 if len(code) else 0, 512
    for start in range(0, values, width):
        a, b = np.searchsorted(code, [start, start + width])
        block = np.zeros((len(made), min(width, values - start)), dtype=np.float32)
        block[owner[a:b], code[a:b] - start] = 1
        right = block[columns].T
        for row in range(0, len(rows), STRIP):
            shared[row : row + STRIP] += block[rows[row : row + STRIP]] @ right
    return shared


def _product(table: pa.Table, rule: Threshold, partners: int | None) -> pa.Table:
    """One block: overlaps of all its prefixes at once, and the pairs that have enough.

    A pair counts in the block of its first common shingle only. With ``partners``
    each class keeps so many of its pairs, by hash.
    """
    node, n = table["node"].to_numpy(), table["n"].to_numpy().astype(np.int64)
    part = table["component"].to_numpy()
    # Only the classes of one side are multiplied with those of the other.
    low, high = (np.flatnonzero(table[c].to_numpy()) for c in ("is_low", "is_high"))
    shared = _overlaps(table["prefix"], low, high)
    # Pairs that met before are another block's.
    np.putmask(shared, _overlaps(table["lists"], low, high, below=table["token"][0].as_py()) > 0, 0)
    met = []
    for row in range(0, len(low), STRIP):
        strip = shared[row : row + STRIP]
        r, c = np.nonzero(strip >= 1)
        count, i, j = strip[r, c], low[r + row], high[c]
        ahead = (n[i] < n[j]) | ((n[i] == n[j]) & (node[i] < node[j]))
        i, j = np.where(ahead, i, j), np.where(ahead, j, i)
        keep = (node[i] != node[j]) & (part[i] != part[j]) & (n[i] >= rule.least_size(n[j]))
        count, i, j = count[keep], i[keep], j[keep]
        keep = count >= rule.prefix_overlap(n[i], n[j])
        met.append(i[keep] * len(node) + j[keep])
    # Where both sides hold both classes, a pair was met twice.
    i, j = np.divmod(np.unique(np.concatenate(met or [np.empty(0, np.int64)])), len(node))
    if partners is not None:
        drawn = mix(mix(node[i].view(np.uint64)) ^ node[j].view(np.uint64))
        chosen = np.zeros(len(i), dtype=bool)
        for side in (i, j):
            order = np.lexsort((drawn, side))
            start = np.flatnonzero(np.diff(side[order], prepend=-1))
            nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            chosen[order[nth < partners]] = True
        i, j = i[chosen], j[chosen]
    return pa.table(
        {"a": node[i], "na": n[i].astype(np.int32), "b": node[j], "nb": n[j].astype(np.int32)}
    )


def _common_pairs(
    common: DataFrame, classes: DataFrame, parts: DataFrame, rule: Threshold, draw: int | None = None
) -> DataFrame:
    """The product over common shingles: all pairs of different parts, or a few of each class."""
    partners = None if draw is None else PARTNERS
    dealt = stored(blocks(common, parts, rule, draw), "blocks")
    own = dealt.groupBy("node").agg(F.collect_set("token").alias("lists"))
    bits = membership_bits(dealt.select(F.col("node").alias("set_id")), "set_id")
    wanted = might_be_in(classes.select("set_id", "prefix"), "set_id", bits)
    full = dealt.join(own, "node").join(wanted.withColumnRenamed("set_id", "node"), "node")

    def product(table: pa.Table) -> pa.Table:
        return _product(table, rule, partners)

    return full.groupBy("token", "low", "high").applyInArrow(product, "a long, na int, b long, nb int")


# -- the check on whole sets


def _linked(pairs: DataFrame, docs: DataFrame, ids: DataFrame, words: int, rule: Threshold) -> DataFrame:
    """Those of ``pairs`` (a, b, na, nb) whose whole sets are near enough: (a, b).

    The sets are made again from one text of each class; only texts whose hash may be
    wanted leave the scan.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    texts = stored(nodes.join(ids, "set_id").select("set_id", "hash", "check", "text_id"), "wanted")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in chunks(batch.column(0).to_pylist()):
                value, bounds = shingle_sets(run, words)
                sets = [value[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                both = [_signed(of(value, bounds)) for of in (_set_id, _set_check)]
                yield pa.RecordBatch.from_arrays(
                    [*both, pa.array(sets, pa.binary())], ["hash", "check", "members"]
                )

    found = might_be_in(
        docs.select(F.xxhash64("text").alias("text_id"), "text"), "text_id", membership_bits(texts, "text_id")
    ).select("text")
    # Copies of a text collapse where they are read, before a set is sent anywhere.
    made = (
        found.mapInArrow(make, "hash long, check long, members binary")
        .groupBy("hash", "check")
        .agg(F.first("members").alias("members"))
    )
    named = texts.select("set_id", "hash", "check")
    sets = stored(made.join(named, ["hash", "check"]).select("set_id", "members"), "sets")
    left = sets.select(F.col("set_id").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("members").alias("right"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(rule.linked(shared, len(x), len(y))))
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.mapInPandas(check, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    rule: Threshold | None = None,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id``.

    Documents are linked when they share at least ``percent`` per cent of the union of
    their shingles; ``component_id`` is the smallest id that links lead to. Ids are
    integers. A NULL or text without words has no shingles, is linked with nothing
    and has its own id. Repeated rows are rows of their own. A NULL id is never a
    component's id unless all ids there are NULL. No other column is read.
    """
    made = _grouped(docs, words, id_col, text_col, rule or Threshold(percent))
    return made.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, words: int, id_col: str, text_col: str, rule: Threshold) -> DataFrame:
    """Per row: ``doc_id``, hash of the text, size ``n``, ``component_id``, and ``root``.

    Rows of one component have one ``root``; it is NULL where a row is linked with nothing.
    """
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    counts = shingle_counts(docs, words)
    known = _told_apart(stored(prefixes(docs, counts, words, rule), "prefixes"))
    full = known.where("n > 0")
    ids = full.groupBy("set_id").agg(
        F.min("doc_id").alias("first_id"),
        F.min("text_id").alias("text_id"),
        F.first("hash").alias("hash"),
        F.first("check").alias("check"),
    )
    # One row per class before anything is sent by shingle: copies fall away in the tasks.
    classes = full.groupBy("set_id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    listed = stored(lists(classes, rule), "lists")
    common = listed.where("shared is null")
    few_links = None
    parts = docs.sparkSession.createDataFrame([], "node long, component long")
    for draw in range(DRAWS if not common.isEmpty() else 0):
        drawn = stored(_common_pairs(common, classes, parts, rule, draw), "drawn")
        found = _linked(drawn, docs, ids, words, rule)
        few_links = stored(found if few_links is None else found.union(few_links), "links")
        parts = stored(components(few_links), "parts")
    few = listed.where("shared is not null").groupBy("a", "na", "b", "nb").agg(F.sum("shared").alias("shared"))
    pairs = _enough(few, rule).select("a", "na", "b", "nb")
    pairs = stored(pairs.union(_common_pairs(common, classes, parts, rule)).distinct(), "pairs")
    links = _linked(pairs, docs, ids, words, rule)
    if few_links is not None:
        links = links.union(few_links)
    roots = stored(components(links).withColumnRenamed("node", "set_id"), "roots")
    named = stored(ids.select("set_id", "first_id").join(roots, "set_id"), "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = named.join(least, "component").select("set_id", "component_id")
    roots = roots.withColumnRenamed("component", "root")
    # Written, so that the join of all rows can split a set that very many rows have.
    by_set = stored(
        ids.join(linked, "set_id", "left")
        .join(roots, "set_id", "left")
        .select(
            "set_id",
            F.coalesce("component_id", "first_id").alias("component_id"),
            F.coalesce("root", "set_id").alias("root"),
        ),
        "by-set",
    )
    joined = full.select("doc_id", "text_id", "n", "set_id").join(by_set, "set_id").drop("set_id")
    alone = known.where("n = 0").select(
        "doc_id", "text_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")
    )
    return joined.unionByName(alone)


def _enough(pairs: DataFrame, rule: Threshold) -> DataFrame:
    """Pairs (a, na, b, nb, shared) whose prefixes share what the sizes demand."""
    na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
    total, p = na + nb, rule.percent
    need = F.floor((p * total + 99 + p) / (100 + p))
    spare = [n - F.floor((p * n + 99) / 100) + 1 - (n - need) for n in (na, nb)]
    bound = F.greatest(F.lit(1), F.least(*spare))
    return pairs.where(F.col("shared") >= bound)


def keep_one(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component of ``near_duplicates``, whatever ids the rows have.

    Rows are told apart by id and text: two rows of one id and unlike texts are two
    documents, and rows without an id are compared like all others. The row that stays is
    the first by id, NULL last, then by the hash of its text. Texts without words are
    linked with nothing and stay; rows equal in id and text are one document.
    """
    grouped = stored(_grouped(docs, words, id_col, text_col, Threshold(percent)), "grouped")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    first = grouped.where("root is not null").groupBy("root").agg(F.min(row).alias("row"))
    stay = first.select("row.*").union(grouped.where("root is null").select(row.alias("row")).select("row.*"))
    key, text = fresh("key"), fresh("text")
    names = stay.distinct().select(F.col("doc_id").alias(key), F.col("text_id").alias(text))
    own_id, own_text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.withColumns({key: own_id, text: F.xxhash64(own_text)})
    kept = keyed.alias("d").join(
        names.alias("k"),
        F.col(f"d.{key}").eqNullSafe(F.col(f"k.{key}")) & (F.col(f"d.{text}") == F.col(f"k.{text}")),
        "left_semi",
    )
    return kept.dropDuplicates([key, text]).select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ \\t\\n\\x0B\\x0C\\r]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
  WHERE 100 * k >= 80 * (nx.n + ny.n - k)
), r AS (
  SELECT doc_id, doc_id AS root FROM d
  UNION
  SELECT e.y AS doc_id, r.root FROM r JOIN e ON r.doc_id = e.x
), c AS (
  SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id
"""
