"""Passages that occur more than once, found by FM-indexes and cut out.

A window of ``window`` words is a repeat if its words also start anywhere else. Each
window is sent where its equals must be: to the shard of its anchor, the rarest of its
``GRAM``-word grams, the rightmost of equal ones. Neighbouring windows mostly have one
anchor, and they travel as one stretch of text. A stretch whose anchor no other shares
cannot hold a repeat and stays behind; equal stretches are one, with a weight.

A shard builds one compressed FM-index over its stretches (a wavelet tree of eight
branches, kept level by level as packed bits, over the Burrows-Wheeler transform) and streams them through it, all side by side:
backward search extends each match to the left while it still has a weight of two, which
gives the matching statistics that decide its windows. Shards hold a bounded number of
words and the whole costs one pass over them, since no text meets a foreign shard.

Rarity comes from a count of all grams in ``2 ** SKETCH_BITS`` buckets, of which only the
order of magnitude is sent out. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow.llm.common import MEMBERSHIP_WORDS, _bit, fresh, membership_bits, might_be_in, stored
from zoneflow.llm.shingles import chunks, mix

WINDOW = 35
GRAM = 12
SKETCH_BITS = 22
SKETCH_PARTS = 64
SHARD_WORDS = 400_000
MANY = 1 << 14
LONG_TEXT = 1 << 22  # bytes hashed at once
STRETCH = 1 << 19  # windows looked at at once

_STEP = np.uint64(0x9FB21C651E98DF25)
_LETTER = np.uint64(0xA0761D6478BD642F)
_SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(_SPACES)] = True


# -- words and grams


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)[:n]


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _spans_hash(value: np.ndarray, start: np.ndarray, stop: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of every ``value[start:stop]``, by differences of one running polynomial."""
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value * _powers(base, len(value)), out=total[1:])
    shifted = (total[stop] - total[start]) * _powers(_inverse(base), len(value) + 1)[start]
    return mix(shifted + (stop - start).astype(np.uint64))


def _coded(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer, and how many lie before each of ``ends``."""
    letters = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[letters], prepend=True, append=True))
    start, stop = edge[::2], edge[1::2]
    hashes = _spans_hash(letters.astype(np.uint64) + np.uint64(1), start, stop, _LETTER)
    return hashes, np.searchsorted(start, ends)


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    start = 0
    while start < len(data):
        stop = start + LONG_TEXT
        if stop < len(data):
            part = np.frombuffer(data, np.uint8, offset=start)
            gaps = np.flatnonzero(_IS_SPACE[part[:LONG_TEXT]])
            if len(gaps):
                stop = start + int(gaps[-1]) + 1
            else:  # one word fills the part: take all of it
                while stop < len(data) and data[stop] not in _SPACES:
                    stop += 1
        yield data[start:stop]
        start = stop


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, as written, and each text's bounds."""
    if len(texts) == 1 and len(texts[0]) > LONG_TEXT:
        parts = [_coded(piece, np.empty(0))[0] for piece in _pieces(texts[0])]
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, before = _coded(b"\n".join(texts) + b"\n", ends)
    return hashes, np.concatenate([[0], before])


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` words from each place on."""
    count = max(0, len(codes) - GRAM + 1)
    value = np.zeros(count, dtype=np.uint64)
    for k in range(GRAM):
        value = value * _STEP + codes[k : k + count]
    return mix(value)


def _bucket(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def gram_magnitudes(texts: DataFrame) -> np.ndarray:
    """Binary order of magnitude of the grams counted in each bucket, over all texts.

    Tasks send compressed slices that are added up slice by slice; the table has the
    same size for any input.
    """
    size = (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for run in chunks(batch.column(0).to_pylist()):
                codes, bounds = word_codes(run)
                gram = _grams(codes)
                owner = np.repeat(np.arange(len(run)), np.diff(bounds))
                whole = owner[: len(gram)] == owner[GRAM - 1 :] if len(gram) else np.empty(0, bool)
                found, times = np.unique(_bucket(gram[whole]), return_counts=True)
                total[found] += times
        parts = [zlib.compress(part.tobytes(), 1) for part in total.reshape(SKETCH_PARTS, size)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        rows = [zlib.compress(_magnitude(x).tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], ["part", "counts"]
        )

    schema = "part int, counts binary"
    summed = texts.mapInArrow(count, schema).repartition(SKETCH_PARTS, "part").mapInArrow(add, schema)
    table = np.zeros((SKETCH_PARTS, size), dtype=np.uint8)
    for row in summed.collect():
        table[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return table.reshape(-1)


def _magnitude(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


# -- stretches of windows with one anchor


def _rightmost_least(key: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` neighbours, the rightmost of equal ones."""
    at = np.arange(len(key))
    done, best, reach = None, at, 1
    covered = 0
    while width:
        if width & 1:
            if done is None:
                done, covered = best, reach
            else:
                n = len(key) - covered - reach + 1
                left, right = done[:n], best[covered : covered + n]
                done, covered = np.where(key[right] <= key[left], right, left), covered + reach
        width >>= 1
        if width:
            n = len(key) - 2 * reach + 1
            left, right = best[:n], best[reach : reach + n]
            best, reach = np.where(key[right] <= key[left], right, left), 2 * reach
    return done


def stretches(
    codes: np.ndarray, bounds: np.ndarray, magnitude: np.ndarray, window: int
) -> tuple[np.ndarray, ...]:
    """All windows of some texts as stretches: text, first window, windows, anchor, words.

    Windows are counted from their text's first word; the last two are hashes, of the
    anchor gram and of all words of the stretch.
    """
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    found = []
    for base in range(0, len(codes) - window + 1, STRETCH):
        part = codes[base : base + STRETCH + window - 1]
        gram = _grams(part)
        rare = magnitude[_bucket(gram)].astype(np.uint64) << np.uint64(58)
        anchor = _rightmost_least(rare | (gram >> np.uint64(6)), window - GRAM + 1)
        first = np.arange(base, base + len(anchor))
        owner = np.searchsorted(bounds, first, side="right") - 1
        whole = first + window <= bounds[owner + 1]
        first, anchor, owner = first[whole], anchor[whole], owner[whole]
        if not len(first):
            continue
        new = np.ones(len(first), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        cut = np.flatnonzero(new)
        size = np.diff(np.append(cut, len(first)))
        start = first[cut]
        words = _spans_hash(part, start - base, start - base + size + window - 1, _STEP)
        found.append((owner[cut], start - bounds[owner[cut]], size, gram[anchor[cut]], words))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none


_KEPT = "struct<anchor:bigint,words:bigint,size:int,starts:array<int>>"


def _gathered(owner: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, words: np.ndarray):
    """Equal stretches of one text as one, with all their places, ascending."""
    order = np.lexsort((start, words, anchor, owner))
    owner, start, size, anchor, words = (x[order] for x in (owner, start, size, anchor, words))
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (words[1:] != words[:-1])
    cut = np.flatnonzero(new)
    places = pa.ListArray.from_arrays(
        pa.array(np.append(cut, len(owner)), pa.int32()), pa.array(start, pa.int32())
    )
    columns = [pa.array(x[cut].view(np.int64)) for x in (anchor, words)]
    made = pa.StructArray.from_arrays(
        [*columns, pa.array(size[cut], pa.int32()), places], ["anchor", "words", "size", "starts"]
    )
    return owner[cut], made


def _described(texts: DataFrame, magnitude: np.ndarray, window: int) -> DataFrame:
    """Per text (``text_id``) its ``stretches``; texts without a window are left out."""
    shared = texts.sparkSession.sparkContext.broadcast(magnitude)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for run in chunks(batch.column(1).to_pylist()):
                owner, made = _gathered(*stretches(*word_codes(run), shared.value, window))
                bounds = pa.array(np.searchsorted(owner, np.arange(len(run) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(run)), pa.ListArray.from_arrays(bounds, made)],
                    ["text_id", "stretches"],
                )
                done += len(run)

    return texts.mapInArrow(describe, f"text_id binary, stretches array<{_KEPT}>").where(
        F.size("stretches") > 0
    )


# -- the index of one shard


class Branches:
    """One level of a wavelet matrix: where each of its ``2 ** BITS`` branches goes on.

    Per branch packed bits tell which places take it, and a count per 64 places how many
    before them do, from where the branch begins in the level below.
    """

    BITS = 3
    BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)

    def __init__(self, branch: np.ndarray) -> None:
        self.width = np.int32(len(branch) // 64 + 1)
        planes = np.zeros((1 << self.BITS, self.width), dtype=np.uint64)
        for k in range(1 << self.BITS):
            packed = np.packbits(branch == k, bitorder="little")
            planes[k].view(np.uint8)[: len(packed)] = packed
        self.planes = planes.reshape(-1)
        ones = np.bitwise_count(self.planes)
        self.before = np.zeros(len(ones), dtype=np.int32)
        np.cumsum(ones[:-1], out=self.before[1:])

    def follow(self, branch: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = branch * self.width + (at >> 6)
        return self.before[word] + np.bitwise_count(self.planes[word] & self.BELOW[at & 63])


class FMIndex:
    """Backward search over texts of whole numbers from 1; 0 ends a text.

    Suffixes are sorted by their first ``depth`` symbols, which is exact for patterns
    shorter than that. ``weight`` is per symbol of the text; an interval's weight is the
    sum over its suffixes.
    """

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int) -> None:
        order = self._sorted(text, depth)
        last = text[order - 1]
        self.heavier = np.zeros(len(text) + 1, dtype=np.int64)
        np.cumsum(weight[order], out=self.heavier[1:])
        sigma = int(text.max(initial=0)) + 1
        self.smaller = np.zeros(sigma + 1, dtype=np.int32)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.smaller[1:])
        self.levels: list[tuple[int, Branches]] = []
        bits, mask = Branches.BITS, (1 << Branches.BITS) - 1
        for shift in reversed(range(0, max(1, (sigma - 1).bit_length()), bits)):
            branch = (last >> shift) & mask
            self.levels.append((shift, Branches(branch)))
            last = np.concatenate([last[branch == k] for k in range(mask + 1)])
        everyone = np.arange(sigma, dtype=np.int32)
        self.smaller = self.smaller[:-1] - self._place(everyone, np.zeros_like(everyone))

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> np.ndarray:
        rank, reach = text.astype(np.int64), 1
        while reach < depth:
            after = np.zeros_like(rank)
            after[:-reach] = rank[reach:] + 1
            found, rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
            reach *= 2
            if len(found) == len(text):
                break
        return np.argsort(rank, kind="stable")

    def _place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, branches in self.levels:
            at = branches.follow((symbol >> shift) & ((1 << Branches.BITS) - 1), at)
        return at

    def extend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Interval bounds of ``symbol`` before what the bounds ``at`` stand for."""
        return self.smaller[symbol] + self._place(symbol, at)

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.heavier[high] - self.heavier[low]


def repeats(lists: list[np.ndarray], weight: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Windows of the word lists that occur more than once among all: list, first, last.

    A list of weight w counts w times. All lists are searched side by side, each from
    its end, for as long as the match has a weight of two. Where it cannot go on, the
    windows to its right are decided, and that list's search starts again with the last
    window that is not.
    """
    length = np.array([len(x) for x in lists])
    first = np.cumsum(length + 1) - length - 1
    flat = np.zeros(int((length + 1).sum()), dtype=np.uint64)
    inside = np.ones(len(flat), dtype=bool)
    inside[first + length] = False
    flat[inside] = np.concatenate(lists)
    text = np.zeros(len(flat), dtype=np.int32)
    text[inside] = np.unique(flat[inside], return_inverse=True)[1] + 1
    index = FMIndex(text, np.repeat(weight, length + 1), int(length.max()) + 1)
    whole = np.int32(len(text))
    lane, end, at = np.arange(len(lists)), length - 1, length - 1
    low, high = np.zeros(len(lane), np.int32), np.full(len(lane), whole)
    found = [(np.empty(0, np.int64),) * 3]
    while len(lane):
        symbol = text[first[lane] + at]
        both = index.extend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        low, high = both[: len(lane)], both[len(lane) :]
        longer = index.weight(low, high) >= 2
        at = at - longer
        stuck = np.flatnonzero(~longer | (at < 0))
        if not len(stuck):
            continue
        stop = at[stuck]
        hit = stop + window <= end[stuck]
        found.append((lane[stuck][hit], stop[hit] + 1, end[stuck][hit] - window + 1))
        # The windows that begin where the match stopped or before are still open.
        end[stuck] = at[stuck] = np.minimum(stop + window - 1, end[stuck] - 1)
        low[stuck], high[stuck] = 0, whole
        on = np.ones(len(lane), dtype=bool)
        on[stuck] = (stop >= 0) & (end[stuck] >= window - 1)
        if not on.all():
            lane, end, at, low, high = lane[on], end[on], at[on], low[on], high[on]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# -- all texts


def repeated_spans(texts: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per text that has any: ``text_id`` and ``spans`` of words that repeated windows cover.

    ``texts`` has a ``text_id`` (binary, one per different text) and the ``text``, one row
    per occurrence. Spans are (begin, end), end exclusive, several may overlap.
    """
    magnitude = gram_magnitudes(texts.select("text"))
    described = stored(_described(texts.select("text_id", "text"), magnitude, window), "stretches")
    every = described.select("text_id", F.inline("stretches"))
    counted = every.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n"), F.count(F.lit(1)).alias("rows"))
    shared = stored(counted.where("n > 1").select("anchor", "rows"), "anchors")
    near = might_be_in(every, "anchor", membership_bits(shared, "anchor"))
    many = _many(shared)
    # Copies of a text have the same stretches: one row for them, with their number.
    kept = stored(
        _by_key(near, shared.select("anchor"), many.select("anchor"), ["anchor"], "left_semi")
        .groupBy("anchor", "words", "text_id", "size")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("starts").alias("starts")),
        "candidates",
    )
    groups = kept.groupBy("anchor", "words").agg(
        F.sum(F.col("copies") * F.size("starts")).alias("n"),
        F.count(F.lit(1)).alias("rows"),
        F.min(F.struct("text_id", F.col("starts")[0].alias("start"), "size")).alias("at"),
    )
    chosen = stored(groups.select("anchor", "words", "n", "rows", "at.*"), "representatives")
    total = chosen.agg(F.sum(F.col("size") + window).alias("words")).first()["words"] or 0
    shards = int(-(-total // shard_words)) or 1
    hits = stored(_search(texts, chosen, shards, window), "hits")
    many = _many(chosen).select("anchor", "words")
    found = _by_key(kept, hits, many, ["anchor", "words"], "inner")
    start = F.explode("starts").alias("start")
    spans = found.select("text_id", "first", "last", start).select(
        "text_id",
        (F.col("start") + F.col("first")).alias("begin"),
        (F.col("start") + F.col("last") + window).alias("end"),
    )
    return spans.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def _many(counted: DataFrame) -> DataFrame:
    """Keys with more ``rows`` than one in ``MANY`` of all, so there are at most ``MANY``."""
    total = counted.agg(F.sum("rows").alias("rows")).first()["rows"] or 0
    return counted.where(F.col("rows") > max(total // MANY, 64))


def _by_key(rows: DataFrame, side: DataFrame, many: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join ``rows`` to ``side``; rows of the few keys that have ``many`` are not shuffled.

    ``side`` has a bounded number of rows per key, so its rows of those keys can be sent
    to all tasks. The other keys have few enough rows for any task.
    """
    many = F.broadcast(many)
    hot = rows.join(many, keys, "left_semi").join(F.broadcast(side.join(many, keys, "left_semi")), keys, how)
    return hot.unionByName(rows.join(many, keys, "left_anti").join(side, keys, how))


def _search(texts: DataFrame, chosen: DataFrame, shards: int, window: int) -> DataFrame:
    """The repeated windows (``first`` to ``last``) of each different stretch."""
    bits = membership_bits(chosen.select("text_id"), "text_id")
    one = might_be_in(texts.select("text_id", "text"), "text_id", bits)
    one = one.groupBy("text_id").agg(F.first("text").alias("text"))
    wanted = chosen.groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "size", "anchor", "words", "n"))).alias("cut")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1), strict=True):
                codes, _ = word_codes([text.as_py().encode()])
                rows = places.values.flatten()
                start, size = rows[0].to_numpy(), rows[1].to_numpy()
                words = [
                    codes[a : a + m + window - 1].tobytes() for a, m in zip(start, size, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [rows[2], rows[3], rows[4], pa.array(words, pa.binary())],
                    ["anchor", "words", "n", "codes"],
                )

    dealt = (
        one.join(wanted, "text_id")
        .select("text", "cut")
        .mapInArrow(cut, "anchor long, words long, n long, codes binary")
        .withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    )

    def search(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["codes"]]
        which, first, last = repeats(lists, table["n"].to_numpy(), window)
        rows = table.select(["anchor", "words"]).take(pa.array(which))
        return rows.append_column("first", pa.array(first, pa.int32())).append_column(
            "last", pa.array(last, pa.int32())
        )

    return dealt.groupBy("shard").applyInArrow(search, "anchor long, words long, first int, last int")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


RESULTS = ["kept_text", "n_words", "n_removed", "removed"]


def remove_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """All documents, with ``kept_text``, ``n_words``, ``n_removed`` and ``removed``.

    Every word covered by a window of ``window`` words that starts anywhere else too, in
    the same document or another, is cut out, wherever it stands; the words left are
    joined by one space. Words are runs of characters other than ASCII white space.
    ``removed`` lists the word spans cut (begin, end exclusive). A NULL text counts as
    empty; a text of fewer words than a window loses none. Repeated rows are repeats of
    each other. Columns of the results' names are replaced, all others kept.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    text_id, spans = fresh("text_id"), fresh("spans")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.withColumn(text_id, F.unhex(F.sha2(text.cast("binary"), 256)))
    texts = keyed.select(F.col(text_id).alias("text_id"), text.alias("text"))
    found = stored(repeated_spans(texts, window), "spans").select(
        F.col("text_id").alias(text_id), F.col("spans").alias(spans)
    )
    # Texts that surely lose nothing need not be shuffled to learn so.
    touched = _touched(keyed, text_id, membership_bits(found.select(text_id), text_id))
    mark = touched.columns[-1]
    joined = touched.where(F.col(mark)).drop(mark).join(found, text_id, "left")
    alone = touched.where(~F.col(mark)).drop(mark)
    alone = alone.withColumn(spans, F.lit(None).cast(found.schema[spans].dataType))
    at = keyed.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in RESULTS]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_cut(*row) for row in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True)]
            columns = list(zip(*made, strict=True)) or [[]] * 4
            results = [
                pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), _SPANS), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), *results], [*(names[i] for i in kept), *RESULTS]
            )

    names = docs.columns
    schema = T.StructType(
        [
            *(docs.schema[i] for i in kept),
            T.StructField("kept_text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("removed", T.ArrayType(_SPAN_TYPE)),
        ]
    )
    in_order = [*docs.columns, text_id, spans]
    return joined.select(in_order).union(alone.select(in_order)).mapInArrow(cut, schema)


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
_SPAN_TYPE = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _cut(text: pa.StringScalar, spans: pa.ListScalar) -> tuple[str, int, int, list[dict]]:
    words = (text.as_py() or "").encode().split()
    merged = _merged([(s["begin"], s["end"]) for s in spans.as_py() or []])
    kept, done = [], 0
    for begin, end in merged:
        kept += words[done:begin]
        done = end
    kept += words[done:]
    return (
        b" ".join(kept).decode(), len(words), len(words) - len(kept),
        [{"begin": a, "end": b} for a, b in merged],
    )


def _touched(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """All rows, with a last column that is false where the key is surely not in the set."""
    mark, word = fresh("touched"), fresh("word")
    placed = rows.withColumn(word, F.pmod(F.xxhash64(key), F.lit(MEMBERSHIP_WORDS)).cast("int"))
    joined = placed.join(F.broadcast(bits.withColumnRenamed("_word", word)), word, "left")
    hit: Column = F.coalesce(F.col("_bits").bitwiseAND(_bit(key)) != 0, F.lit(False))
    return joined.select(*rows.columns, hit.alias(mark))


SQL = """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS rid,
    list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '),
      lambda w: w <> '') AS w
  FROM documents
), windows AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), again AS (
  SELECT g FROM windows GROUP BY g HAVING count(*) > 1
), hit AS (
  SELECT rid, list(DISTINCT p) AS gone
  FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM windows WHERE g IN (SELECT g FROM again))
  GROUP BY rid
), flat AS (
  SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words
), gone AS (
  SELECT rid, unnest(gone) AS p FROM hit
), kept AS (
  SELECT f.rid, string_agg(f.x, ' ' ORDER BY f.p) AS t, count(*) AS n
  FROM flat f LEFT JOIN gone g ON g.rid = f.rid AND g.p = f.p WHERE g.p IS NULL GROUP BY f.rid
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.rid = w.rid
"""
