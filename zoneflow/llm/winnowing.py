"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points has a rolling hash; of each ``WINDOW`` neighbouring
ones the smallest is kept, the rightmost if several are, with its position. Two texts
that share a passage of ``GRAM + WINDOW - 1`` code points or more share a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.common import slices
from zoneflow.llm.shingles import mix

GRAM = 20
WINDOW = 45
BLOCK_ROWS = 5_000
BLOCKS = 1 << 17
SAMPLED = 32
RUN_CHARS = 1 << 19
STRETCH = 1 << 23

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = 24  # low bits of a key: the position, so that the rightmost of equals is least


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def fingerprints(
    texts: list[str], gram: int = GRAM, window: int = WINDOW, stretch: int = STRETCH
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and positions, ascending by position, of each text's fingerprint.

    A text shorter than ``gram`` is one gram of its own; an empty one has none. Texts
    of more than ``stretch`` windows are read in stretches that overlap by a window.
    """
    longest = stretch + window + gram - 2
    if len(texts) > 1 and sum(map(len, texts)) > longest:
        return [found for text in texts for found in fingerprints([text], gram, window, stretch)]
    if texts and len(texts[0]) > longest:
        return [_in_stretches(texts[0], gram, window, stretch)]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    # Each text is followed by a gap that no window can look across.
    begin = np.concatenate([[0], np.cumsum(sizes + window + gram)])[:-1]
    gap = "\0" * (window + gram)
    data = "".join(t + gap for t in texts).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(data, dtype="<u4").astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _powers(_BASE, len(codes)), out=total[1:])
    back = _powers(_UNBASE, len(codes))
    at = np.arange(len(codes) - gram + 1)
    hashes = mix((total[gram:] - total[:-gram]) * back[: len(at)])
    low = np.uint64((1 << _PLACE) - 1)
    keys = (hashes & ~low) | (low - (at.astype(np.uint64) & low))
    grams = np.maximum(sizes - gram + 1, 0)
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + grams, -1)
    keys[np.cumsum(edge)[: len(keys)] == 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least, span = keys, 1
    while span < window:  # minima of windows twice as wide each time
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    out = []
    for start, size, count in zip(begin.tolist(), sizes.tolist(), grams.tolist(), strict=True):
        if not size:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
        elif not count:
            end = total[start + size : start + size + 1]  # arrays of one wrap in silence
            whole = (end - total[start : start + 1]) * back[start : start + 1] + np.uint64(size)
            out.append((mix(whole) >> np.uint64(_PLACE), np.zeros(1, np.int64)))
        else:
            chosen = least[start : start + max(1, count - window + 1)]
            new = np.ones(len(chosen), dtype=bool)
            new[1:] = chosen[1:] != chosen[:-1]
            first, chosen = np.flatnonzero(new) + start, chosen[new]
            ahead = (low - (chosen & low) - (first.astype(np.uint64) & low)) & low
            out.append((chosen >> np.uint64(_PLACE), first + ahead.astype(np.int64) - start))
    return out


def _in_stretches(text: str, gram: int, window: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, places = [], []
    for at in range(0, len(text) - window - gram + 2, stretch):
        ((found, where),) = fingerprints([text[at : at + stretch + window + gram - 2]], gram, window, stretch)
        hashes.append(found)
        places.append(where + at)
    position, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], position


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hashes; two empty ones are alike."""
    x, y = np.unique(a), np.unique(b)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def add_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``fingerprint``: an array of (hash, position), ascending by position.

    A NULL text counts as empty and has an empty fingerprint. Rows stay as they are;
    a column of that name is replaced.
    """

    @F.pandas_udf("array<struct<hash:long,position:int>>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = [
                [{"hash": int(h), "position": int(p)} for h, p in zip(*found, strict=True)]
                for run in slices(batch, RUN_CHARS)
                for found in fingerprints(run)
            ]
            yield pd.Series(rows, dtype=object)

    return docs.withColumn("fingerprint", made(F.col(f"`{text_col}`")))


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """One short name for a fingerprint: equal for equal hashes at equal places."""
    data = hashes.astype("<u8").tobytes() + positions.astype("<i8").tobytes()
    return hashlib.md5(data).hexdigest()


# -- each document and the one after it


def _blocked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``block``, ``_id``, ``_hash``, ``id``, ``text``: blocks ascend with (_id, _hash).

    Bounds are quantiles of about ``SAMPLED`` ids a block, drawn by a fixed seed, at
    most ``BLOCKS``: they say which task does what, not what comes out. An id that is
    several bounds (NULL is one) has so many rows that they are dealt further, by hash.
    """
    keyed = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("_hash", F.xxhash64("text"))
    rows = keyed.count()
    count = min(BLOCKS, rows // BLOCK_ROWS)
    shares = [(k + 1) / (count + 1) for k in range(count)]
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"))
    drawn = ids.sample(min(1.0, SAMPLED * (count + 1) / max(rows, 1)), seed=17)
    found = drawn.approxQuantile("_id", shares, 1 / (4 * count + 4)) if shares else []
    bounds = np.array(found, dtype=np.float64)

    @F.pandas_udf("int")
    def block(key: pd.Series, code: pd.Series) -> pd.Series:
        value = key.to_numpy().astype(np.float64)
        left, right = np.searchsorted(bounds, value, "left"), np.searchsorted(bounds, value, "right")
        share = code.to_numpy().astype(np.float64) / 2.0**64 + 0.5
        more = np.maximum(right - left - 1, 0)
        return pd.Series((left + np.minimum((share * (more + 1)).astype(np.int64), more)).astype(np.int32))

    return keyed.select(block("_id", "_hash").alias("block"), "_id", "_hash", "id", "text")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in blocks, each block's by descending id and followed by the next row.

    Columns: ``id``, ``text``, ``follows`` (that next row is not the block's own). Read
    it by partition, as ``walk`` does. Equal ids are ordered by their texts' hashes.
    """
    blocked = _blocked(docs, id_col, text_col)
    # One row per block, as many as there are bounds at most.
    heads = (
        blocked.groupBy("block").agg(F.max(F.struct("_id", "_hash")).alias("head")).select("block", "head.*").collect()
    )
    rows = sorted(tuple(r) for r in heads)
    sent = [(i, h, rows[(n + 1) % len(rows)][0]) for n, (_, i, h) in enumerate(rows)]
    firsts = docs.sparkSession.createDataFrame(sent, "_id long, _hash long, to int")
    tails = (
        blocked.join(F.broadcast(firsts), ["_id", "_hash"])
        .groupBy("to")
        .agg(F.max("text").alias("text"))
        .select(F.col("to").alias("block"), *[F.lit(None).cast("long").alias(c) for c in ("_id", "_hash", "id")], "text")
    )
    both = blocked.withColumn("follows", F.lit(False)).unionByName(tails.withColumn("follows", F.lit(True)))
    order: list[Column] = [F.col("block"), F.col("follows"), *[F.desc(c) for c in ("_id", "_hash", "text")]]
    return both.repartition("block").sortWithinPartitions(*order).select("block", "id", "text", "follows")


def walk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str], list[str]]]:
    """Ids, texts and next texts, a bounded number of characters at a time."""
    ids: list = []
    texts: list[str] = []
    after: list[str] = []
    size = 0
    last = None
    for batch in batches:
        for key, text, follows in zip(batch["id"], batch["text"], batch["follows"], strict=True):
            if last is not None:
                ids.append(last[0])
                texts.append(last[1])
                after.append(text)
                size += len(last[1])
            last = None if follows else (key, text)
            if size >= RUN_CHARS:
                yield ids, texts, after
                ids, texts, after, size = [], [], [], 0
    if ids:
        yield ids, texts, after


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text, and compare them and the next one.

    In the edited text the last half of the code points, rounded down, is replaced by
    as many first ones of the next document (all, if it has fewer), by descending id;
    the first comes after the last. A NULL text is empty, a NULL id comes last,
    repeated rows are rows of their own. One document alone is its own next.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts, after in walk(batches):
            edited = [
                t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)
            ]
            # A text's next is the text after it, but for the last of the run.
            own = fingerprints([*texts, after[-1]])
            of_edited = fingerprints(edited)
            rows = [
                (
                    len(text),
                    hashlib.sha256(new.encode()).hexdigest(),
                    digest(*mine),
                    digest(*changed),
                    likeness(mine[0], changed[0]),
                    likeness(mine[0], following[0]),
                )
                for text, new, mine, changed, following in zip(
                    texts, edited, own, of_edited, _next_of(texts, after, own), strict=False
                )
            ]
            names = [c.split()[0] for c in EDITED.split(", ")][1:]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
            yield out

    keyed = with_next(docs, id_col, text_col)
    return keyed.mapInPandas(compare, EDITED)


def _next_of(texts: list[str], after: list[str], own: list) -> Iterator:
    """Fingerprints of the next texts, made anew only where a block ends."""
    for i, text in enumerate(after):
        if i + 1 == len(after) or texts[i + 1] == text:
            yield own[i + 1]
        else:
            yield fingerprints([text])[0]
