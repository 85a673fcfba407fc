"""Best-fit packing of tokenised documents with a dominance reduction before it.

Documents become token sequences, longer ones are cut into pieces of the capacity.
How many pieces there are of each length is all that decides a packing, and that
histogram has at most ``capacity`` entries whatever the input's size. The plan is
made on it: sets of lengths that provably dominate every alternative are fixed for
good (in bulk, as often as the histogram allows), the rest goes by best-fit
decreasing. The plan says for each length which run of its pieces goes where; pieces
are numbered within their length by counts per bucket, so no task ever holds all
pieces of a length.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zoneflow.llm.common import slices, stored

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BUCKET_ROWS = 100_000
RUN_CHARS = 1 << 19


# How the tokenizer splits lower-case Latin-1 text into words.
_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]"
    "|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾ \\t\\n\\r\\x0b\\x0c\\x85\\xa0]+"
)
_WIDE = re.compile("[^\x00-\xff]")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the UTF-8 bytes of each Latin-1 character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class KnownIds(dict):
    """Ids, as little-endian bytes, of UTF-8 stretches without white space; new ones are made."""

    def __init__(self, tokenize: Callable) -> None:
        self.tokenize, self.letters = tokenize, _byte_letters()

    def __missing__(self, stretch: bytes) -> bytes:
        if stretch.isalpha():  # ASCII letters are one word, and written as they are
            made = [t.id for t in self.tokenize(stretch.decode())]
            ids = struct.pack(f"<{len(made)}I", *made)
        elif stretch[:-1].isalpha() and stretch[-1] < 128:
            ids = self[stretch[:-1]] + self[stretch[-1:]]  # a word and a sign or digit
        else:
            text = stretch.decode()
            words = _WORDS.findall(text)
            if words == [text]:
                made = [t.id for t in self.tokenize(text.translate(self.letters))]
                ids = struct.pack(f"<{len(made)}I", *made)
            else:
                ids = b"".join([self[word.encode()] for word in words])
        self[stretch] = ids
        return ids


class WordEncoder:
    """Token ids of texts as little-endian bytes, with those of known stretches kept.

    Latin-1 texts are cut at white space, and only new stretches are split into words
    here and go to the tokenizer's model. Other texts, texts that may hold special tokens,
    and all texts if the tokenizer turns out to split a probe in another way, go through
    the tokenizer whole. The table is emptied when it has ``capacity`` entries.
    """

    def __init__(self, path: str, capacity: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity = capacity
        self.known = KnownIds(self.tokenizer.model.tokenize)
        marks = "".join(map(chr, range(256)))
        probe = f"{marks} {' '.join(marks)} Don't they'll x's.'d A1²b ÀÉß.x a--b"
        self.splits = self._words([probe]) == [self._whole(probe)]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _words(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.capacity:
            self.known.clear()
        ids = self.known.__getitem__
        # Bytes are split at ASCII white space only, which no word holds.
        return [b"".join(map(ids, text.lower().encode().split())) for text in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [
            self.splits and "<|" not in t and (t.isascii() or not _WIDE.search(t)) for t in texts
        ]
        words = iter(self._words([t for t, ok in zip(texts, plain, strict=True) if ok]))
        return [next(words) if ok else self._whole(t) for t, ok in zip(texts, plain, strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenised_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Every document's ids, followed by ``end_id``, cut into pieces of the capacity.

    A NULL text is empty and has only ``end_id``. ``keep_ids`` adds the ids themselves.
    """
    schema = PIECES + (", ids array<long>" if keep_ids else "")
    last = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            done = 0
            for run in slices(batch["text"], RUN_CHARS):
                keys = batch["doc_id"].iloc[done : done + len(run)]
                done += len(run)
                rows = []
                for key, data in zip(keys, encoder.encode(run), strict=True):
                    data += last
                    for n, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        row = (key, n, at // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, "<u4").tolist()) if keep_ids else row)
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                yield out.astype({"doc_id": "Int64"})

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return keyed.mapInPandas(cut, schema)


@dataclass
class Plan:
    """Where the pieces of each length go.

    A row of ``slots`` is (length, first, sequences, each, base, offset): the pieces
    ``first`` onwards of that length fill ``sequences`` sequences from number
    ``base``, ``each`` of them side by side from ``offset``; the last may get fewer.
    """

    slots: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0


def dominating_set(lengths: list[int], count: dict[int, int], item: int, room: int) -> list[int] | None:
    """Lengths that, with ``item``, dominate every other set that holds ``item``.

    ``lengths``: ascending, those still there besides one ``item``. ``room`` is what
    ``item`` leaves. A set dominates another if the other's items can be split among
    its own so that none gets more than its size; then some best packing has it.
    None: no set of up to three is known to dominate.
    """
    if not lengths or lengths[0] > room:
        return []
    best = lengths[bisect_left(lengths, room + 1) - 1]
    if best == room:
        return [best]
    smallest: list[int] = []
    for x in lengths[:3]:
        smallest += [x] * min(3 - len(smallest), count[x])
    two, three = sum(smallest[:2]), sum(smallest[:3])
    if len(smallest) < 2 or two > room:
        return [best]
    if len(smallest) > 2 and three <= room:
        return None
    # At most two more fit: look at all pairs that do.
    pair_sum, least = 0, 0
    high = len(lengths) - 1
    for low, a in enumerate(lengths):
        while high >= 0 and a + lengths[high] > room:
            high -= 1
        if high < low:
            break
        b = lengths[high]
        if high == low and count[a] < 2:
            if low == 0 or lengths[low - 1] + a > room:
                continue
            b = lengths[low - 1]
        pair_sum, least = max(pair_sum, a + b), max(least, min(a, b))
    if best >= pair_sum:
        return [best]
    at = bisect_left(lengths, room - best + 1) - 1
    if at >= 0 and lengths[at] >= least and (lengths[at] != best or count[best] > 1):
        return [best, lengths[at]]
    return None


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Dominance reduction, then best-fit decreasing, on counts of lengths."""
    plan = Plan()
    count = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in count):
        raise ValueError("lengths lie between 1 and the capacity")
    used = dict.fromkeys(count, 0)

    def place(length: int, sequences: int, each: int, pieces: int, base: int, offset: int) -> None:
        plan.slots.append((length, used[length], sequences, each, base, offset))
        used[length] += pieces

    for item in sorted(count, reverse=True):
        while count.get(item):
            count[item] -= 1
            lengths = sorted(n for n, c in count.items() if c)
            chosen = dominating_set(lengths, count, item, capacity - item)
            count[item] += 1
            if chosen is None:
                break
            members = [item, *chosen]
            need = {n: members.count(n) for n in members}
            times = min(count[n] // k for n, k in need.items())
            offset = 0
            for n in members:
                place(n, times, 1, times, plan.sequences, offset)
                offset += n
                count[n] -= times
            plan.sequences += times
            plan.fixed += times
    # Best-fit decreasing; sequences that look alike are one entry (room, number, first).
    open_: list[tuple[int, int, int]] = []
    for item in sorted((n for n, c in count.items() if c), reverse=True):
        left = count[item]
        while left:
            at = bisect_left(open_, (item, 0, 0))
            if at == len(open_):
                fit = capacity // item
                number = -(-left // fit)
                insort(open_, (capacity, number, plan.sequences))
                plan.sequences += number
                continue
            room, number, first = open_.pop(at)
            fit = room // item
            full = min(number, left // fit)
            if full:
                place(item, full, fit, full * fit, first, capacity - room)
                left -= full * fit
                insort(open_, (room - fit * item, full, first))
            if full < number and left:  # fewer than fit: they share one sequence
                place(item, 1, left, left, first + full, capacity - room)
                insort(open_, (room - left * item, 1, first + full))
                full, left = full + 1, 0
            if full < number:
                insort(open_, (room, number - full, first + full))
    return plan


def numbered(pieces: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``rank``: each piece's number, from 0, among those of its length.

    Pieces of a length are spread over buckets by a hash; a bucket's ranks start
    after the counts of the buckets before it. Equal rows are interchangeable.
    """
    total = pieces.count()
    buckets = max(16, -(-total // bucket_rows))
    spread = pieces.withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    )
    by_bucket = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")
    )
    order = ("doc_id", "piece", "start", "ids_crc32")
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = spread.withColumn("inside", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["length", "bucket"]).select(
        *pieces.columns, (F.col("inside") + F.col("skip")).alias("rank")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length``.

    ``pieces`` must give the same rows whenever it is read: see ``common.stored``.
    No pieces give no rows.
    """
    spark = pieces.sparkSession
    histogram = {
        r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    }
    plan = make_plan(histogram, capacity)
    # At most a few rows per length up to the capacity, however many pieces there are.
    slots = spark.createDataFrame(
        [(n, a, a + seqs * each, each, base, off) for n, a, seqs, each, base, off in plan.slots],
        "length long, _first long, _end long, _each long, _base long, _offset long",
    )
    place = F.col("rank") - F.col("_first")
    return (
        numbered(pieces)
        .join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_end")))
        .select(
            *pieces.columns,
            (F.col("_base") + F.floor(place / F.col("_each"))).cast("long").alias("sequence_id"),
            (F.col("_offset") + place % F.col("_each") * F.col("length")).alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and place there.

    NULL and empty texts are one piece of one id. Repeated rows are packed each. An
    empty table gives an empty result. Columns other than id and text are not used.
    """
    pieces = stored(tokenised_pieces(docs, tokenizer_path, capacity, **options), "pieces")
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed id sequences themselves, from pieces that kept their ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")
    )
