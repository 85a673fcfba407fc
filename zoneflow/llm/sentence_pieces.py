"""Unigram encoding and decoding with a SentencePiece vocabulary.

The best segmentation is the one with the largest sum of the pieces' log scores,
found by Viterbi over a double-array trie of the pieces. Spaces become markers;
characters that no piece has become byte pieces. No piece has a marker behind another
character, so texts fall apart into words there, and all new words of a batch are
segmented side by side, one array step per pair of positions.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.common import slices

MARK = "▁"
PENALTY = 10.0
RUN_CHARS = 1 << 17
LONG_WORD = 64


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: normal pieces with their scores and ids, and the 256 byte ids."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    ids: tuple[int, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    leading_space: bool = True

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        """Read from a model file; scores are taken as they stand there."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [
            i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        named = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
        return cls(
            tuple(model.id_to_piece(i) for i in normal),
            tuple(model.get_score(i) for i in normal),
            tuple(normal),
            tuple(named[f"<0x{b:02X}>"] for b in range(256)) if named else (),
            model.unk_id(),
        )


class Trie:
    """A double array: the child of ``s`` by ``c`` is ``base[s] + c`` if ``check`` there is ``s``."""

    def __init__(self, words: tuple[str, ...], values: tuple[int, ...]) -> None:
        letters = sorted(set("".join(words)))
        self.code = {c: n + 1 for n, c in enumerate(letters)}
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for word, value in zip(words, values, strict=True):
            at = 0
            for c in word:
                step = nodes[at].setdefault(self.code[c], len(nodes))
                if step == len(nodes):
                    nodes.append({})
                at = step
            ends[at] = value
        # Places are given breadth first. ``free`` is the first gap; a node whose
        # children are few fits near it, one with many goes where all is empty.
        taken = bytearray(4 * (len(nodes) + len(letters)) + 2)
        taken[0] = 1
        base_of, check_of, value_of = {}, {}, {0: ends.get(0, -1)}
        place = {0: 0}
        free, top = 1, 1
        queue = [0]
        for node in queue:
            children = sorted(nodes[node])
            if not children:
                continue
            while taken[free]:
                free += 1
            low = children[0]
            start = max(1, free - low) if len(children) < 4 else max(1, top - low)
            tries = 0
            base = start
            while any(taken[base + c] for c in children):
                base += 1
                tries += 1
                if tries == 200:
                    base = max(base, top - low, 1)
            if base + children[-1] + 1 >= len(taken) - len(letters):
                taken.extend(bytes(len(taken)))
            at = place[node]
            base_of[at] = base
            for c in children:
                spot = base + c
                taken[spot] = 1
                child = nodes[node][c]
                place[child] = spot
                check_of[spot] = at
                value_of[spot] = ends.get(child, -1)
                queue.append(child)
            top = max(top, base + children[-1] + 1)
        room = max([0, *base_of.values()]) + len(letters) + 2  # a step never leaves the arrays
        self.base = np.zeros(room, dtype=np.int64)
        self.check = np.full(room, -1, dtype=np.int64)
        self.value = np.full(room, -1, dtype=np.int64)
        for array, found in ((self.base, base_of), (self.check, check_of), (self.value, value_of)):
            array[list(found)] = list(found.values())
        self.depth = max(map(len, words), default=0)


class Encoder:
    """Segments texts with one vocabulary; known words are kept, up to ``capacity``."""

    def __init__(self, pieces: Pieces, capacity: int = 250_000) -> None:
        self.pieces = pieces
        self.trie = Trie(pieces.pieces, tuple(range(len(pieces.pieces))))
        self.scores = np.array(pieces.scores, dtype=np.float64)
        self.ids = np.array(pieces.ids, dtype="<u4")
        self.unknown = (float(self.scores.min()) if len(self.scores) else 0.0) - PENALTY
        self.falls_apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces.pieces)
        # A character that no piece has stands alone, so a line end parts words too.
        line = "" if "\n" in self.trie.code else "\n"
        self.word = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+|\n+")
        self.capacity = capacity
        self.known: dict[str, bytes] = {}
        size = 1 + max([0, pieces.unknown, *pieces.ids, *pieces.byte_ids])
        self.spelled = [b""] * size
        # By id: its score, and whether it is a byte. A character that fell apart costs
        # the penalty once, which its first byte bears.
        self.costs, self.fallen = np.zeros(size), np.zeros(size, dtype=bool)
        self.costs[pieces.unknown] = self.unknown
        for i, piece, score in zip(pieces.ids, pieces.pieces, pieces.scores, strict=True):
            self.spelled[i], self.costs[i] = piece.replace(MARK, " ").encode(), score
        for b, i in enumerate(pieces.byte_ids):
            self.spelled[i], self.fallen[i] = bytes([b]), True
            self.costs[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (" " if self.pieces.leading_space else "") + text
        marked = marked.replace(" ", MARK)
        return self.word.findall(marked) if self.falls_apart else [marked]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian bytes."""
        split = [self.words(t) for t in texts]
        if len(self.known) > self.capacity:
            self.known.clear()
        here = dict.fromkeys(itertools.chain.from_iterable(split))
        new = [w for w in here if w not in self.known]
        short = sorted((w for w in new if len(w) <= LONG_WORD), key=len, reverse=True)
        for at in range(0, len(short), 4096):
            self._side_by_side(short[at : at + 4096])
        for word in new:
            if len(word) > LONG_WORD:
                self.known[word] = self._spell(word, self._one_by_one(word))
        for word in here:
            here[word] = self.known[word]
        return [b"".join(map(here.__getitem__, words)) for words in split]

    def score(self, ids: bytes) -> tuple[float, int]:
        """Log score of ids, and how many of them are bytes."""
        at = np.frombuffer(ids, "<u4")
        return float(self.costs[at].sum()), int(self.fallen[at].sum())

    def _side_by_side(self, words: list[str]) -> None:
        """Viterbi over all words at once; they come longest first."""
        code, trie = self.trie.code, self.trie
        sizes = np.array([len(w) for w in words])
        wide = int(sizes[0])
        codes = np.zeros((len(words), wide), dtype=np.int64)
        codes[np.arange(wide) < sizes[:, None]] = [code.get(c, 0) for w in words for c in w]
        best = np.full((len(words), wide + 1), -np.inf)
        best[:, 0] = 0
        size = np.zeros((len(words), wide + 1), dtype=np.int64)
        piece = np.full((len(words), wide + 1), -1, dtype=np.int64)
        for start in range(wide):
            alive = np.arange(int(np.searchsorted(-sizes, -start, "left")))
            alone = np.ones(len(alive), dtype=bool)
            all_here, state = alive, np.zeros(len(alive), dtype=np.int64)
            for k in range(1, min(trie.depth, wide - start) + 1):
                c = codes[alive, start + k - 1]
                step = trie.base[state] + c
                ok = (c > 0) & (trie.check[step] == state)
                alive, state = alive[ok], step[ok]
                if not len(alive):
                    break
                value = trie.value[state]
                rows, value = alive[value >= 0], value[value >= 0]
                if k == 1:
                    alone[rows] = False
                score = best[rows, start] + self.scores[value]
                better = score > best[rows, start + k]
                rows, end = rows[better], start + k
                best[rows, end], size[rows, end], piece[rows, end] = score[better], k, value[better]
            rows = all_here[alone]
            score = best[rows, start] + self.unknown
            better = score > best[rows, start + 1]
            rows = rows[better]
            best[rows, start + 1], size[rows, start + 1], piece[rows, start + 1] = score[better], 1, -1
        self._walk_back(words, sizes, size, piece)

    def _walk_back(self, words: list[str], sizes: np.ndarray, size: np.ndarray, piece: np.ndarray) -> None:
        """Ids of all words' best paths, from their ends to their beginnings."""
        row, at = np.arange(len(words)), sizes.copy()
        rows, starts, found = [], [], []
        while len(row):
            value, at = piece[row, at], at - size[row, at]
            rows.append(row)
            starts.append(at)
            found.append(value)
            row, at = row[at > 0], at[at > 0]
        rows, starts, found = map(np.concatenate, (rows, starts, found))
        order = np.lexsort((starts, rows))
        rows, starts, found = rows[order], starts[order], found[order]
        data = self.ids[np.maximum(found, 0)].tobytes()
        bounds = (4 * np.searchsorted(rows, np.arange(len(words) + 1))).tolist()
        self.known.update(zip(words, (data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), strict=True))
        for n in np.unique(rows[found < 0]).tolist():
            a, b = bounds[n] // 4, bounds[n + 1] // 4
            path = list(zip(found[a:b].tolist(), starts[a:b].tolist(), strict=True))
            self.known[words[n]] = self._spell(words[n], path)

    def _one_by_one(self, word: str) -> list[tuple[int, int]]:
        """Viterbi over one word: (piece, start) of each part."""
        trie, code = self.trie, self.trie.code
        best = [0.0] + [-np.inf] * len(word)
        came: list[tuple[int, int]] = [(-1, 0)] * (len(word) + 1)
        for start in range(len(word)):
            state, alone = 0, True
            for end in range(start + 1, min(len(word), start + trie.depth) + 1):
                c = code.get(word[end - 1], 0)
                step = int(trie.base[state]) + c
                if not c or trie.check[step] != state:
                    break
                state = step
                value = int(trie.value[state])
                if value >= 0:
                    alone = alone and end > start + 1
                    score = best[start] + self.scores[value]
                    if score > best[end]:
                        best[end], came[end] = score, (value, start)
            if alone and best[start] + self.unknown > best[start + 1]:
                best[start + 1], came[start + 1] = best[start] + self.unknown, (-1, start)
        path, at = [], len(word)
        while at:
            path.append(came[at])
            at = came[at][1]
        return path[::-1]

    def _spell(self, word: str, path: list[tuple[int, int]]) -> bytes:
        ids: list[int] = []
        for value, start in path:
            if value >= 0:
                ids.append(int(self.ids[value]))
            elif self.pieces.byte_ids:
                ids += [self.pieces.byte_ids[b] for b in word[start].encode()]
            else:
                ids.append(self.pieces.unknown)
        return np.array(ids, dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text: markers become spaces, byte pieces bytes; the first space goes.

        Ids outside the vocabulary, control and unknown ones have no text.
        """
        at = memoryview(ids).cast("I")
        if at and max(at) >= len(self.spelled):
            at = [i for i in at if i < len(self.spelled)]
        text = b"".join(map(self.spelled.__getitem__, at)).decode("utf-8", "replace")
        return text[1:] if self.pieces.leading_space and text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Pieces.from_model(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` of every text. A NULL or empty text has none; rows stay as they are."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = encoder(model_path)
        for batch in batches:
            rows = [np.frombuffer(x, "<u4").astype(np.int32) for run in slices(batch, RUN_CHARS) for x in made.encode(run)]
            yield pd.Series(rows, dtype=object)

    return docs.withColumn("ids", ids(F.col(f"`{text_col}`")))


def decode_documents(docs: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ids; NULL ids are none, unknown ids are passed over."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = encoder(model_path)
        for batch in batches:
            rows = [np.array([] if x is None else x, dtype="<u4").tobytes() for x in batch]
            yield pd.Series([made.decode(x) for x in rows], dtype=object)

    return docs.withColumn("decoded", decoded(F.col(f"`{ids_col}`")))


SUMMARY = "n_ids long, score double, n_byte_ids long, ids_crc32 long, round_trip boolean"


def encoding_summary(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ids, byte ids, crc32 of the ids, log score, and whether decoding
    gives the text back (a marker in the text itself comes back as a space).

    NULL texts are empty. Repeated rows are rows of their own.
    """

    @F.pandas_udf(SUMMARY)
    def summary(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = encoder(model_path)
        names = [c.split()[0] for c in SUMMARY.split(", ")]
        for batch in batches:
            rows = [
                (len(ids) // 4, *made.score(ids), zlib.crc32(ids), made.decode(ids) == text.replace(MARK, " "))
                for run in slices(batch, RUN_CHARS)
                for text, ids in zip(run, made.encode(run), strict=True)
            ]
            yield pd.DataFrame(rows, columns=names)

    made = docs.select(F.col(id_col).alias("doc_id"), summary(F.col(text_col)).alias("s"))
    return made.select("doc_id", "s.*")
