"""Quality scores learned from preferences between documents (Bradley-Terry).

A pair of a good and a bad document says that the first is preferred. The chance of
that is modelled as the logistic function of the difference of their scores, a score
being linear in features of the text; the mean loss over all pairs of labelled
documents is minimised. What is kept is then decided by a quantile of their scores:
the share of bad documents among them.

The pairs are not listed. What a document loses against all of the other label follows
from its own score and a histogram of theirs, so that a step takes two passes over the
stored features; to the driver come sums, whose size does not follow the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.common import slices, stored, with_results

FEW_ROWS = 131_072  # so many labelled documents, 21 MB, are gone through on the driver
SLICE_ROWS = 4_096
PASS_TASKS = 64
KNOTS = 5
THRESHOLD = 0.3
RIDGE = 1e-3
STEPS = 20
# Scores are told apart by bins of 1/64 up to 32 on either side, beyond which all are at the end.
REACH, BINS, WIDE_BINS = 32.0, 4_096, 256

FEATURES = (
    "letters digits upper space punctuation symbols pipes mark_runs wide_runs word_length "
    "long_words short_words distinct_words repeats same_lines short_lines log_length "
    "stops bigrams"
).split()

# One class per character code; codes beyond the table are letters unless low.
_LETTER, _UPPER, _DIGIT, _SPACE, _PUNCT, _SYMBOL, _PIPE = range(1, 8)


def _classes() -> np.ndarray:
    table = np.zeros(0x3000, dtype=np.uint8)
    for code in range(len(table)):
        c = chr(code)
        if c.isupper():
            table[code] = _UPPER
        elif c.isalpha():
            table[code] = _LETTER
        elif c.isdigit():
            table[code] = _DIGIT
        elif c.isspace():
            table[code] = _SPACE
        elif c in "|<>{}[]\\\\":
            table[code] = _PIPE
        elif c in ".,;:!?'\"()-":
            table[code] = _PUNCT
        else:
            table[code] = _SYMBOL
    return table


_TABLE = _classes()


def text_features(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text, all finite; an empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    sizes = np.array([len(t) for t in texts])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], _LETTER)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
    n = sizes[full].astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, begin, dtype=np.int64) / n

    upper, space = share(kind == _UPPER), share(kind == _SPACE)
    letters = share((kind == _LETTER) | (kind == _UPPER))
    out[full, 0], out[full, 1], out[full, 2] = letters, share(kind == _DIGIT), upper
    out[full, 3], out[full, 4] = space, share(kind == _PUNCT)
    out[full, 5], out[full, 6] = share(kind == _SYMBOL), share(kind == _PIPE)
    mark = kind >= _PUNCT
    twice = np.zeros(len(kind), dtype=bool)
    twice[1:] = mark[1:] & mark[:-1]
    out[full, 7] = share(twice)
    same = np.zeros(len(kind), dtype=bool)
    same[1:] = codes[1:] == codes[:-1]
    out[full, 8] = share(same)
    for i in full.tolist():
        words = texts[i].split()
        k = len(words)
        lines = texts[i].split("\n")
        out[i, 16] = np.log1p(sizes[i])
        if not k:
            continue
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=k)
        kinds = set(words)
        out[i, 9] = min(lengths.mean(), 40.0)
        out[i, 10] = (lengths > 14).mean()
        out[i, 11] = (lengths < 3).mean()
        out[i, 12] = len(kinds) / k
        out[i, 13] = sum(map(str.__eq__, words, words[1:])) / k
        out[i, 14] = 1 - len(set(lines)) / len(lines)
        out[i, 15] = sum(len(x) < 30 for x in lines) / len(lines)
        out[i, 17] = sum(w.islower() for w in words) / k
        out[i, 18] = len(set(zip(words, words[1:], strict=False))) / k
    return out


@dataclass(frozen=True)
class QualityModel:
    """Piecewise linear score: ``knots`` per feature, one weight for each piece."""

    knots: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def parts(self, features: np.ndarray) -> np.ndarray:
        bent = np.maximum(features[:, :, None] - self.knots.T[None], 0.0)
        width = features.shape[1] * (1 + len(self.knots))
        return np.concatenate([features[:, :, None], bent], axis=2).reshape(len(features), width)

    def basis(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.parts(features) / self.scale, -10, 10)

    def raw(self, features: np.ndarray) -> np.ndarray:
        return self.basis(features) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; ``THRESHOLD`` lies at the learned quantile."""
        x = (self.raw(features) - self.cut) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Labelled:
    """Features of all labelled documents, the label last: stored rows, or an array if they are few."""

    rows: DataFrame
    few: np.ndarray | None = None

    def total(self, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of what ``part`` makes of the features and labels of some rows."""
        if self.few is not None:
            runs = range(0, max(len(self.few), 1), SLICE_ROWS)
            return sum(part(x[:, :-1], x[:, -1]) for x in (self.few[at : at + SLICE_ROWS] for at in runs))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = None
            for batch in batches:
                x = _matrix(batch)
                for at in range(0, len(x), SLICE_ROWS):
                    one = part(x[at : at + SLICE_ROWS, :-1], x[at : at + SLICE_ROWS, -1])
                    made = one if made is None else made + one
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], names=["sums"])

        found = self.rows.coalesce(PASS_TASKS).mapInArrow(sums, "sums binary").collect()
        return sum(np.frombuffer(bytes(r["sums"])) for r in found)


def labelled(rows: DataFrame) -> Labelled:
    """``rows`` stored; also gathered if there are at most ``FEW_ROWS``."""
    rows = stored(rows, "labelled")
    if rows.count() > FEW_ROWS:
        return Labelled(rows)
    few = _matrix(rows.toArrow())
    return Labelled(rows, few[np.lexsort(few.T)])


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in table.columns])


_SIGN = np.uint64(1 << 63)


def quantiles(
    rows: Labelled, columns: Callable[[np.ndarray], np.ndarray], at: np.ndarray, count: int, digit: int
) -> np.ndarray:
    """Quantiles of every column that ``columns`` makes of the features, as ``np.quantile`` has them.

    Exact: the bits of the values next to each are found ``digit`` at a time, by counting.
    """
    place = np.asarray(at, dtype=float) * (count - 1)
    low = np.floor(place).astype(np.int64)
    rank = np.concatenate([low, np.minimum(low + 1, count - 1)])
    wide = len(columns(np.zeros((1, len(FEATURES))))[0])
    rank = np.tile(rank, (wide, 1)).astype(float)
    known = np.zeros(rank.shape, dtype=np.uint64)
    mask = np.uint64((1 << digit) - 1)
    for shift in range(64 - digit, -1, -digit):

        def counts(features: np.ndarray, _: np.ndarray, shift: int = shift, known: np.ndarray = known) -> np.ndarray:
            out = np.zeros((*known.shape, 1 << digit))
            for c, column in enumerate(columns(features).T):
                bits = np.ascontiguousarray(column + 0.0).view(np.uint64)
                keys = np.sort(np.where(bits & _SIGN, ~bits, bits | _SIGN))
                begun = keys >> np.uint64(shift + digit) if shift + digit < 64 else np.zeros_like(keys)
                for r, prefix in enumerate(known[c]):
                    own = keys[np.searchsorted(begun, prefix) : np.searchsorted(begun, prefix, "right")]
                    digits = ((own >> np.uint64(shift)) & mask).astype(np.int64)
                    out[c, r] = np.bincount(digits, minlength=1 << digit)
            return out.ravel()

        upto = rows.total(counts).reshape(*known.shape, -1).cumsum(axis=2)
        found = (upto <= rank[..., None]).sum(axis=2)
        before = np.take_along_axis(upto, np.maximum(found - 1, 0)[..., None], axis=2)[..., 0]
        rank = rank - np.where(found > 0, before, 0)
        known = (known << np.uint64(digit)) | found.astype(np.uint64)
    values = np.where(known & _SIGN, known ^ _SIGN, ~known).view(np.float64)
    below, above = values[:, : len(low)], values[:, len(low) :]
    return below + (above - below) * (place - low)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


_EDGES = np.linspace(-REACH, REACH, BINS + 1)


def _bin(scores: np.ndarray, bins: int) -> np.ndarray:
    return np.clip((scores + REACH) * (bins / (2 * REACH)), 0, bins - 1).astype(np.int64)


def _against(scores: np.ndarray, weight: np.ndarray, sign: int) -> np.ndarray:
    """At each edge the mean of the logistic function of ``sign`` times (scores - edge), and of its slope."""
    out = np.zeros((2, len(_EDGES)))
    for at in range(0, len(_EDGES), 256):
        p = _sigmoid(sign * (scores - _EDGES[at : at + 256, None]))
        out[:, at : at + 256] = p @ weight, (p * (1 - p)) @ weight
    return out


def _preferences(rows: Labelled, model: QualityModel, zero: np.ndarray, of_label: np.ndarray) -> np.ndarray:
    """Weights of the basis by Newton's method on the mean loss over all pairs; ``zero`` has score 0."""
    size = len(zero)
    weights, step, least = np.zeros(size), np.zeros(size), np.inf
    for _ in range(STEPS):

        def histogram(features: np.ndarray, labels: np.ndarray, weights: np.ndarray = weights) -> np.ndarray:
            scores = (model.basis(features) - zero) @ weights
            code = _bin(scores, BINS) + labels.astype(np.int64) * BINS
            return np.concatenate([np.bincount(code, w, 2 * BINS) for w in (None, scores)]).astype(float)

        times, sums = rows.total(histogram).reshape(2, 2, BINS)
        (bad, m), (good, n) = (
            (sums[y][times[y] > 0] / times[y][times[y] > 0], times[y][times[y] > 0] / of_label[y]) for y in (0, 1)
        )
        loss = RIDGE * weights @ weights / 2 + sum(
            n[at : at + 256] @ np.logaddexp(0, bad - good[at : at + 256, None]) @ m for at in range(0, len(good), 256)
        )
        if loss > least + 1e-12:  # too far
            step = step / 2
            weights = weights + step
            if np.abs(step).max() < 1e-9:
                break
            continue
        if np.abs(step).max() < 1e-7 and np.isfinite(least):
            break
        least = loss
        # Of a bad document against the good ones, and the other way round.
        tables = np.stack([_against(good, n, -1), _against(bad, m, 1)])

        def slopes(
            features: np.ndarray, labels: np.ndarray, weights: np.ndarray = weights, tables: np.ndarray = tables
        ) -> np.ndarray:
            x = model.basis(features) - zero
            scores, y = x @ weights, labels.astype(np.int64)
            p, curve = (np.where(y == 1, *(np.interp(scores, _EDGES, tables[k][i]) for k in (1, 0))) for i in (0, 1))
            share = 1 / of_label[y]
            code = _bin(scores, WIDE_BINS) + y * WIDE_BINS
            order = np.argsort(code, kind="stable")
            used, first = np.unique(code[order], return_index=True)
            binned = np.zeros((2 * WIDE_BINS, size + 2))
            if len(used):
                each = np.column_stack([x, scores, np.ones(len(x))]) * share[:, None]
                binned[used] = np.add.reduceat(each[order], first, axis=0)
            down = x.T @ (np.where(y == 1, -p, p) * share)
            return np.concatenate([down, ((x * (curve * share)[:, None]).T @ x).ravel(), binned.ravel()])

        made = rows.total(slopes)
        down, curve, binned = np.split(made, [size, size + size * size])
        of_bad, of_good = binned.reshape(2, WIDE_BINS, size + 2)
        at_bad, at_good = (b[:, -2] / np.where(b[:, -1] > 0, b[:, -1], 1) for b in (of_bad, of_good))
        p = _sigmoid(at_good[:, None] - at_bad)
        cross = of_good[:, :size].T @ (p * (1 - p)) @ of_bad[:, :size]
        curve = curve.reshape(size, size) - cross - cross.T + RIDGE * np.eye(size)
        step = np.linalg.solve(curve, down + RIDGE * weights)
        weights = weights - step
    return weights


def fit(rows: Labelled) -> QualityModel | None:
    """The model of all labelled documents; None without both labels."""
    of_label = rows.total(lambda x, y: np.array([np.sum(y == 0), np.sum(y == 1)], dtype=float))
    count = int(of_label.sum())
    if not of_label.all():
        return None
    knots = quantiles(rows, lambda x: x, np.linspace(0.02, 0.98, KNOTS), count, 8).T
    model = QualityModel(knots, np.ones(1), np.zeros(1), 0.0, 1.0)
    middle = knots[[KNOTS // 2]]

    def moments(features: np.ndarray, _: np.ndarray) -> np.ndarray:
        apart = model.parts(features) - model.parts(middle)
        return np.concatenate([apart.sum(axis=0), (apart * apart).sum(axis=0)])

    mean, square = rows.total(moments).reshape(2, -1) / count
    scale = np.sqrt(np.maximum(square - mean * mean, 0.0))
    scaled = replace(model, scale=np.where(scale > 1e-9, scale, 1.0))
    weighted = replace(scaled, weights=_preferences(rows, scaled, scaled.basis(middle)[0], of_label))
    share = of_label[0] / count
    cut = float(quantiles(rows, lambda x: weighted.raw(x)[:, None], np.array([share]), count, 16)[0, 0])

    def spreads(features: np.ndarray, _: np.ndarray) -> np.ndarray:
        apart = weighted.raw(features) - cut
        return np.array([apart.sum(), (apart * apart).sum()])

    mean, square = rows.total(spreads) / count
    spread = max(float(np.sqrt(max(square - mean * mean, 0.0))), 1e-6) / 2
    return replace(weighted, cut=cut, spread=spread)


_FIELDS = "struct<{}>".format(",".join(f"f{i}:double" for i in range(len(FEATURES))))


def labelled_features(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Features (f0 ...) and 0/1 label of every labelled document.

    They are made where the texts are, which are not shuffled.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")
    )

    @F.pandas_udf(_FIELDS)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [np.zeros((0, len(FEATURES))), *(text_features(run) for run in slices(batch))]
            yield pd.DataFrame(np.concatenate(made), columns=[f"f{i}" for i in range(len(FEATURES))])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    made = texts.select("_id", features("text").alias("f"))
    return made.join(marked, "_id").select("f.*", "label")


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel | None:
    """Learn from all labelled documents; see ``fit``.

    Labels other than 0 and 1 and NULL ids are passed over; an id with several labels
    or texts counts with each.
    """
    return fit(labelled(labelled_features(docs, labels, label, id_col, text_col)))


def score_documents(
    docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Add ``score`` (0 to 1, higher is better) and ``predicted`` (1: keep).

    Rows and repeated rows stay as they are. NULL counts as an empty text. Without a
    model (no labels of either kind) every score is 0.5. Columns named ``score`` or
    ``predicted`` are replaced. An empty table gives an empty result.
    """
    if model is None:
        score: Column = F.lit(0.5)
    else:

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                made = [model.score(text_features(run)) for run in slices(batch)]
                yield pd.Series(np.concatenate([np.zeros(0), *made]))

        score = scored(F.col(f"`{text_col}`"))
    with_score = with_results(docs, F.struct(score.alias("score")), ["score"])
    kept = [F.col(f"`{c}`") for c in with_score.columns if c.lower() != "predicted"]
    return with_score.select(*kept, (F.col("score") >= threshold).cast("int").alias("predicted"))
