"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, letters that look like Latin ones, and digits
or signs that stand for letters. An entry is a whole word or the beginning of one. A
match inside an exception phrase does not count. The weights found are set against
the length of the text, and a logistic curve turns both into a score.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.common import labelled_sample, slices, stored, with_results

SAMPLE_ROWS = 8_000
CANDIDATES = 20_000
ENTRIES = 2_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
KINDS = 3
SURE = 4.0
SURE_PART = 2.5

# Harmless phrases with words that also insult; exceptions of every trained model.
HARMLESS = tuple(
    f" {phrase} "
    for phrase in (
        "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "pond scum", "soap scum",
        "circus clown", "birthday clown", "clown fish", "clown nose", "loser bracket", "losers bracket", "garbage can",
        "garbage truck", "garbage collection", "garbage collector", "dumb bell", "dumb waiter", "dumb terminal",
    )
)

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip("авсеһіјкмнорԛѕтухугԁԝьαβεηικνορτυχγω", "abcehijkmnopqstyxyrdwbabehiknoptuxyw", strict=True)
)
# Digits and signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in [*range(0x80, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code))
        kept = "".join(c for c in plain if not unicodedata.combining(c)).lower()
        table[code] = kept if kept.isalnum() else (None if not kept else " ")
    table |= {ord(a): b for a, b in LOOKALIKES.items()}
    table |= dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])  # invisible
    return table


_FOLD = _folding()
_SIGNS = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
_MIXED = re.compile(r"(?<![^\W_])[^\W_]*[0-9@$!][\w@$!]*")
_LETTERS = str.maketrans(STAND_INS)


def _letters(match: re.Match) -> str:
    token = match.group().rstrip("@$!")
    named = sum(c.isalpha() for c in token)
    return token.translate(_LETTERS) if named >= 2 and 3 * named >= len(token) else match.group()


def fold(text: str) -> str:
    """Lower-case words of plain letters, one or more spaces around each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _MIXED.sub(_letters, text)
    return f" {text.translate(_SIGNS)} "


@dataclass(frozen=True)
class ToxicityModel:
    """``lexicon``: weight by entry; `` word `` is whole, `` wor`` a beginning.

    ``exceptions``: folded phrases, with a space at either end, within which nothing
    counts. ``curve``: intercept and the slopes of log total and log density.
    """

    lexicon: Mapping[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (-4.0, 0.5, 1.5)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The automaton of a model; built once per task."""

    def __init__(self, model: ToxicityModel) -> None:
        import ahocorasick

        self.curve = np.array(model.curve)
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight; of entries that begin together the longest counts."""
        if not self.any:
            return []
        longest: dict[int, tuple[int, float]] = {}
        excepted = []
        for last, (size, weight) in self.automaton.iter(folded):
            start = last + 1 - size
            if weight is None:
                excepted.append((start, last + 1))
            elif start not in longest or longest[start][0] < size:
                longest[start] = (size, weight)
        found = [(start, start + size, weight) for start, (size, weight) in longest.items()]
        if excepted:
            # Whether one phrase spans a match: of those that begin before it, the farthest end.
            excepted.sort()
            begins = [a for a, _ in excepted]
            ends = list(accumulate((b for _, b in excepted), max))
            found = [m for m in found if not (at := bisect_right(begins, m[0])) or ends[at - 1] < m[1]]
        return found

    def measure(self, text: str) -> tuple[float, float, int]:
        """Total weight, weight per hundred words, number of matches.

        The n-th match of one entry adds less than the one before: weight times
        log2(1 + n) in all, so that one word said again and again is not many words.
        """
        folded = fold(text)
        found = self.matches(folded)
        if not found:
            return 0.0, 0.0, 0
        times = Counter((folded[a:b], weight) for a, b, weight in found)
        total = sum(weight * damped(n) for (_, weight), n in times.items())
        return total, float(100 * total / (len(folded.split()) + 20)), len(found)

    def scores(self, texts: list[str]) -> list[tuple[float, int]]:
        out = []
        for text in texts:
            *measures, n = self.measure(text)
            x = self.curve @ (1.0, *np.log1p(measures))
            out.append((float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), n))
        return out


def entries_of(words: Iterable[str]) -> Iterator[str]:
    """The entries each word would match, as often as they match."""
    for word in words:
        yield f" {word} "
        for k in PREFIXES:
            if len(word) > k:
                yield f" {word[:k]}"


def damped(times: int) -> float:
    """What ``times`` matches of one entry in one text count for."""
    return float(np.log2(1 + times))


def part_of(words: list[str]) -> int:
    """0 or 1, by the least hash of five words in a row: near copies seldom part."""
    runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return min(zlib.crc32(run.encode()) for run in runs) // 7 % 2


@dataclass(frozen=True)
class Seen:
    """Texts an entry is in and its damped occurrences, in toxic texts and in clean ones."""

    docs: float
    times: float
    clean_docs: float
    clean_times: float

    def weight(self, sizes: Seen) -> float:
        """Log ratio of the rates; ``sizes`` counts texts and words."""
        return float(np.log((self.times + 0.5) / ((self.clean_times + 0.5) * sizes.times / sizes.clean_times)))

    def sureness(self, sizes: Seen) -> float:
        """By how many deviations it is commoner in toxic texts, by texts and by occurrences."""
        docs = (self.clean_docs + 0.5) * sizes.docs / sizes.clean_docs
        times = (self.clean_times + 0.5) * sizes.times / sizes.clean_times
        return float(min((self.docs - docs) / np.sqrt(docs + 1), (self.times - times) / np.sqrt(times + 1)))


def choose_lexicon(
    counts: Mapping[str, tuple[Seen, Seen]], sizes: tuple[Seen, Seen], least: int = 5
) -> dict[str, float]:
    """Weights of entries far commoner in toxic texts: log ratio of their rates.

    ``counts`` and ``sizes`` are those of two disjoint parts of the sample. An entry has
    to hold in either by itself (``SURE_PART``): chance does that once in 25,000 times,
    so of ``CANDIDATES`` less than one is expected to be there by chance.
    """

    def both(a: Seen, b: Seen) -> Seen:
        return Seen(a.docs + b.docs, a.times + b.times, a.clean_docs + b.clean_docs, a.clean_times + b.clean_times)

    if not all(part.docs and part.clean_docs and part.times and part.clean_times for part in sizes):
        return {}
    whole = both(*sizes)
    chosen = []
    for entry, parts in counts.items():
        seen = both(*parts)
        weight, sure = seen.weight(whole), seen.sureness(whole)
        if seen.docs >= least and weight >= 1.5 and sure >= SURE:
            if min(part.sureness(size) for part, size in zip(parts, sizes, strict=True)) >= SURE_PART:
                chosen.append((sure, entry, weight))
    return {entry: weight for _, entry, weight in sorted(chosen, reverse=True)[:ENTRIES]}


def choose_exceptions(
    toxic: Mapping[str, int], clean: Mapping[str, int], toxic_docs: int, clean_docs: int
) -> tuple[str, ...]:
    """Phrases around a match that are commoner in clean texts taken for toxic than in toxic ones."""
    return tuple(
        sorted(
            p
            for p, n in clean.items()
            if n >= 3 and n * max(toxic_docs, 1) > 2 * toxic.get(p, 0) * max(clean_docs, 1)
        )
    )


def phrases(folded: str, found: list[tuple[int, int, float]]) -> set[str]:
    """Each matched word with the word before it, and with the word after it."""
    words = folded.split()
    starts = {}
    at = 0
    for i, word in enumerate(words):
        at = folded.index(word, at)
        starts[at] = i
        at += len(word)
    out = set()
    for start, _, _ in found:
        i = starts.get(start + 1)
        if i is None:
            continue
        if i:
            out.add(f" {words[i - 1]} {words[i]} ")
        if i + 1 < len(words):
            out.add(f" {words[i]} {words[i + 1]} ")
    return out


def fit_curve(measures: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression of the label on the logarithms of a text's measures."""
    x = np.column_stack([np.ones(len(measures)), np.log1p(measures)])
    keep = np.diag([1e-6] + [ridge] * measures.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - labels @ z + w @ keep @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curvature = (x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curvature, x.T @ (p - labels) + keep @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Lexicon, exceptions and curve from at most ``sample_rows`` labelled documents.

    Counts are made on the executors; to the driver come at most ``CANDIDATES``
    entries, as many phrases around matches, and two numbers per sampled document.
    The beginning of a word is an entry only if it begins at least ``KINDS`` words of
    toxic texts, none of them makes up more than half of it, and a clean word comes to at
    least ``KINDS`` of them; its clean words are exceptions.
    Without a label of either kind the lexicon is empty and every score the same.
    """
    sample = stored(labelled_sample(docs, labels, label, sample_rows, id_col, text_col), "sample")

    def counter(wanted: frozenset[str] | None):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                seen: dict[tuple[int, str], tuple[int, float]] = {}
                for text in batch["text"]:
                    words = fold(text or "").split()
                    part, own = part_of(words), Counter(entries_of(words))
                    own = {e: damped(n) for e, n in own.items() if wanted is None or e in wanted}
                    for entry, n in (own | {"": len(words)}).items():
                        docs, times = seen.get((part, entry), (0, 0.0))
                        seen[part, entry] = docs + 1, times + n
                rows = [(*key, *n) for key, n in seen.items()]
                yield pd.DataFrame(rows, columns=["part", "entry", "docs", "times"])

        return count

    def counted(label: int, wanted: frozenset[str] | None = None) -> DataFrame:
        """Per entry its texts and occurrences in both parts; the empty entry counts texts and words."""
        counts = sample.where(F.col("label") == label).mapInPandas(
            counter(wanted), "part int, entry string, docs long, times double"
        )
        of_part = [
            F.coalesce(F.sum(F.when(F.col("part") == part, F.col(name))), F.lit(0)).alias(f"{name}{part}")
            for part in (0, 1)
            for name in ("docs", "times")
        ]
        return counts.groupBy("entry").agg(*of_part)

    toxic = (
        counted(1).where("docs0 + docs1 >= 5 or entry = ''").orderBy(F.desc(F.col("docs0") + F.col("docs1")), "entry")
        .limit(CANDIDATES + 1).toPandas().set_index("entry")
    )
    clean = counted(0, frozenset(toxic.index)).toPandas().set_index("entry")
    both = toxic.join(clean, rsuffix="_clean", how="outer").fillna(0)
    counts = {
        entry: (Seen(a, b, e, f), Seen(c, d, g, h))
        for entry, a, b, c, d, e, f, g, h in both.itertuples(name=None)
    }
    sizes = counts.pop("", (Seen(0, 0, 0, 0),) * 2)
    lexicon = choose_lexicon(counts, sizes)
    toxic_docs, clean_docs = (sum(getattr(part, name) for part in sizes) for name in ("docs", "clean_docs"))
    lexicon, clean_words = _without_single(sample, lexicon, toxic_docs, clean_docs)
    return _calibrated(sample, lexicon, HARMLESS + clean_words)


def _without_single(
    sample: DataFrame, lexicon: dict[str, float], toxic_docs: float, clean_docs: float
) -> tuple[dict[str, float], tuple[str, ...]]:
    """The entries but for beginnings that stand for one word, and clean words with the others.

    A clean word is in at least ``KINDS`` clean texts and in no smaller share of them
    than of the toxic ones.
    """
    beginnings = frozenset(e for e in lexicon if not e.endswith(" "))
    if not beginnings:
        return lexicon, ()

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[tuple[str, str, int]] = Counter()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for word in set(fold(text or "").split()):
                    for k in PREFIXES:
                        if len(word) > k and f" {word[:k]}" in beginnings:
                            seen[f" {word[:k]}", word, label] += 1
            yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=["entry", "word", "label", "n"])

    toxic, clean = (F.coalesce(F.sum(F.when(F.col("label") == y, F.col("n"))), F.lit(0)) for y in (1, 0))
    counts = (
        sample.mapInPandas(words, "entry string, word string, label int, n long")
        .groupBy("entry", "word")
        .agg(toxic.alias("toxic"), clean.alias("clean"))
    )
    is_clean = (F.col("clean") >= KINDS) & (F.col("clean") * toxic_docs >= F.col("toxic") * clean_docs)
    kinds = counts.groupBy("entry").agg(
        F.count(F.when(F.col("toxic") > 0, 1)).alias("kinds"),
        F.max("toxic").alias("most"),
        F.sum("toxic").alias("all"),
        F.collect_list(F.when(is_clean, F.col("word"))).alias("clean_words"),
    )
    of_many = kinds.where(
        (F.col("kinds") >= KINDS) & (F.col("most") * 2 <= F.col("all")) & (F.size("clean_words") * KINDS <= F.col("kinds"))
    )
    kept = {r["entry"]: r["clean_words"] for r in of_many.select("entry", "clean_words").collect()}
    words_left = sorted({f" {word} " for found in kept.values() for word in found})
    return {e: w for e, w in lexicon.items() if e not in beginnings or e in kept}, tuple(words_left)


def _calibrated(sample: DataFrame, lexicon: dict[str, float], known: tuple[str, ...]) -> ToxicityModel:
    """With a curve and the exceptions that mend clean texts taken for toxic ones."""
    draft = _with_curve(sample, lexicon, known)

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = draft.matcher()
        for batch in batches:
            seen: Counter[tuple[str, int]] = Counter()
            texts = [t or "" for t in batch["text"]]
            for text, label, (score, _) in zip(texts, batch["label"], matcher.scores(texts), strict=True):
                if label == 1 or score >= THRESHOLD:
                    folded = fold(text)
                    seen.update((p, label) for p in phrases(folded, matcher.matches(folded)))
            rows = [(p, label, n) for (p, label), n in seen.items()]
            yield pd.DataFrame(rows, columns=["phrase", "label", "n"])

    found = (
        sample.mapInPandas(around, "phrase string, label int, n long")
        .groupBy("phrase", "label")
        .agg(F.sum("n").alias("n"))
        .groupBy("phrase")
        .agg(
            F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("toxic"),
            F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("clean"),
        )
        .where("clean >= 3")
        .orderBy(F.desc("clean"), "phrase")
        .limit(CANDIDATES)
        .toPandas()
    )
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    learned = choose_exceptions(
        dict(zip(found["phrase"], found["toxic"], strict=True)),
        dict(zip(found["phrase"], found["clean"], strict=True)),
        sizes.get(1, 0),
        sizes.get(0, 0),
    )
    return _with_curve(sample, lexicon, tuple(dict.fromkeys(known + learned))) if learned else draft


def _with_curve(sample: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...]) -> ToxicityModel:
    model = ToxicityModel(lexicon, exceptions)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = model.matcher()
        for batch in batches:
            rows = [matcher.measure(t or "")[:2] for t in batch["text"]]
            yield pd.DataFrame(rows, columns=["total", "density"]).assign(label=batch["label"].to_numpy())

    rows = sample.mapInPandas(measure, "total double, density double, label int").toPandas()
    if rows["label"].nunique() < 2:
        return model
    rows = rows.sort_values(["total", "density", "label"])
    curve = fit_curve(rows[["total", "density"]].to_numpy(), rows["label"].to_numpy())
    return ToxicityModel(lexicon, exceptions, curve)


def score_documents(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Add ``score`` (0 to 1), ``matches`` and ``predicted`` (1: toxic).

    Rows and repeated rows stay as they are. NULL counts as an empty text, which has
    the score of a text without matches. Columns of those names are replaced. An
    empty table gives an empty result.
    """

    @F.pandas_udf("score double, matches int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = model.matcher()
        for batch in batches:
            rows = [row for run in slices(batch) for row in matcher.scores(run)]
            yield pd.DataFrame(rows, columns=["score", "matches"])

    result: Column = scored(F.col(f"`{text_col}`"))
    with_score = with_results(docs, result, ["score", "matches"])
    kept = [F.col(f"`{c}`") for c in with_score.columns if c.lower() != "predicted"]
    return with_score.select(*kept, (F.col("score") >= threshold).cast("int").alias("predicted"))
