"""URL verdicts: rules by host and path first, a logistic regression for the rest.

The regression sees hashed character n-grams of host and path. It is trained on a
small labelled table of URLs and on more that are made of the table's words, so that a
word tells, and neither its place nor a host's ending does.
"""

from __future__ import annotations

import csv
import functools
import re
import string
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.common import fresh

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
MAX_LABELLED = 10_000
BLOCK_AT = 0.65  # the least at which at most 5 of 100 clean held-out URLs are blocked, in steps of 0.05


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules in force.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

TABLE = Path(__file__).with_name("labelled_urls.csv")
HELD_OUT = 5
ROUNDS = 3

_SUBDOMAINS = ("", "www.", "m.", "blog.", "shop.")
_ENDINGS = "com net org info de fr biz example.com example.org example.net".split()
_LANGUAGES = ("", "en/", "de/", "", "fr/", "es/")
_NO_WORDS = {"www", "php", "html", "example"}


def labelled_urls(path: str | Path = TABLE) -> list[tuple[str, int]]:
    """The labelled table: URLs and 1 for block, from a file with columns ``label`` and ``url``."""
    with open(path, encoding="utf-8", newline="") as rows:
        return [(row["url"], int(row["label"])) for row in csv.DictReader(rows)]


def held_out(url: str, part: int = 0, parts: int = HELD_OUT) -> bool:
    """Whether a URL is of the given one of ``parts`` parts; all URLs of a host are of one part."""
    return zlib.crc32(split_url(url)[0].encode()) % parts == part


def _words(url: str) -> set[str]:
    host, path = split_url(url)
    found = re.findall("[a-z]{3,}", f"{host.rpartition('.')[0]}/{path.lower()}")
    return set(found) - _NO_WORDS


def recombined(rows: Sequence[tuple[str, int]], rounds: int = ROUNDS) -> list[tuple[str, int]]:
    """URLs made of words that have one label only, alone and by twos, as many of either label.

    Subdomains, endings, languages and the rest of the path are dealt alike to both.
    """
    labels: dict[str, set[int]] = {}
    for url, label in rows:
        for word in _words(url):
            labels.setdefault(word, set()).add(label)
    own = {y: sorted(w for w, found in labels.items() if found == {y}) for y in (0, 1)}
    made = []
    for label, words in own.items():
        for i in range(rounds * max(map(len, own.values())) if words else 0):
            turn, at = divmod(i, len(words))
            word, other = words[at], words[(at * 7919 + turn * 31 + 1) % len(words)]
            name = (word, f"{word}-{other}", f"{other}{word}", f"{word}{other}")[(turn + i) % 4]
            number = 1000 + 13 * i % 9000
            rest = (f"{number}", f"{other}/", f"{number}.html", "", f"{other}.html")[i // 2 % 5]
            host = f"{_SUBDOMAINS[i % 5]}{name}.{_ENDINGS[i // 3 % 10]}"
            made.append((f"http://{host}/{_LANGUAGES[i % 6]}{rest}", label))
    return made


def fitted(rows: Sequence[tuple[str, int]]) -> UrlModel:
    """A model of labelled URLs and of what ``recombined`` makes of them."""
    return train([*rows, *recombined(rows)])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty for NULL or without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return lower, path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Number of the longest rule that fits, NULL if none does."""
    order = sorted(range(len(rules)), key=lambda n: (-len(rules[n].name), -len(rules[n].host), n))
    fits = [
        F.when(
            ((host == rules[n].host) | F.endswith(host, F.lit(f".{rules[n].host}")))
            & F.startswith(path, F.lit(rules[n].path)),
            F.lit(n),
        )
        for n in order
    ]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def _buckets(text: str, part: str) -> list[int]:
    marked = f"{part}^{text}$"
    return [
        zlib.crc32(f"{part}{marked[i : i + n]}".encode()) % BUCKETS
        for n in GRAMS
        for i in range(1, len(marked) - n + 1)
    ]


def split_url(url: str | None) -> tuple[str, str]:
    """What ``host_and_path`` says, for one URL."""
    _, found, after = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(after.find, "/?#") if i >= 0), default=len(after))
    host, rest = after[:cut], after[cut:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), rest[:end]


@dataclass(frozen=True)
class UrlModel:
    """Weight per bucket; the n-grams of host and of path count by their mean."""

    weights: np.ndarray
    bias: float

    def part(self, text: str, kind: str) -> float:
        at = _buckets(text, kind)
        return float(self.weights[at].sum() / np.sqrt(len(at))) if at else 0.0

    def score(self, host: str, path: str) -> float:
        """Chance that the URL is to be blocked."""
        return 1 / (1 + float(np.exp(-np.clip(self.bias + self.part(host, "h") + self.part(path, "p"), -30, 30))))


def train(labelled: Iterable[tuple[str, int]], ridge: float = 0.01, steps: int = 1000) -> UrlModel:
    """Logistic regression by gradient descent, both labels with equal weight in all.

    More than ``MAX_LABELLED`` rows are an error.
    """
    rows = list(labelled)
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table may have {MAX_LABELLED} rows")
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    y = np.array([label for _, label in rows], dtype=np.float32)
    for n, (url, _) in enumerate(rows):
        for kind, text in zip("hp", split_url(url), strict=True):
            at = _buckets(text, kind)
            np.add.at(x[n], at, 1 / np.sqrt(len(at)) if at else 0)
    used = np.flatnonzero(x.any(axis=0))
    blocked = float(y.sum()) / max(len(y), 1)
    share = np.where(y == 1, blocked, 1 - blocked)
    weight = (1 / np.maximum(share, 1e-9) / 2).astype(np.float32)
    x = x[:, used]
    # The weights stay a sum of rows, so steps need the rows' products alone.
    products = x @ x.T
    sums, bias = np.zeros(len(rows), dtype=np.float32), 0.0
    for _ in range(steps if len(rows) else 0):
        miss = weight * (1 / (1 + np.exp(-(products @ sums + bias))) - y) / len(rows)
        sums -= 2 * (miss + ridge / len(rows) * sums)
        bias -= 0.5 * float(miss.sum())
    weights = np.zeros(BUCKETS)
    weights[used] = x.T @ sums
    return UrlModel(weights, bias)


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    model: UrlModel | None = None,
    url_col: str = "url",
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (or NULL), ``block_score`` and ``verdict``.

    A NULL url, or one without ``://``, has an empty host and path. Columns of those
    names are replaced; rows, repeated ones too, stay as they are.
    """
    model = model or fitted(labelled_urls())

    @F.pandas_udf("double")
    def chance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of_host = functools.lru_cache(100_000)(lambda host: model.part(host, "h"))
        for hosts, paths in batches:
            z = [model.bias + of_host(h) + model.part(p, "p") for h, p in zip(hosts, paths, strict=True)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30))))

    names = ("host", "path", "rule", "block_score", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in names]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    at = fresh("rule")
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    found = parts.withColumn(at, matching_rule(F.col("host"), F.col("path"), rules))
    scored = found.withColumn("block_score", chance("host", "path"))
    by_rule = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for n, rule in enumerate(rules):
        by_rule = F.when(F.col(at) == n, F.lit(rule.verdict)).otherwise(by_rule)
        name = F.when(F.col(at) == n, F.lit(rule.name)).otherwise(name)
    own = F.when(F.col("block_score") >= BLOCK_AT, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        *kept, "host", "path", name.alias("rule"), "block_score", F.coalesce(by_rule, own).alias("verdict")
    )
