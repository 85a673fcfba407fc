"""Repeated passages against a plain count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from zoneflow.llm import substrings as sub

W = 14


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {
            j
            for i in range(len(w) - window + 1)
            if count[tuple(w[i : i + window])] > 1
            for j in range(i, i + window)
        }
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def made_texts(rng, n, vocabulary):
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [rng.choices(words, k=rng.randint(5, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else rng.choices(words, k=rng.randint(1, 30))
        texts.append(rng.choice([" ", "\n", "\t \r"]).join(parts))
    return texts


@pytest.mark.parametrize("vocabulary", [2, 5, 400])
def test_against_all_windows(spark, vocabulary, monkeypatch):
    """Few different words make long accidental repeats and grams that all are common."""
    rng = random.Random(vocabulary)
    texts = [*made_texts(rng, 60, vocabulary), None, "", " \n", "é x " * 20, "a b " * 40, "a b " * 40]
    schema = "doc_id long, text string, kept_text int, N_WORDS string, note string"
    docs = spark.createDataFrame([(i, t, i, "x", "kept") for i, t in enumerate(texts)], schema)
    monkeypatch.setattr(sub, "STRETCH", 50)
    got = {r.doc_id: r for r in sub.remove_repeats(docs.repartition(5), W).collect()}
    for i, wanted in enumerate(plain(texts, W)):
        row = got[i]
        assert (row.n_words, row.n_removed, row.kept_text) == wanted
        assert sum(b - a for a, b in row.removed) == row.n_removed and row.note == "kept"
        assert row.text == texts[i]
    assert sub.remove_repeats(docs, W).columns == ["doc_id", "text", "note", *sub.RESULTS]


def test_many_small_shards_change_nothing(spark):
    texts = made_texts(random.Random(9), 80, 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.selectExpr("unhex(md5(binary(text))) AS text_id", "text")
    by = [
        {bytes(r.text_id): sub._merged(r.spans) for r in sub.repeated_spans(keyed, W, n).collect()}
        for n in (100, 1_000_000)
    ]
    assert by[0] == by[1] and by[0]


def test_repeated_rows_empty_table_and_no_id(spark):
    text = " ".join(f"x{i}" for i in range(W))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, text), (None, text), (1, text + " y")], schema)
    rows = sorted((r.n_words, r.n_removed, r.kept_text) for r in sub.remove_repeats(docs, W).collect())
    assert rows == [(W, W, ""), (W, W, ""), (W + 1, W, "y")]
    assert sub.remove_repeats(docs.limit(1), W).first().n_removed == 0
    assert sub.remove_repeats(docs.limit(0), W).collect() == []
    assert sub.remove_repeats(spark.createDataFrame([(1, None)], schema), W).first().kept_text == ""


def test_one_common_line_in_many_texts_is_no_hot_shard(spark):
    """A line of fewer words than a window is shared by all and is in no repeat."""
    rng = random.Random(3)
    line = " ".join(f"line{i}" for i in range(20))
    texts = [" ".join(f"{i}_{j}" for j in range(30)) + " " + line + f" {i} " + " ".join(f"{i}-{j}" for j in range(30)) for i in range(300)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in sub.remove_repeats(docs).collect()} == {0}


def test_words_of_a_long_text_in_pieces(monkeypatch):
    rng = random.Random(1)
    data = b"".join(rng.choice([b"ab", b"c", b" ", b"\t", b"longer-word"]) for _ in range(5000)) + b"z" * 700
    whole = sub.word_codes([data])[0]
    monkeypatch.setattr(sub, "LONG_TEXT", 300)
    assert np.array_equal(sub.word_codes([data])[0], whole) and len(whole) == len(data.split())


def test_index_counts_patterns():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 4, 300)
    text[[90, 200, 299]] = 0
    index = sub.FMIndex(text, np.ones(300, dtype=np.int64), 20)
    for _ in range(200):
        a = int(rng.integers(0, 280))
        pattern = text[a : a + int(rng.integers(1, 8))]
        if (pattern == 0).any():
            continue
        low, high = np.array([0]), np.array([300])
        for symbol in pattern[::-1]:
            low, high = index.extend(np.array([symbol]), low), index.extend(np.array([symbol]), high)
        count = sum(np.array_equal(text[i : i + len(pattern)], pattern) for i in range(300))
        assert int(index.weight(low, high)[0]) == count == int((high - low)[0])
