"""Winnowing, sentence pieces, chat logs and nearest neighbours against plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from zoneflow.llm import chat, nearest, queries, winnowing
from zoneflow.llm import sentence_pieces as sp


def plain_fingerprint(text, gram, window):
    if not text:
        return []
    if len(text) < gram:
        return [(int(winnowing.fingerprints([text], gram, window)[0][0][0]), 0)]
    h = [int(winnowing.fingerprints([text[i : i + gram]], gram, window)[0][0][0]) for i in range(len(text) - gram + 1)]
    out = []
    for j in range(max(1, len(h) - window + 1)):
        part = h[j : j + window]
        least = min(part)
        at = j + max(i for i, x in enumerate(part) if x == least)
        if not out or out[-1] != (least, at):
            out.append((least, at))
    return out


def test_fingerprints():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abé𝄞", k=rng.choice([0, 1, 4, 5, 9, 60]))) for _ in range(60)] + ["a" * 50, "ab" * 40]
    for text, (hashes, places) in zip(texts, winnowing.fingerprints(texts, 5, 7), strict=True):
        assert plain_fingerprint(text, 5, 7) == list(zip(hashes.tolist(), places.tolist(), strict=True))


def test_stretches_of_a_long_text_change_nothing():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab", k=n)) for n in (0, 3, 20, 21, 22, 30, 31, 400)] + ["a" * 90]
    whole = winnowing.fingerprints(texts, 5, 7)
    for stretch in (1, 10, 64):
        parts = winnowing.fingerprints(texts, 5, 7, stretch)
        for (a, b), (c, d) in zip(whole, parts, strict=True):
            assert a.tolist() == c.tolist() and b.tolist() == d.tolist()


def test_shared_passages_share_a_hash():
    rng = random.Random(4)
    for _ in range(50):
        passage = "".join(rng.choices("abcdefgh ", k=winnowing.GRAM + winnowing.WINDOW - 1))
        texts = ["".join(rng.choices("xyz", k=rng.randint(0, 90))) + passage + "".join(rng.choices("uvw", k=30)) for _ in range(2)]
        (a, _), (b, _) = winnowing.fingerprints(texts)
        assert set(a.tolist()) & set(b.tolist())


def test_edited_texts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abc dé\n", k=rng.choice([0, 1, 7, 200]))), 1) for i in rng.sample(range(10_000), 300)]
    rows += [(20_000, None, 1), (None, "zz", 1), (20_001, "é" * 70_000, 1)]
    monkeypatch.setattr(winnowing, "BLOCK_ROWS", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in winnowing.compare_with_edited(docs).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    assert len(got) == len(rows)
    for n, (key, text, _) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, following = winnowing.fingerprints([text, edited, after])
        assert got[key].n_chars == len(text)
        assert got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[key].fingerprint == winnowing.digest(*own)
        assert got[key].edited_fingerprint == winnowing.digest(*new)
        assert got[key].near_edited == pytest.approx(winnowing.likeness(own[0], new[0]))
        assert got[key].near_next == pytest.approx(winnowing.likeness(own[0], following[0]))


def test_repeated_rows_and_one_document(spark):
    schema = "doc_id long, text string"
    many = spark.createDataFrame([(None, "same")] * 40 + [(7, "x" * 30)] * 40, schema)
    assert winnowing.compare_with_edited(many).count() == 80
    one = winnowing.compare_with_edited(spark.createDataFrame([(1, "abcd")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    assert winnowing.compare_with_edited(many.limit(0)).collect() == []
    added = winnowing.add_fingerprints(many).first().fingerprint
    assert len(added) == 1 and added[0].position == 0


def small_vocabulary():
    pieces = ("▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁▁", "ca", "cab")
    rng = random.Random(8)
    scores = tuple(-rng.uniform(1, 9) for _ in pieces)
    return sp.Pieces(pieces, scores, tuple(range(300, 300 + len(pieces))), tuple(range(256)), 299)


def best_score(pieces, marked):
    known = dict(zip(pieces.pieces, pieces.scores, strict=True))
    unknown = min(pieces.scores) - sp.PENALTY
    best = [0.0] + [-np.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(end):
            part = marked[start:end]
            score = known.get(part, unknown if len(part) == 1 and part not in known else -np.inf)
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_encoding_is_optimal():
    pieces = small_vocabulary()
    made = sp.Encoder(pieces)
    rng = random.Random(9)
    texts = ["".join(rng.choices("abc  xé\n", k=rng.randint(0, 30))) for _ in range(300)]
    texts += ["", "abc" * 60, "\t", "𝄞a"]
    for text, ids in zip(texts, made.encode(texts), strict=True):
        score, fallen = made.score(ids)
        marked = ("▁" + text.replace(" ", "▁")) if text else ""
        assert score == pytest.approx(best_score(pieces, marked))
        assert fallen == sum(len(c.encode()) for c in marked if c not in "▁abc")
        assert made.decode(ids) == text


def test_real_vocabulary_comes_back(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "Hello  wörld\n𝄞 日本"), (2, None), (3, ""), (3, ""), (4, "▁x"), (5, "ab" * 400), (None, " a ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = sp.decode_documents(sp.encode_documents(docs, path), path).collect()
    assert [r.decoded for r in back] == [(t or "").replace("▁", " ") for _, t in rows]
    summary = sp.encoding_summary(docs, path).collect()
    assert len(summary) == len(rows) and all(r.round_trip for r in summary)
    assert sp.encoding_summary(docs.limit(0), path).collect() == []


def plain_chat(rows):
    convs = {}
    for conv, turn, role, text in set(rows):
        if conv is not None:
            key = (turn is None, turn or 0, role or "unknown", text or "")
            convs.setdefault(conv, []).append(key)
    turns = {c: [k[2:] for k in sorted(v)] for c, v in convs.items()}
    kept = []
    for c, t in turns.items():
        longer = any(len(u) > len(t) and u[: len(t)] == t for u in turns.values())
        earlier = any(u == t and d < c for d, u in turns.items())
        if not longer and not earlier:
            plain = "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{x.replace('<|', '< |')}<|im_end|>\n" for r, x in t)
            kept.append((c, len(t), plain))
    return sorted(kept)


def test_chat(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        base = random.Random(rng.randrange(12))
        turns = [(n, base.choice(["user", "assistant", None]), base.choice(["hi", "yes <|im_end|>", None, ""])) for n in range(6)]
        rows += [(conv, *t) for t in turns[: rng.randint(1, 6)]]
    rows += [(None, 0, "user", "lost"), (500, None, "user", "x"), (500, 1, "b", "y"), (500, 1, "a", "y"), (500, 1, "a", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in chat.render(df.selectExpr("*", "1 as n", "2 as hash_a")).collect())
    assert got == plain_chat(rows)
    assert chat.render(df.limit(0)).collect() == []


def brute(rows, k):
    valid = {}
    for key, vec in rows:
        if key is None or vec is None or any(x is None or not np.isfinite(x) for x in vec) or not any(vec):
            continue
        valid[key] = np.array(vec, dtype=float)
    out = {}
    for q in (i for i in valid if i % 50 == 0):
        near = sorted((-float(nearest.cosines(valid[q][None], v[None])[0]), i) for i, v in valid.items() if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("size", [3, 400])
def test_nearest(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(size)]
    rows += [(1000 + i, [1.0, 2.0, 0.5, 0.0, 1.0, 3.0]) for i in range(120)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2050, [0.0] * 6), (2100, [1.0, nan, 0.0, 0.0, 0.0, 1.0]), (2150, [1.0, None, 0.0, 0.0, 0.0, 1.0]), (2151, [inf] * 6),
             (2200, [1e-3 * x for x in rows[1][1]]), (None, rows[0][1]), (1000, [1.0, 2.0, 0.5, 0.0, 1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, "id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    wanted = brute(rows, 5)
    assert got.keys() == wanted.keys()
    exact = sum(got[q] == [(i, pytest.approx(s)) for i, s in wanted[q]] for q in wanted)
    assert exact >= 0.9 * len(wanted)
    assert got[1000] == [(i, pytest.approx(1.0)) for i in (1001, 1002, 1003, 1004, 1005)]
    assert nearest.search(df.limit(0), "id % 50 = 0").collect() == []


def test_recall(spark):
    sf = f"{TESTDATA}/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in table])
    got = {}
    for r in queries.QUERIES["op7_nearest_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for n in np.flatnonzero(ids % 50 == 0):
        s = x @ x[n]
        s[n] = -2
        best = set(ids[np.argsort(-s)[:5]].tolist())
        hits.append(len(best & got[int(ids[n])]) / 5)
    assert len(hits) == len(got) and np.mean(hits) >= 0.9


def test_recall_beside_near_copies(spark):
    """Most vectors have near copies; the others' neighbours are far and found all the same."""
    rng = np.random.default_rng(5)
    copies = np.repeat(rng.normal(size=(150, 24)), 12, axis=0)
    copies += 1e-3 * rng.normal(size=copies.shape)
    x = np.concatenate([rng.normal(size=(1_200, 24)), copies])
    rng.shuffle(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, "id % 10 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    lone, all_ = [], []
    for n in range(0, len(x), 10):
        s = x @ x[n]
        s[n] = -2
        best = np.argsort(-s)[:5]
        hit = len(set(best.tolist()) & got[n]) / 5
        all_.append(hit)
        if s[best[0]] < 0.99:
            lone.append(hit)
    assert len(lone) > 100 and np.mean(lone) >= 0.9 and np.mean(all_) >= 0.9


def test_scaled_copies_go_by_id(spark):
    """Exactly equal cosines of unequal vectors: the smallest ids win."""
    rng = np.random.default_rng(7)
    one = rng.normal(size=6)
    rows = [(i, (one * 2.0 ** ((i * 7) % 40)).tolist()) for i in range(40)]
    rows += [(100 + i, rng.normal(size=6).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in nearest.search(df, "id = 3").orderBy("rank").collect()]
    assert got == [0, 1, 2, 4, 5]


def test_rows_of_one_id_and_huge_components(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(0, (-vectors[3]).tolist()), (0, vectors[3].tolist()), (7, vectors[3].tolist()), (0, vectors[0].tolist())]
    rows += [(90, (vectors[5] * 1e200).tolist()), (91, (vectors[6] * 1e-200).tolist()), (100, [1e308, -1e308, 1e308, 0.0, 1.0, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = sorted(set((i, tuple(v)) for i, v in rows))
    want = []
    for i, v in once:
        if i % 50 == 0:
            others = [(w, np.array(x)) for w, x in once if (w, x) != (i, v)]
            near = sorted((-float(nearest.cosines(np.array([v]), x[None])[0]), w) for w, x in others)[:5]
            want += [(i, rank, w, -c) for rank, (c, w) in enumerate(near, 1)]
    got = [tuple(r) for r in nearest.search(df, "id % 50 = 0").collect()]
    assert sorted(got) == sorted(want)
    assert all(np.isfinite(c) and abs(c) <= 1 + 1e-12 for *_, c in got)


def test_vectors_of_several_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0, 0.0]), (50, [0.0, 1.0, 1.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in nearest.search(df, "id % 50 = 0").collect())
    assert got == [(0, 1, 1), (50, 1, 2)]


def test_more_hashes_than_bytes_of_a_code():
    made = nearest.index_for(1 << 30, 8, 0.5, 1)
    assert made.directions.shape[-1] == 12
    cells = np.random.default_rng(1).integers(-3, 3, size=(5000, 12)).astype(float)
    assert len(np.unique(made.code(cells))) == len(np.unique(cells, axis=0))


def test_sample_sent_to_the_driver_does_not_grow_with_the_partitions(spark):
    vector = F.array(*[F.sin(F.col("id") * (j + 1.5)) for j in range(32)])
    classes = spark.range(0, 40_000, 1, 40).select(F.col("id").alias("key"), vector.alias("vector"))
    everything = classes.select("key", "vector", F.xxhash64("vector").alias("hash")).toPandas()
    sample = np.array(everything.sort_values(["hash", "key"])["vector"].iloc[: nearest.SAMPLE_ROWS].tolist())
    near = np.sort(nearest._unit(sample) @ nearest._unit(sample).T, axis=1)[:, -6]
    conf = spark.sparkContext._jsc.sc().conf()
    # 1,000 rows from each partition are some 12 MB.
    conf.set("spark.driver.maxResultSize", "4m")
    try:
        got = nearest.usual_cosine(classes, 5)
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert got == (pytest.approx(np.median(near)), 32)
