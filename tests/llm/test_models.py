"""Toxicity, quality and url models: held-out results, folding, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from zoneflow.llm import quality, queries, toxicity, url_filter

SF = f"{TESTDATA}/sf0.1"


@pytest.mark.parametrize(
    ("query", "label", "divisor", "held", "least"),
    [("op1_toxicity", "toxic", 3, 1, 0.97), ("op4_quality_classifier", "quality", 5, 0, 0.98)],
)
def test_held_out_accuracy(spark, query, label, divisor, held, least):
    got = queries.QUERIES[query](spark, SF).collect()
    assert len(got) == 10_000
    for r in got[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == held)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.7 if label == "toxic" else 0.3))
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    pairs = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(pairs) > 500
    assert sum(a == b for a, b in pairs) / len(pairs) >= least


def test_folding():
    folded = toxicity.fold("1d10t М0RON Ídíot!! 5tup1d tr@sh 7817 l0s3r ＩＤＩＯＴ i\u200bdiot").split()
    assert folded == "idiot moron idiot stupid trash 7817 loser idiot idiot".split()


def test_matching_prefers_longest_and_skips_exceptions():
    model = toxicity.ToxicityModel({" idiot ": 5.0, " idio": 1.0, " scum ": 4.0}, (" pond scum ",))
    matcher = model.matcher()
    assert [m[2] for m in matcher.matches(toxicity.fold("Idiot, idiotic pond scum; scum"))] == [5.0, 1.0, 4.0]
    folded = toxicity.fold("the scum of the pond scum " * 30)
    plain = [i for i in range(len(folded)) if folded.startswith(" scum ", i) and folded[max(0, i - 5) : i] != " pond"]
    assert [m[0] for m in sorted(matcher.matches(folded))] == plain


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")


def sentence(rng, *more):
    words = rng.choices("the of river house moon and green walks slowly under seven bridges every morning".split(), k=40)
    return " ".join([*words[:20], *more, *words[20:]])


def test_words_of_other_words_letters_are_clean(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    matcher = toxicity.train(docs, labels).matcher()
    clean = ["The path to the house is worth a walk.", "Das Wort ist gut.", "A clownfish swims past a trash can.", ""]
    assert all(score < toxicity.THRESHOLD for score, _ in matcher.scores(clean))
    assert matcher.scores(["You are an idiot"])[0][0] >= toxicity.THRESHOLD


def test_exceptions_are_learned_where_they_mend_a_text(spark):
    rng = random.Random(3)
    rows = [(sentence(rng, "moron"), 1) for _ in range(60)] + [(sentence(rng), 0) for _ in range(300)]
    rows += [(sentence(rng, "brave", "moron"), 0) for _ in range(12)]
    model = toxicity.train(*labelled(spark, rows))
    assert " moron " in model.lexicon and " brave moron " in model.exceptions
    scores = [s for s, _ in model.matcher().scores([t for t, _ in rows])]
    assert [int(s >= toxicity.THRESHOLD) for s in scores] == [y for _, y in rows]


def test_copies_of_one_text_make_no_entries(spark):
    rng = random.Random(5)
    copied = sentence(rng, "zanzibar", "quixotic", "you", "moron")
    rows = [(copied + (" end" if i % 2 else ""), 1) for i in range(60)]
    rows += [(sentence(rng, "you", "moron"), 1) for _ in range(60)] + [(sentence(rng), 0) for _ in range(300)]
    lexicon = toxicity.train(*labelled(spark, rows)).lexicon
    assert " moron " in lexicon and not {" zanzibar ", " quixotic "} & set(lexicon)


def test_beginnings_stand_for_several_words(spark):
    rng = random.Random(7)
    ends = ["ling", "ter", "mole", "rak", "sund", "vot"]
    rows = [(sentence(rng, "grubba" + ends[i % 6], "pathetic"), 1) for i in range(90)]
    rows += [(sentence(rng, *(["grubba"] if i % 20 == 0 else [])), 0) for i in range(300)]
    model = toxicity.train(*labelled(spark, rows))
    assert " grubba" in model.lexicon and " grubba " in model.exceptions
    assert " pathetic " in model.lexicon and " path" not in model.lexicon
    matcher = model.matcher()
    texts = [sentence(rng, "grubbaneu", "grubbaneu"), sentence(rng, "grubba", "path")]
    assert [len(matcher.matches(toxicity.fold(t))) for t in texts] == [2, 0]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    rng = random.Random(2)
    good = [" ".join(rng.choices("the of river house moon and".split(), k=40)) for _ in range(40)]
    bad = [t + " moron scum moron scum ### ### ###" for t in good]
    rows = [(i, t, "a") for i, t in enumerate(good + bad)]
    rows += [(None, None, "a"), (0, good[0], "a"), (500, "", "a"), (501, "x" * 200_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    name = "toxic" if module is toxicity else "quality"
    marks = [(i, int((i >= 40) == (module is toxicity)), "z") for i in range(80)] + [(None, 1, "z"), (3, None, "z"), (4, 7, "z")]
    labels = spark.createDataFrame(marks, f"doc_id long, {name} int, text string")
    model = module.train(docs, labels)
    out = module.score_documents(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    hits = [(r.predicted, r.doc_id) for r in out if r.doc_id is not None and r.doc_id < 80]
    right = sum(p == int((i >= 40) == (module is toxicity)) for p, i in hits)
    assert right >= 0.95 * len(hits)
    none = docs.limit(0)
    assert module.score_documents(none, model).collect() == []
    untrained = module.score_documents(docs, module.train(docs, labels.limit(0)))
    assert len({r.score for r in untrained.collect()}) == 1


def test_quality_features_are_finite():
    made = quality.text_features(["", " ", "\n\n", "a", "é日𝄞", "A!" * 1000])
    assert made.shape == (6, len(quality.FEATURES)) and (abs(made) < 1e6).all()


def test_quality_learns_from_every_labelled_document(spark):
    # The last by the hash that a sample of 12,000 went by are the only ones that show what is bad.
    ids = spark.range(13_000).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id")).toPandas()["doc_id"].tolist()
    plain, odd = "the river and the house of the moon", "||| ### ||| {{}} |||"
    rows = [(i, odd if at >= 12_500 else plain, int(at < 12_500 and at % 2)) for at, i in enumerate(ids)]
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(both.select("doc_id", "text"), both.select("doc_id", "quality"))
    odd_score, plain_score = model.raw(quality.text_features([odd, plain]))
    assert odd_score < plain_score - 1


def some_labelled(rng, n):
    x = np.column_stack([rng.normal(size=(n, len(quality.FEATURES) - 1)), rng.integers(0, 3, n)])
    return x, (x[:, 0] - x[:, 3] ** 2 + rng.normal(size=n) > -0.5).astype(float)


def test_quality_fit_is_that_of_all_pairs(spark, monkeypatch):
    x, y = some_labelled(np.random.default_rng(4), 300)
    names = [f"f{i} double" for i in range(len(quality.FEATURES))]
    frame = spark.createDataFrame(np.column_stack([x, y]).tolist(), ", ".join([*names, "label double"])).repartition(5)
    few = quality.fit(quality.labelled(frame))
    monkeypatch.setattr(quality, "FEW_ROWS", 10)
    far = quality.labelled(frame)
    assert far.few is None
    many = quality.fit(far)
    np.testing.assert_allclose(few.knots, np.quantile(x, np.linspace(0.02, 0.98, quality.KNOTS), axis=0))
    np.testing.assert_allclose(few.knots, many.knots)
    deviation = few.parts(x).std(axis=0)
    np.testing.assert_allclose(few.scale, np.where(deviation > 0, deviation, 1))
    np.testing.assert_allclose(many.weights, few.weights, atol=1e-8)
    # The plain loss over all pairs is least there.
    parts = few.basis(x)
    diff = (parts[y == 1][:, None] - parts[y == 0]).reshape(-1, parts.shape[1])

    def slope(weights):
        return -diff.T @ (1 / (1 + np.exp(diff @ weights))) / len(diff) + quality.RIDGE * weights

    assert abs(slope(few.weights)).max() < 1e-5 < 1e-2 < abs(slope(np.zeros(parts.shape[1]))).max()
    scores = few.raw(x)
    assert few.cut == pytest.approx(np.quantile(scores, (y == 0).mean()))
    assert few.spread == pytest.approx(scores.std() / 2)


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.com/en/x?y#z", "http://shop.example.com/en/", "http://example.com/de/",
    "http://a.net/es/1", "http://net/fr/", "http://anet/fr/", "x://h?p=/en/", "x://h#/en/", "ftp://a.com", "http://com/", "a://b://c.com/x",
    "http://www.example.com/en", "http://casino-win.example.org/", "http://É.com/É?q", "http://a\nb.com/x",
]


def verdict_of(url):
    host, path = url_filter.split_url(url)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_urls(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[4], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    model = url_filter.fitted(url_filter.labelled_urls())
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = verdict_of(URLS[4] if r.page_id == 0 and r.path else URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        own = "block" if model.score(host, path) >= url_filter.BLOCK_AT else "allow"
        assert r.verdict == (verdict or own)
        assert r.block_score == pytest.approx(model.score(host, path))
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_url_model_on_hosts_it_has_not_seen():
    rows = url_filter.labelled_urls()
    assert 150 <= len(rows) <= 200 and len({url_filter.split_url(u)[0] for u, _ in rows}) == len(rows)
    judged = []
    for part in range(url_filter.HELD_OUT):
        model = url_filter.fitted([r for r in rows if not url_filter.held_out(r[0], part)])
        for url, label in rows:
            if url_filter.held_out(url, part):
                judged.append((int(model.score(*url_filter.split_url(url)) >= url_filter.BLOCK_AT), label))
    assert len(judged) == len(rows)
    clean = [p for p, y in judged if not y]
    assert sum(clean) <= 0.05 * len(clean)
    assert sum(p == y for p, y in judged) / len(judged) >= 0.75


def test_url_model_knows_words_in_new_places():
    model = url_filter.fitted(url_filter.labelled_urls())
    block = ["http://viagra.example.org/", "http://gamble-now.example.org/slots", "http://malware-download.biz/x.exe"]
    allow = ["http://library.example.net/en/55", "http://garden.example.com/", "http://qwopnarl.example.org/de/7", ""]
    assert all(model.score(*url_filter.split_url(u)) >= url_filter.BLOCK_AT for u in block)
    assert all(model.score(*url_filter.split_url(u)) < url_filter.BLOCK_AT for u in allow)


def test_url_model_of_few_rows():
    assert url_filter.fitted([]).score("a.b", "/") == 0.5
    assert url_filter.fitted([("http://casino.net/", 1)] * 3).score("casino.net", "/") > 0.5
    with pytest.raises(ValueError, match="rows"):
        url_filter.train([("http://a.b/", 1)] * (url_filter.MAX_LABELLED + 1))
