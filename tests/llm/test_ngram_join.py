"""The Jaccard join against a comparison of all pairs."""

import random

import pytest

from zoneflow.llm import components as joined
from zoneflow.llm.ngram_join import Threshold, _told_apart, blocks, keep_one, near_duplicates

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    words = (text or "").encode().translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = find(i)
            least[r] = min(least.get(r, key), key)
    return sorted(
        ((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))),
        key=str,
    )


def run(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, n string, set_id int")
    got = near_duplicates(docs, **options).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def family(rng, size, base, edits):
    """Texts that differ from one of ``base`` words in up to ``edits`` places."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
    for _ in range(size):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(base)] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("rule", [Threshold(), Threshold(common=3, block=4)])
def test_families_and_copies(spark, rule):
    rng = random.Random(3)
    texts = [t for e in (1, 2, 4, 8) for t in family(rng, 25, 90, e)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))) for _ in range(40)]
    texts += ["a b c d e f"] * 30 + ["A  B\tC\nD e F"] * 3 + ["a b", "a B", "a", "", None, " \n", " "]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    assert run(spark, rows, rule=rule) == expected(rows)


def test_nulls_repeats_and_ties(spark):
    long = " ".join(f"t{i % 977}z{i}" for i in range(30_000))
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (5, ""), (5, None),
            (None, None), (9, long), (8, long + " end"), (None, "only one here today")]
    assert run(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_of_each_group_stays(spark):
    """By row: an id may come twice with unlike texts, or not at all."""
    rows = [
        (4, "a b c d e f"), (2, "a b c d e f"), (3, "z"), (None, "a b c d e f"), (2, "a b c d e f"),
        (2, "other words than those of its namesake"), (None, "nobody has this text and no id"),
        (None, "nobody has this text and no id"), (5, ""), (5, None), (6, " "),
    ]
    docs = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, component_id string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "").split()[:1]) for r in kept.collect()) == [
        ("2", ["a"]), ("2", ["other"]), ("3", ["z"]), ("5", []), ("6", []), ("None", ["nobody"])
    ]
    assert keep_one(docs.limit(0)).collect() == []


def test_a_passage_in_many_short_texts(spark):
    """Its shingles are common to all; what is dealt out grows with the list, not its square."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} {rng.randrange(10**9)} {rng.randrange(10**9)}" for _ in range(20_000)]
    texts += [f"{passage} " + " ".join(f"{n}_{i}" for i in range(30)) for n in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = near_duplicates(docs).groupBy("component_id").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 50 + [20_000]


def test_entries_of_one_component_are_dealt_once(spark):
    entries = spark.range(40_000).selectExpr("1L AS token", "id AS a", "50 AS na")
    one = spark.range(39_990).selectExpr("id AS node", "0L AS component")
    few = blocks(entries, one, Threshold()).count()
    assert few <= 4 * 40_000  # three size classes of the one block of the others
    assert blocks(entries, one.limit(0), Threshold(), draw=0).count() == 3 * 40_000


def test_sets_that_share_one_hash_only(spark):
    rows = [(1, 5, 7), (2, 5, 7), (3, 5, 8), (4, 6, 9)]
    known = spark.createDataFrame(rows, "doc_id long, set_id long, check long")
    ids = {r.doc_id: r.set_id for r in _told_apart(known).collect()}
    assert ids[1] == ids[2] != ids[3] and ids[4] == 6


def test_components_stop_when_all_hang_on_their_smallest(spark, monkeypatch):
    """No round is made only to see that nothing moves."""
    made, real = [], joined.stored
    monkeypatch.setattr(joined, "stored", lambda df, label: made.append(label) or real(df, label))

    def groups(edges):
        made.clear()
        frame = spark.createDataFrame(edges, "a long, b long")
        return {r.node: r.component for r in joined.components(frame).collect()}

    assert groups([(n, 100) for n in range(100, 140)] + [(7, 9), (9, 7)]) == {n: 100 for n in range(100, 140) if n > 100} | {100: 100, 7: 7, 9: 7}
    assert len(made) == 2  # the links, and one round
    rng = random.Random(4)
    path = list(range(200))
    rng.shuffle(path)
    got = groups(list(zip(path, path[1:], strict=False)) + [(300 + n, 300 + (n + 1) % 9) for n in range(9)] + [(500, 500)])
    assert got == dict.fromkeys(range(200), 0) | dict.fromkeys(range(300, 309), 300)
    assert groups([]) == {}
