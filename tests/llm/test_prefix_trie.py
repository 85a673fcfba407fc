"""The trie of conversations against a plain walk over all their beginnings."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from zoneflow.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is None:
            continue
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        convs[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(lists):
    members = defaultdict(list)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = set()
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        childless = [x for x in under if not any(y[:-1] == x for y in members if y)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(str(c) for c in sorted(who) if len(lists[c]) == len(node))
        rows.add((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
            sum(y[:-1] == node for y in members if y), len(childless), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return rows


def made_rows(seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", None]), "".join(rng.choices("abé ", k=rng.randint(0, 4))) or None) for _ in range(6)]
    rows = []
    for c in rng.sample(range(-40, 200), 90):
        for i in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, rng.choice([None, i, i, i]), *turns[min(len(turns) - 1, int(rng.expovariate(0.8)))], "x"))
    return rows + rows[:5] + [(None, 1, "user", "lost", "x")]


@pytest.mark.parametrize(("seed", "shard"), [(1, 200_000), (1, 40), (2, 7), (3, 1)])
def test_against_a_plain_walk(spark, seed, shard):
    rows = made_rows(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    lists = trie.spliced(trie.sequences(table))
    got = [tuple(r) for r in trie.prefix_trie(lists, shard).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rebuilt(ordered(rows)))
    plainly = trie.prefix_trie(trie.sequences(table), shard).collect()
    assert {tuple(r) for r in plainly} == plain(ordered(rows))


def test_copies_turnless_and_empty(spark):
    rows = [(c, 0, "user", "same", "x") for c in range(3000)]
    got = {r.depth: r for r in trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (got[1].n_convs, got[1].saved_tokens, got[0].saved_tokens, got[0].n_leaves) == (3000, 2999 * 4, 2999 * 4, 1)
    joined = ",".join(map(str, range(3000)))
    assert got[1].ends_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert got[0].ends_sha256 == trie.NO_ENDS and got[0].parent_conv_id is None
    nothing = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.spliced(trie.sequences(nothing))).collect() == []
    # A conversation that its missing head leaves without turns ends at the root.
    alone = [(c, 0, "user", "t", "x") for c in range(1, 5)]
    whole = trie.prefix_trie(trie.spliced(trie.sequences(spark.createDataFrame(alone, SCHEMA)))).collect()
    assert {tuple(r) for r in whole} == plain(rebuilt(ordered(alone)))


def test_long_conversation(spark):
    rows = [(7, i, "user", str(i % 3), "x") for i in range(5000)]
    got = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 5001 and {r.n_leaves for r in got} == {1}
    assert sorted(trie.medians(9)) == list(range(9)) and next(trie.medians(9)) == 4
