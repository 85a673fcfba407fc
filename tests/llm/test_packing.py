"""Packing: the plan against an exhaustive search, the ids against the tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from zoneflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in sorted(set(r for r in rooms if r >= items[i])):
            rooms.remove(room)
            go(i + 1, [*rooms, room - items[i]])
            rooms.append(room)
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def placed(plan, histogram):
    """Sequence and offset of every piece, by length and rank."""
    for length, count in histogram.items():
        for rank in range(count):
            hits = [
                (base + (rank - first) // each, offset + (rank - first) % each * length, length)
                for n, first, sequences, each, base, offset in plan.slots
                if n == length and first <= rank < first + sequences * each
            ]
            assert len(hits) == 1
            yield hits[0]


def check_gapless(rows, capacity):
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_as_good_as_a_search(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 50])
    items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
    histogram = {n: items.count(n) for n in items}
    plan = packing.make_plan(histogram, capacity)
    assert check_gapless(placed(plan, histogram), capacity) == plan.sequences
    assert plan.sequences == fewest(items, capacity)


def test_dominating_sets_are_fixed_in_bulk():
    plan = packing.make_plan({7: 10**9, 3: 10**9 + 1}, 10)
    assert (plan.sequences, plan.fixed) == (10**9 + 1, 10**9 + 1)
    assert packing.make_plan({}, 10).sequences == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.make_plan({11: 1}, 10)


def test_ids_are_the_tokenizers():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["", " \t\n", "Don't. it's, X-Y <|endoftext|>. x<|ENDOFTEXT|>y", "áÉ İ Σας ﬁ 日本 𝄞", "a\x85b\x1cc\xa0d ½²",
             "ALL!! caps,, 12.5% ~~~", "e\u0301 " * 50]
    encoder = packing.WordEncoder(PATH)
    assert encoder.splits
    made = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert made == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_known_stretch_is_not_split_again(monkeypatch):
    words, split = packing._WORDS, []

    class Counted:
        def findall(self, text):
            split.append(text)
            return words.findall(text)

    monkeypatch.setattr(packing, "_WORDS", Counted())
    texts = ["river, house2 it's a\xa0b \x1c.x ÉCOLE(7) river", "RIVER, it's École(7)\nhouse2", " \xa0 ", "a\x00b 12 ²x--"]
    encoder = packing.WordEncoder(PATH)
    assert encoder.splits
    first = encoder.encode(texts)
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in first] == wanted
    split.clear()
    assert encoder.encode(texts) == first and split == []
    encoder.capacity = 0
    assert encoder.encode(texts) == first and len(encoder.known) < 40


def test_documents(spark):
    rng = random.Random(5)
    words = "the of and ing tion house river 7 , .".split()
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300]))) for _ in range(60)]
    texts += [None, "", "same text", "same text", " ".join(["river"] * 900)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "same text", 0), (3, texts[3], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(docs, PATH, capacity=256).collect()
    tokenizer = Tokenizer.from_file(PATH)
    wanted = []
    for key, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            wanted.append((key, n, at, len(part), crc))
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    used = check_gapless([(r.sequence_id, r.offset, r.length) for r in got], 256)
    assert used <= -(-sum(r.length for r in got) // 256) + 1


def test_empty_table_and_rendered_sequences(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PATH).collect() == []
    docs = spark.createDataFrame([(1, "river house"), (2, None)], "doc_id long, text string")
    whole = packing.sequences(packing.pack_documents(docs, PATH, keep_ids=True)).collect()
    ids = Tokenizer.from_file(PATH).encode("river house", add_special_tokens=False).ids
    assert [sorted(r.ids) for r in whole] == [sorted([*ids, 0, 0])]
