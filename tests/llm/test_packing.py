import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from siteloom.llm.packing import best_pattern, pack, plan, ranked, solve, tokenizer_path

from .helpers import documents, odd_texts, prose


def test_every_id_once_and_no_gaps(spark):
    texts = odd_texts() + [prose(i, 10 + i * 3) for i in range(150)]
    docs = documents(spark, texts, extra=True)
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    got = pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 1024 - at
    assert padding < 0.03 * sum(map(len, ids.values()))


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, odd_texts())
    one, two = pack(docs).count(), pack(docs.unionByName(docs)).count()
    assert two == 2 * one and pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("per_task", [1, 7, 10_000])
def test_ranks_have_no_gaps(spark, per_task):
    rows = [(i, 0, i * 7, 3 if i % 10 else i % 4) for i in range(500)] + [(5, 0, 35, 3)] * 4
    got = defaultdict(list)
    for r in ranked(spark.createDataFrame(rows, "doc_id long, start long, ids_crc32 long, class int"), len(rows), per_task).collect():
        got[r["class"]].append(r["rank"])
    assert sum(map(len, got.values())) == len(rows) and all(sorted(own) == list(range(len(own))) for own in got.values())


def test_plan_places_every_rest_once():
    r = random.Random(2)
    for n in (1, 7, 300, 20_000):
        histogram = defaultdict(int)
        for _ in range(n):
            histogram[min(64, int(r.expovariate(1 / 25)) + 1)] += 1
        used = defaultdict(set)
        for x, slots in plan(dict(histogram), 64).items():
            assert slots == sorted(slots) and slots[0][0] == 0
            ends = [s[0] for s in slots[1:]] + [histogram[x]]
            for (first, sequence, each, at), end in zip(slots, ends):
                for k in range(end - first):
                    place = set(range(at + k % each * x, at + k % each * x + x))
                    q = sequence + k // each
                    assert not place & used[q] and max(place) < 64
                    used[q] |= place
        total = sum(x * k for x, k in histogram.items())
        assert sum(map(len, used.values())) == total
        if n == 20_000:
            assert len(used) <= 1.01 * total / 64 + 1


def test_knapsack_against_brute_force():
    lengths, value = np.array([3, 4, 5]), np.array([0.31, 0.42, 0.49])
    best, counts = best_pattern(value, lengths, 11)
    ways = [(a, b, c) for a in range(4) for b in range(3) for c in range(3) if 3 * a + 4 * b + 5 * c <= 11]
    assert abs(best - max(np.dot(w, value) for w in ways)) < 1e-9 and counts @ lengths <= 11 and abs(counts @ value - best) < 1e-9


def test_program_reaches_the_bound():
    found = solve(np.array([3, 5, 7]), np.array([100.0, 100.0, 100.0]), 15)
    assert abs(sum(a for _, a in found) - 100) < 0.2
