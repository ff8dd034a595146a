"""Suffix arrays and longest previous factors against plain versions, and the registered query at its own length."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from evalgrove.llm import suffix_dedup
from evalgrove.llm.queries import QUERIES


def strings(seed):
    rng = random.Random(seed)
    made = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(6)]
    return [*made, made[0] + b"x" + made[1], b"", b"ab" * 40, bytes(range(256)), b"ab" * 33]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_order_and_common_prefixes(seed):
    symbols, begin, left = suffix_dedup.joined(strings(seed))
    order, ranks = suffix_dedup.suffixes(symbols, 64)
    plain = [tuple(symbols[k : k + min(64, left[k])]) for k in range(len(symbols))]  # up to the end of the string
    assert [plain[k] for k in order] == sorted(plain) and sorted(order.tolist()) == list(range(len(symbols)))
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(symbols), 500), rng.integers(0, len(symbols), 500)
    a, b = np.concatenate([a, order[1:]]), np.concatenate([b, order[:-1]])
    got = suffix_dedup.common_prefix(symbols, ranks, a, b)
    for x, y, n in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        want = next((k for k in range(len(symbols)) if x + k >= len(symbols) or y + k >= len(symbols) or symbols[x + k] != symbols[y + k]), 0) if x != y else 64
        inside = min(64, left[x], left[y])
        assert min(n, inside) == min(want, inside)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("length", [4, 10, 16, 25])
def test_longest_previous_factors(seed, length):
    texts = strings(seed)
    symbols, begin, left = suffix_dedup.joined(texts)
    floor = suffix_dedup.floor_of(length)
    starts = np.flatnonzero(left >= floor)
    at = [(t, k) for t, x in enumerate(texts) for k in range(len(x) - floor + 1)]
    start, match, shared = suffix_dedup.previous_factors(symbols, left, starts, length)
    best = {}
    for s, m, n in zip(start.tolist(), match.tolist(), shared.tolist(), strict=True):
        assert m < s
        best[s] = max(best.get(s, 0), n)
    for k, s in enumerate(starts.tolist()):
        t, i = at[k]
        own = texts[t][i:]
        common = lambda x: next((j for j, (a, b) in enumerate(zip(own, x, strict=False)) if a != b), min(len(own), len(x)))
        want = max((common(texts[u][j:]) for u, j in at[:k]), default=0)
        assert min(best.get(s, 0), length) == (min(want, length) if want >= floor else 0)


def test_smaller_values_before():
    rng = np.random.default_rng(3)
    for values in (rng.permutation(200), np.arange(200)[::-1], np.arange(200)):
        group = np.sort(rng.integers(0, 9, 200))
        got = suffix_dedup.smaller_before(values, group)
        for i in range(200):
            assert got[i] == max((j for j in range(i) if group[j] == group[i] and values[j] < values[i]), default=-1)


def test_query_equals_brute_force_over_all_documents(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    raws = {i: (t or "").encode() for i, t in rows}
    masks = {}
    for n in (256, 400):
        once, twice = set(), set()
        names = {i: [hash(x[k : k + n]) for k in range(len(x) - n + 1)] for i, x in raws.items()}
        for own in names.values():
            for h in own:
                (twice if h in once else once).add(h)
        for i, own in names.items():
            edge = np.zeros(len(raws[i]) + 1, int)
            for k, h in enumerate(own):
                if h in twice:
                    edge[k] += 1
                    edge[k + n] -= 1
            masks[i, n] = np.cumsum(edge[:-1]) > 0
    want = []
    for i, x in raws.items():
        gone = masks[i, 400]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest(), int(masks[i, 256].sum())))
    assert sorted(tuple(r) for r in QUERIES["op7_suffix_array_dedup"](spark, "/root/testdata/sf0.01").collect()) == sorted(want)
