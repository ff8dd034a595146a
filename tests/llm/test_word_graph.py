"""The graph's paths against the maximal nonbranching paths of a graph held in memory."""

import random
from collections import Counter

import pytest

from evalgrove.llm import substring_dedup, word_graph

K = 6


def texts():
    rng = random.Random(5)

    def word(n):
        return [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(n)]

    a, b, c = word(90), word(40), word(25)
    rows = [a, a, a + word(9), word(7) + a[:50] + b, b + c, word(4) + c + a[30:70], b[:20] + word(3) + b[24:], a[10:60] + c + c, ["x", "y"] * 30, ["x", "y"] * 20 + word(8), word(50), [], word(K - 1)]
    return [" ".join(x) for x in rows]


def plain(rows):
    """Edges in each maximal nonbranching path, rings left out; and the number of edges on rings."""
    count = Counter(tuple(w[k : k + K]) for w in (t.split() for t in rows) for k in range(len(w) - K + 1))
    edges = [e for e, n in count.items() if n > 1]
    into, out = Counter(e[1:] for e in edges), Counter(e[:-1] for e in edges)
    follows = {e[:-1]: e for e in edges}

    def through(node):
        return into[node] == 1 and out[node] == 1

    lengths, seen = [], set()
    for e in edges:
        if not through(e[:-1]):
            path = [e]
            while through(path[-1][1:]):
                path.append(follows[path[-1][1:]])
            lengths.append(len(path))
            seen |= set(path)
    return sorted(lengths), len(edges) - len(seen)


@pytest.mark.parametrize(("slices", "shares"), [(1, word_graph.SHARES), (5, word_graph.SHARES), (5, 10**9)])
def test_paths_are_the_maximal_nonbranching_ones(spark, monkeypatch, slices, shares):
    monkeypatch.setattr(word_graph, "SHARES", shares)  # the last: every minimizer is common
    rows = texts()
    want, on_rings = plain(rows)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id bigint, text string").repartition(slices)
    _, pieces = substring_dedup.pieces_found(df, window=K, gram=3)
    found = word_graph.paths(pieces).collect()
    assert {bytes(r.id) for r in found} <= {bytes(r.id) for r in pieces.collect()}
    got = Counter()
    for r in found:
        got[bytes(r.path)] += r.n
    lengths = sorted(got.values())
    assert sum(lengths) - sum(want) == on_rings
    assert Counter(want) - Counter(lengths) == Counter()
    assert max(want) > 20  # paths go across buckets
