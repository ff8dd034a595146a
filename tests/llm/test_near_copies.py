"""The pipeline's near copies against brute force over all pairs."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalgrove.llm import near_copies
from evalgrove.llm.common import shared_folder
from tests.llm.test_small import SCHEMA, docs, none, words  # noqa: F401


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def kept(rows):
    """Keys of the rows that stay, for distinct keys: the smallest of each component."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                group[max(find(a), find(b))] = min(find(a), find(b))
    return [r[0] for k, r in enumerate(rows) if find(k) == k]


def test_stage_drops_near_copies_beyond_two_bits(spark):
    base, rows = words(200, 1).split(), []
    for k in range(12):  # one word changed in each: similarity of about 0.9 to the first, 0.8 or less to each other
        rows.append((k, " ".join(base[:at] + [f"w{k}"] + base[at + 1 :]) if (at := 15 * k) else " ".join(base)))
    chain = words(100, 2).split()
    rows += [(100 + k, " ".join(chain[6 * k : 6 * k + 60])) for k in range(5)] + [(200 + k, words(60, 50 + k)) for k in range(5)] + [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE")]
    df = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == kept(rows) and not set(range(1, 12)) & set(got)


def test_near_copies_of_odd_rows(docs, none):  # noqa: F811
    out = near_copies.keep_first(docs)
    assert out.columns == docs.columns and near_copies.keep_first(none).count() == 0
    got = [r.doc_id for r in out.collect()]
    assert sorted(got, key=str) == sorted([0, 3, 4, 7, 8, 9, None, 10, 11, 12, 13], key=str)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_near_copies_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in near_copies.keep_first(df).collect()) == kept(rows)


def test_fingerprints_and_trees(spark):
    """Five-word fingerprints as a plain sum of votes; texts share a bucket if links of a trie connect them, else not."""
    rows = [(k, words(60, k)) for k in range(20)]
    rows += [(100 + k, f"{t} tail{k}") for k, t in rows[:10]] + [(200, None), (201, ""), (202, "one"), (203, "x y " * 700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    own = near_copies.shingles("x y " * 700)
    assert len(own) == 1396 and len(set(own.tolist())) == 2
    found = near_copies.prints(df, "doc_id", "text").cache()
    got = {r.k: [x % 2**64 for x in r.prints] for r in found.collect()}
    flip = np.random.default_rng(11).integers(0, 1 << 63, 2 * near_copies.PRINTS, np.uint64)
    for i, t in rows:
        values = np.unique(near_copies.shingles(t))
        for k in range(near_copies.PRINTS):
            large, small = ([int(x) for x in near_copies._mixed(values ^ f)] for f in flip[2 * k : 2 * k + 2])
            sums = [sum(4 * (a >> b & 1) + 2 * (c >> b & 1) - 3 for a, c in zip(large, small, strict=True)) for b in range(64)]
            assert got[i][k] == sum(1 << b for b in range(64) if sums[b] > 0)
    nodes = found.groupBy("h").agg(F.first("prints").alias("prints")).cache()
    texts = {r.h: [x % 2**64 for x in r.prints] for r in nodes.collect()}
    turned = lambda x, by: (x << by | x >> (64 - by)) % 2**64 >> (64 - near_copies.WIDTH)
    want = set()
    for kind in range(near_copies.PRINTS * len(near_copies.TURNS)):
        k, by = kind // len(near_copies.TURNS), near_copies.TURNS[kind % len(near_copies.TURNS)]
        group = {h: h for h in texts}
        for _ in range(3):
            for a in texts:
                for b in texts:
                    if turned(texts[a][k], by) == turned(texts[b][k], by) and (texts[a][k] ^ texts[b][k]).bit_count() <= near_copies.BITS:
                        group[a] = group[b] = min(group[a], group[b])
        trees = [frozenset(h for h in group if group[h] == g) for g in set(group.values())]
        want |= {(kind, t) for t in trees if len(t) > 1}
    shared = near_copies.trees(nodes).groupBy("kind", "b").agg(F.collect_set("h").alias("hs")).collect()
    assert {(r.kind, frozenset(r.hs)) for r in shared} == want and want


def test_near_copies_come_from_the_tries(spark):
    base = words(200, 3).split()
    rows = [(k, " ".join([*base[: 15 * k], f"w{k}", *base[15 * k + 1 :]])) for k in range(1, 6)] + [(9, words(200, 4)), (10, words(200, 4))]
    df = spark.createDataFrame([(0, " ".join(base)), *rows], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_copies.keep_first(df).collect()) == [0, 9]
    assert sorted(r.doc_id for r in near_copies.keep_first(df, bits=-1).collect()) == [0, 1, 2, 3, 4, 5, 9]  # no links but equal texts


def test_all_pairs_share_a_bucket(spark):
    """No pair of a similarity of 0.8 or more is left to another pair's links."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {}
    for r in df.collect():
        rows.setdefault(r.text, frozenset(shingles(r.text)))
    sets, pairs = list(rows.items()), set()
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                pairs.add(frozenset((sets[a][0], sets[b][0])))
    nodes = near_copies.prints(df.distinct(), "doc_id", "text").groupBy("h").agg(F.first("prints").alias("prints"))
    texts = {r.h: r.text for r in df.select(F.xxhash64("text").alias("h"), "text").collect()}
    found = {frozenset((texts[a], texts[b])) for r in near_copies.trees(nodes).groupBy("kind", "b").agg(F.collect_set("h").alias("hs")).collect() for a in r.hs for b in r.hs if a != b}
    assert pairs and pairs <= found


def test_chance_links_cost_no_sets_and_spent_tables_go(spark, monkeypatch):
    base = words(200, 5).split()
    like = [(k, " ".join([*base[: 15 * k], f"w{k}", *base[15 * k + 1 :]])) for k in range(1, 6)]
    df = spark.createDataFrame(like + [(100 + k, words(60, 100 + k)) for k in range(200)], "doc_id bigint, text string")
    made, sets = [], near_copies._sets
    monkeypatch.setattr(near_copies, "_sets", lambda rows: made.append({r.h for r in rows.select("h").collect()}) or sets(rows))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("evalgrove-*"))
    out = near_copies.keep_first(df, bits=40)  # nearly all pairs below a block value are linked
    assert made == [{r.h for r in df.filter("doc_id < 100").select(F.xxhash64("text").alias("h")).collect()}]
    assert len(set(folder.glob("evalgrove-*")) - before) == 1  # the keys that stay
    assert sorted(r.doc_id for r in out.collect()) == [1, *range(100, 300)]


@pytest.mark.parametrize("pairs", [3, 1 << 15])
def test_texts_without_a_like_sketch_leave_a_bucket(spark, monkeypatch, pairs):
    monkeypatch.setattr(near_copies, "PAIRS", pairs)
    draw, rows = np.random.default_rng(1), []
    for b in range(20):
        bits = draw.integers(0, 2, (12, 64 * near_copies.PRINTS))
        for k in draw.permutation(12)[: b % 10]:  # like one of the others, by chance in chains
            bits[k] = np.where(draw.random(bits.shape[1]) < 0.2, 1 - bits[k - 1], bits[k - 1])
        found = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        rows += [(b, 0, 100 * b + k, 100 * b + k, found[k].view(np.int64).tolist()) for k in range(12)]
    like = {r[3]: {q[3] for q in rows if q[0] == r[0] and q[3] != r[3] and sum(((x ^ y) % 2**64).bit_count() for x, y in zip(r[4], q[4], strict=True)) <= near_copies.UNLIKE} for r in rows}
    got = near_copies._alike(spark.createDataFrame(rows, "b bigint, kind int, c bigint, h bigint, prints array<bigint>")).collect()
    assert sorted(r.h for r in got) == sorted(h for h in like if like[h]) and len(got) < len(rows)
    assert all(r.to in like[r.h] for r in got if r.to is not None)
    named = {r.h for r in got if r.to is not None} | {r.to for r in got}
    assert named >= {h for h in like if like[h]}  # each has a pair
