"""SimHash near-dedup: 64-bit fingerprints, a binary-trie self-join, and connected components.

Fingerprints: A-Z lower-cased, words of the whole text, word shingles joined by a space (a shorter
text is one shingle; no words: fingerprint zero), XXH64 with seed 42; a bit is set if it is set in
over half of the shingles' hashes.

Join: equal fingerprints are merged first, so copies cost one row. Two fingerprints that differ in at
most ``bits`` places agree in at least one of ``bits`` + 1 blocks, so each fingerprint goes once to the
trie of each block, rotated so that this block comes first. A task holds whole subtrees below a block
value. The self-join starts with each subtree against itself and goes down one bit at a time for
all pairs of nodes together; a pair of unlike children costs one bit, and a pair beyond the budget
is dropped. Pairs that reach the leaves become links; a task merges its links and emits a forest, fewer
links than fingerprints. A block value with more than ``HOT`` fingerprints is dealt out again by
combinations of blocks of the remaining bits, of which all but ``bits`` must agree, so a task never
needs more than 2 ** 17 fingerprints of one group.

Components: alternating star contraction on the forest, in DataFrames, with reliable checkpoints.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated
rows and repeated doc_ids give one result row each; a null doc_id never becomes a component's id, and
a component of null doc_ids only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.llm.common import durable, text_slices

BITS = 2
SHINGLE = 3
#: Fingerprints below one block value, above which the group is dealt out by a second choice of blocks (at least; it grows with their number).
HOT = 1_000
#: Pairs of nodes taken down at once.
PAIRS = 1 << 18
_CHUNK = 1 << 17


def _fingerprint(text: str | None, size: int, hasher) -> int:
    import numpy as np

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), 0
    count = max(1, len(words) - size + 1)
    for start in range(0, count, _CHUNK):
        part = words[start : start + _CHUNK + size - 1]
        if len(words) < size:
            shingles = [b" ".join(words)]
        else:
            shingles = list(map(b" ".join, zip(*(part[k : len(part) - size + 1 + k] for k in range(size)), strict=True)))
        hashes = np.fromiter(map(hasher, shingles), np.uint64, len(shingles))
        for k in range(0, len(hashes), 1 << 14):
            total += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(shingles)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, h, fp): hash and fingerprint of each whole text, as signed longs."""
    schema = T.StructType([df.select(key).schema.fields[0], T.StructField("h", T.LongType(), False), T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest
        hasher = lambda b: digest(b, 42)
        for batch in text_slices(batches, "t"):
            found = np.array([_fingerprint(t, size, hasher) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], [key, "h", "fp"])

    return df.select(F.col(key), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def trie_links(values, prefix: int, bits: int = BITS):
    """Forest of links between values (sorted, distinct, unsigned 64-bit) that agree in the first ``prefix`` bits and differ in at most ``bits`` others.

    Returns two index arrays: a value and the one it is linked to.
    """
    import numpy as np

    n = len(values)
    parent = np.arange(n)

    def join(a, b):
        while len(a):
            ra, rb = parent[a], parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := parent[parent], parent):
                parent[:] = up

    top = values >> np.uint64(64 - prefix)
    start = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1]) if n else np.zeros(0, np.int64)
    stop = np.append(start[1:], n)
    shared = stop - start > 1
    start, stop = start[shared], stop[shared]
    ones: dict[int, object] = {}  # running count of set bits, by level
    todo = [(64 - prefix, start, stop, start, stop, np.zeros(len(start), np.int64))]
    while todo:
        left, a0, a1, b0, b1, cost = todo.pop()
        if not len(a0):
            continue
        if len(a0) > PAIRS:
            half = len(a0) // 2
            todo += [(left, *(x[:half] for x in (a0, a1, b0, b1, cost))), (left, *(x[half:] for x in (a0, a1, b0, b1, cost)))]
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            a, b = a0[leaf], b0[leaf]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= bits)
            join(a[near], b[near])
            a0, a1, b0, b1, cost = (x[~leaf] for x in (a0, a1, b0, b1, cost))
        if not left or not len(a0):
            continue
        level = left - 1
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((values >> np.uint64(level)) & np.uint64(1), dtype=np.int64)])
        count = ones[level]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = (a0 == b0) & (a1 == b1)
        unlike = cost < bits
        parts = [(a0, am, b0, bm, cost, None), (am, a1, bm, b1, cost, None), (a0, am, bm, b1, cost + 1, unlike), (am, a1, b0, bm, cost + 1, unlike & ~same)]
        kept = []
        for x0, x1, y0, y1, c, ok in parts:
            take = (x1 > x0) & (y1 > y0) & ~((x0 == y0) & (x1 - x0 == 1))
            take = take if ok is None else take & ok
            kept.append([v[take] for v in (x0, x1, y0, y1, c)])
        todo.append((level, *map(np.concatenate, zip(*kept, strict=True))))
    linked = np.flatnonzero(parent != np.arange(n))
    return linked, parent[linked]


def _rotated(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _links(rows: DataFrame) -> DataFrame:
    """rows (grp, turned, width, fp), grouped by grp in sorted partitions -> forest links (u, v) of fingerprints."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            us, vs = [], []
            kind, turned, width, fp = (t.column(c).to_numpy() for c in ("kind", "turned", "width", "fp"))
            for k in np.unique(kind):
                of = np.flatnonzero(kind == k)
                order = of[np.argsort(turned[of].view(np.uint64), kind="stable")]
                a, b = trie_links(turned[order].view(np.uint64), int(width[order[0]]), BITS)
                us.append(fp[order[a]])
                vs.append(fp[order[b]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= 1 << 20:  # up to where the last group of this batch begins
                kind, top = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                edge = np.flatnonzero((kind[1:] != kind[:-1]) | (top[1:] != top[:-1]))
                if len(edge):
                    cut = int(edge[-1]) + 1
                    yield flush([*held, batch.slice(0, cut)])
                    held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield flush(held)

    return rows.mapInArrow(run, schema)


def _by_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Each fingerprint once for each block: kind, top (the block's value), turned, width, fp."""
    blocks = bits + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    copies = [F.struct(F.lit(k).alias("kind"), F.shiftrightunsigned(_rotated(F.col("fp"), edges[k]), 64 - (edges[k + 1] - edges[k])).alias("top"), _rotated(F.col("fp"), edges[k]).alias("turned"), F.lit(edges[k + 1] - edges[k]).alias("width"), F.col("fp")) for k in range(blocks)]
    return nodes.select(F.explode(F.array(*copies)).alias("x")).select("x.*")


def _redealt(rows: DataFrame, bits: int, parts: int = 5) -> DataFrame:
    """Rows of hot groups by choices of ``parts`` - ``bits`` of the ``parts`` blocks of their other bits: kind, top, turned, width, fp."""
    first = [64 * k // (bits + 1) for k in range(bits + 2)]
    found = []
    for kind in range(bits + 1):
        width = first[kind + 1] - first[kind]
        edges = [width + (64 - width) * k // parts for k in range(parts + 1)]
        for at, chosen in enumerate(combinations(range(parts), parts - bits)):
            front = F.col("top")
            for k in [*chosen, *(k for k in range(parts) if k not in chosen)]:
                size = edges[k + 1] - edges[k]
                piece = F.shiftrightunsigned(F.shiftleft("turned", edges[k]), 64 - size)
                front = F.shiftleft(front, size).bitwiseOR(piece)
            wide = width + sum(edges[k + 1] - edges[k] for k in chosen)
            found.append(F.when(F.col("kind") == kind, F.struct(F.lit(100 * (kind + 1) + at).alias("kind"), F.shiftrightunsigned(front, 64 - wide).alias("top"), front.alias("turned"), F.lit(wide).alias("width"), F.col("fp"))))
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*")


def links(nodes: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Forest links (u, v) that connect every two distinct fingerprints of ``nodes`` (fp) within ``bits`` bits."""
    dealt = _by_blocks(nodes, bits)
    hot = max(hot, nodes.count() >> 17)  # far above the mean of a block value
    sizes = dealt.groupBy("kind", "top").count().filter(F.col("count") > hot).select("kind", "top", F.lit(True).alias("hot"))
    tagged = dealt.join(sizes, ["kind", "top"], "left")
    again = _redealt(tagged.filter("hot"), bits)
    rows = tagged.filter("hot IS NULL").drop("hot").unionByName(again)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("kind", "top", "turned", "width", "fp").repartition(n, "kind", "top").sortWithinPartitions("kind", "top")
    return _links(rows)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component. Alternating star contraction."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = durable(edges.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x")).select("x.*")
        edges = durable(small.filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(df: DataFrame, key: str, text: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """(key, h, fp) of each row, and (fp, root, least key) of each fingerprint."""
    found = durable(fingerprints(df, key, text))
    nodes = durable(found.groupBy("fp").agg(F.min(key).alias("least")))
    linked = components(links(nodes.select("fp"), bits))
    return found, nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key that is reachable over links of at most ``bits`` bits."""
    found, rooted = _rooted(df, key, text, bits)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select(key, "fp", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each component: that with the smallest key (null last), ties by the text's hash; all columns as they are."""
    found, rooted = _rooted(df, key, text, bits)
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "h")
    first = found.groupBy("fp").agg(F.min(rank).alias("x"))  # one row of each fingerprint before the join
    kept = first.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.k").alias("__k"), F.col("x.h").alias("__h"))
    rows = df.withColumn("__own", F.xxhash64(F.col(text)))
    rows = rows.join(kept, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__own") == F.col("__h")), "left_semi")
    if not found.groupBy(key, "h").count().filter("count > 1").isEmpty():  # the same key and text more than once
        rows = rows.dropDuplicates([key, "__own"])
    return rows.drop("__own")
