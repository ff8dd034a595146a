"""De Bruijn graph of the word windows that start in two places or more, and its maximal nonbranching paths.

An edge is a window of k words that repeats, a node the k-1 words that two edges share. The steps:

1. ``repeated_edges``: all windows are dealt out by minimizer as runs (see ``windows``). A bucket finds its repeated
   edges and joins neighbours that follow each other at every place in the bucket to pieces.
2. ``measured``: each piece is looked up at its source coordinates; a digest of its words says which piece it is, its first
   and last k-1 words are its nodes. A piece whose words do not occur a second time is no repeat, whatever its hash said.
3. ``paths``: degrees of the nodes over the distinct pieces; pieces that meet in a node with one way in and one way out
   follow each other, and joins with doubled steps give each piece its path and its offset in it.
4. ``spans``: places of pieces are joined to their paths; pieces of one path at one diagonal of a document become one span.

A copy of a window within a slice of rows is compared with the first copy word by word and then does not travel, as it adds no
edge to the graph; the first copy carries whether it has one, and whether a neighbour of one differs from its own.

A minimizer is common if more than 1 / (SHARES * partitions) of all windows have it, so there are fewer than SHARES *
partitions of these. Their windows are dealt out one by one, by their own hashes, and meet their neighbours only as paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.llm import windows
from evalgrove.llm.common import settled, text_slices, written

#: What a row of windows is: to be found twice, known to have a copy in its slice, or such a copy (without hashes).
OPEN, HAS_COPY, COPY = 0, 1, 2
#: Further bits of a row with copies: the window after, or before, is not the same at all of them.
AFTER_VARIES, BEFORE_VARIES = 4, 8
DIGEST_BYTES = 16
#: A minimizer with more windows than a partition's even share over this number is common.
SHARES = 4


def offered(doc: pa.Array, h: pa.Array, owner, place, hashes, minimizers, words: list[bytes], word_at, window: int) -> pa.RecordBatch:
    """Rows for a slice of windows, in order: owner (row of doc and h), place, hash, minimizer and index of the first word."""
    import numpy as np

    breaks = place - np.arange(len(place))  # constant while starts go on by one
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order][1:] == hashes[order][:-1]
    group = np.concatenate([[0], np.cumsum(~equal)]) if len(order) else order
    first = np.zeros(len(hashes), np.int64)
    first[order] = order[np.flatnonzero(np.append(True, ~equal))][group] if len(order) else order
    on = (owner[1:] == owner[:-1]) & (breaks[1:] == breaks[:-1])
    after, before = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
    after[:-1][on], before[1:][on] = hashes[1:][on], hashes[:-1][on]
    copy = first != np.arange(len(hashes))
    for a, n in zip(*(x.tolist() for x in windows.runs(copy, owner, breaks, word_at[first] - word_at)), strict=True):
        p, q, size = int(word_at[a]), int(word_at[first[a]]), n + window - 1
        if words[p : p + size] != words[q : q + size]:
            copy[a : a + n] = False
    known = np.zeros(len(hashes), np.int64)
    known[first[copy]] = HAS_COPY
    known[first[copy & (after != after[first])]] |= AFTER_VARIES
    known[first[copy & (before != before[first])]] |= BEFORE_VARIES
    a, n = windows.runs(~copy, owner, minimizers, breaks, known)
    packed = windows.pack(hashes)
    size = windows.HASH_BYTES
    rows = [packed[size * x : size * (x + k)] for x, k in zip(a.tolist(), n.tolist(), strict=True)]
    b, m = windows.runs(copy, owner, breaks)
    at = np.concatenate([a, b])
    own = pa.array(owner[at])
    key = np.concatenate([minimizers[a].view(np.int64), windows.spread(h.take(pa.array(owner[b])), owner[b], place[b])])
    kind = np.concatenate([known[a], np.full(len(b), COPY, np.int64)])
    column = pa.array([*rows, *[None] * len(b)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key), doc.take(own), h.take(own), pa.array(kind), pa.array(place[at]), pa.array(np.concatenate([n, m])), column], windows.NAMES)


def _pieces(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of whole buckets, sorted by key, document and place: copies as they are, and repeated windows joined to pieces."""
    import numpy as np
    import pyarrow.compute as pc

    names = ["doc", "h", "at", "n", "kind"]
    is_copy = pc.equal(t.column("kind"), COPY)
    yield from t.filter(is_copy).select(names).to_batches()
    t = t.filter(pc.invert(is_copy)).combine_chunks()
    if not t.num_rows:
        return
    key, h, at, n, kind = (t.column(c).to_numpy() for c in ("key", "h", "at", "n", "kind"))
    codes = pc.dictionary_encode(t.column("doc"), null_encoding="encode").combine_chunks()
    doc = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        hashes = windows.unpack(t.column("hashes").to_pylist()) ^ (key.view(np.uint64)[row] * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    begins = np.flatnonzero(new)
    edge = np.empty(len(hashes), np.int64)
    edge[order] = np.cumsum(new) - 1
    often = np.diff(np.append(begins, len(hashes))) > 1
    often[edge[kind[row] & HAS_COPY > 0]] = True
    again = often[edge]
    goes_on = np.append((key[1:] == key[:-1]) & (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + n[:-1]), False)
    step = ((row[1:] == row[:-1]) | goes_on[row[:-1]]) & again[1:] & again[:-1]

    def only(neighbour, varies):
        """The neighbour that an edge has at all its places, or -1."""
        least, most = (f.reduceat(neighbour[order], begins) for f in (np.minimum, np.maximum))
        found = np.where(least == most, least, -1)
        found[edge[kind[row] & varies > 0]] = -1
        return found

    after, before = np.full(len(edge), -1), np.full(len(edge), -1)
    after[:-1][step], before[1:][step] = edge[1:][step], edge[:-1][step]
    linked = step & (only(after, AFTER_VARIES)[edge[:-1]] == edge[1:]) & (only(before, BEFORE_VARIES)[edge[1:]] == edge[:-1]) & (edge[1:] != edge[:-1])
    begin = again.copy()
    begin[1:] &= ~linked
    first, done = np.flatnonzero(begin), np.cumsum(again)
    if not len(first):
        return
    own = row[first]
    places = at[own] + first - (np.cumsum(n) - n)[own]
    taken = t.select(["doc", "h"]).take(pa.array(own)).combine_chunks()
    columns = [*(taken.column(c).chunk(0) for c in ("doc", "h")), pa.array(places), pa.array(np.diff(np.append(done[first] - 1, done[-1]))), pa.array(kind[own])]
    yield pa.RecordBatch.from_arrays(columns, names)


def heavy(hashes, minimizers, parts: int) -> pa.RecordBatch:
    """(key, n): minimizers with more than 1 / parts of a slice's distinct windows; with a null key, their total."""
    import numpy as np

    key, n = np.unique(minimizers[np.unique(hashes, return_index=True)[1]], return_counts=True)
    over = n * parts > n.sum()
    return pa.RecordBatch.from_arrays([pa.array([*key[over].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[over].tolist(), int(n.sum())], pa.int64())], ["key", "n"])


def common(sizes: DataFrame, parts: int) -> list[int]:
    """The common minimizers, from rows of ``heavy``; fewer than ``parts``.

    Any with more than twice that share of all windows is among them: slices where it is not heavy hold one share at most.
    """
    sums = written(sizes.groupBy("key").agg(F.sum("n").alias("n")))
    total = sums.filter("key is null").first()
    return [r.key for r in sums.filter(F.col("key").isNotNull() & (F.col("n") * parts > (total.n if total else 0))).select("key").collect()]


def divided(rows: DataFrame, keys: list[int]) -> DataFrame:
    """Rows of ``offered``, those of ``keys`` cut into windows with keys of their own; equal windows keep equal keys."""
    if not keys:
        return rows
    listed = rows.sparkSession.createDataFrame([(k, True) for k in keys], "key bigint, common boolean")
    each = F.when(F.col("common") & F.col("hashes").isNotNull(), F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).otherwise(F.array(F.lit(None).cast("int")))
    cut = rows.join(F.broadcast(listed), "key", "left").select(*rows.columns, F.explode(each).alias("i"))
    own = F.substring("hashes", F.col("i") * windows.HASH_BYTES + 1, F.lit(windows.HASH_BYTES))
    whole = F.col("i").isNull()
    new = {"key": F.xxhash64(own), "at": F.col("at") + F.col("i"), "n": F.lit(1).cast("long"), "hashes": own}
    return cut.select(*[F.when(whole, F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in rows.columns])


def repeated_edges(rows: DataFrame, keys: list[int]) -> DataFrame:
    """(doc, h, at, n, kind): pieces of repeated windows, from rows of ``offered`` and the ``common`` minimizers. One shuffle, by minimizer."""
    out = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), *[T.StructField(c, T.LongType()) for c in ("h", "at", "n", "kind")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in windows.buckets(batches):
            yield from _pieces(table)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return divided(rows, keys).repartition(n, "key").sortWithinPartitions("key", "h", "doc", "at").mapInArrow(run, out)


def measured(texts: DataFrame, found: DataFrame, window: int, split: Callable[[str | None], list[bytes]]) -> DataFrame:
    """(doc, h, at, n, weight, id, head, tail): pieces with their words' digest and nodes. ``texts`` has doc, h and t.

    Weight: places of the piece, one more for a copy in its slice.
    """
    merged = found.filter(F.col("kind") != COPY).groupBy("doc", "h", "at", "n").agg(F.sum(F.col("kind").bitwiseAND(HAS_COPY) + 1).alias("weight"))
    listed = merged.groupBy("doc", "h").agg(F.collect_list(F.struct("at", "n", "weight")).alias("pieces")).withColumnsRenamed({"doc": "__doc", "h": "__h"})
    joined = texts.join(listed, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("h") == F.col("__h"))).select("doc", "h", "t", "pieces")
    longs = [T.StructField(c, T.LongType()) for c in ("h", "at", "n", "weight", "head", "tail")]
    out = T.StructType([T.StructField("doc", texts.schema["doc"].dataType), *longs, T.StructField("id", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in text_slices(batches, "t"):
            owner, values, ids = [], [], []
            for row, (text, pieces) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = split(text)
                for p in pieces:
                    span = words[p["at"] : p["at"] + p["n"] + window - 1]
                    ends = (xxhash.xxh64_intdigest(b" ".join(x)) for x in (span[: window - 1], span[len(span) - window + 1 :]))
                    owner.append(row)
                    values.append((p["at"], p["n"], p["weight"], *ends))
                    ids.append(hashlib.sha256(b" ".join(span)).digest()[:DIGEST_BYTES])
            own = pa.array(owner, pa.int64())
            numbers = [pa.array(np.array([v[k] for v in values], np.uint64).view(np.int64)) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *numbers, pa.array(ids, pa.binary())], out.names)

    return joined.mapInArrow(run, out)


def paths(pieces: DataFrame) -> DataFrame:
    """(id, path, offset, n): each distinct piece that repeats, the piece that begins its path, and the edges before it.

    A node is passed through if one piece ends and one begins there. Each round joins a piece to the piece its pointer names
    and takes over that one's pointer; rounds grow with the logarithm of the pieces in a path. Pieces on a ring without a
    beginning stay paths of their own.
    """
    edges = written(pieces.groupBy("id").agg(F.sum("weight").alias("weight"), *[F.max(c).alias(c) for c in ("n", "head", "tail")]).filter("weight > 1"))
    ends = edges.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("into"), F.max("id").alias("prev"), F.max("n").alias("prev_n"))
    starts = edges.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("out"), F.max("id").alias("id"))
    passed = ends.join(starts, "node").filter("into = 1 and out = 1 and prev != id").select("id", "prev", "prev_n")
    state = settled(
        edges.join(passed, "id", "left").select("id", "n", F.coalesce("prev", "id").alias("path"), F.coalesce("prev_n", F.lit(0)).alias("offset"), F.col("prev").isNull().alias("done")),
        edges,
    )
    left = state.filter("not done").count()
    while left:
        to = state.select(F.col("id").alias("path"), F.col("path").alias("next"), F.col("offset").alias("more"), F.col("done").alias("ended"))
        moved = state.filter("not done").join(to, "path").select("id", "n", F.col("next").alias("path"), (F.col("offset") + F.col("more")).alias("offset"), F.col("ended").alias("done"))
        state = settled(state.filter("done").unionByName(moved), state)
        rest = state.filter("not done").count()
        if rest == left:
            break
        left = rest
    return state.select("id", "n", F.when(F.col("done"), F.col("path")).otherwise(F.col("id")).alias("path"), F.when(F.col("done"), F.col("offset")).otherwise(0).alias("offset"))


def spans(pieces: DataFrame, of_paths: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, h, spans): for each document the spans (at, n) of repeated windows; at most as many as it has windows."""
    placed = pieces.select("doc", "h", "at", "n", "id").join(of_paths.select("id", "path", "offset"), "id")
    span = F.struct("at", "n")
    diagonals = placed.groupBy("doc", "h", "path", (F.col("at") - F.col("offset")).alias("diagonal")).agg(F.collect_set(span).alias("own"), F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("end"))
    covered = F.aggregate("own", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    whole = diagonals.select("doc", "h", F.when(covered == F.col("end") - F.col("at"), F.array(F.struct("at", (F.col("end") - F.col("at")).alias("n")))).otherwise(F.col("own")).alias("some"))
    copies = found.filter(F.col("kind") == COPY).groupBy("doc", "h", "at").agg(F.max("n").alias("n")).select("doc", "h", F.array(span).alias("some"))
    return whole.unionByName(copies).groupBy("doc", "h").agg(F.flatten(F.collect_list("some")).alias("spans"))
