"""Exact vector retrieval (K1, K2, W1, J6, J9, J10, V4) and what is measured on it.

Queries are taken in blocks of ``BLOCK``; a block is a matrix of bounded size that goes to every task. A task
multiplies it with its vectors, a tile of ``TILE`` scores at a time, and keeps its own k best for each query, so what it
holds does not depend on the number of vectors and what is shuffled is k rows a query and task, not a row for each
pair. Scores are rounded to 9 places before they are ranked, ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalgrove.functions import text as fn
from evalgrove.functions import vector as fv

BLOCK = 2_048
#: Queries and vectors whose scores are held at a time.
TILE = (256, 2_048)
#: Of ``near_pairs``: numbers of a group's vectors, and vectors of a side of a tile.
GROUP, PAIRS = 1 << 22, 1_024
PLACES = 9


def _matrix(column: pa.Array):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[list]:
    """Query rows, a block at a time."""
    held = []
    for row in queries.select(key, vector).orderBy(key).toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def _keep_best(held, score, own, s) -> None:
    """Puts into held (ids) and score, best first, what is best of them and of the scores s of the vectors own; -inf is no score."""
    import numpy as np

    k = score.shape[1]
    least = score[:, -1]
    if s.shape[1] > k and not np.isfinite(least).all():
        least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
    i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    if not len(i):
        return
    x, y = np.nonzero(score > -np.inf)
    row, id_, value = np.concatenate([x, i]), np.concatenate([held[x, y], own[j]]), np.concatenate([score[x, y], s[i, j]])
    order = np.lexsort((id_, -value, row))
    row, id_, value = row[order], id_[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    ok = place < k
    score[:] = -np.inf
    held[row[ok], place[ok]], score[row[ok], place[ok]] = id_[ok], value[ok]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 4, key: str = "vec_id", vector: str = "embedding", cosine: bool = False, exclude_self: bool = True) -> DataFrame:
    """(query_id, idx, score, rank) of the k best vectors of each query."""
    import numpy as np

    found = None
    schema = "query_id bigint, idx bigint, score double"
    for block in _blocks(queries.filter(F.col(vector).isNotNull()), key, vector):
        ids = np.array([r[0] for r in block])
        q = np.array([r[1] for r in block], np.float64)
        if cosine:
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = queries.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            held, score = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)
            for batch in (b.slice(at, TILE[1]) for b in batches for at in range(0, b.num_rows, TILE[1])):
                own, m = batch.column(0).to_numpy(), _matrix(batch.column(1))
                if cosine:
                    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                for at in range(0, len(ids), TILE[0]):
                    rows = slice(at, at + TILE[0])
                    s = q[rows] @ m.T
                    np.round(s, PLACES, out=s)
                    s[~np.isfinite(s)] = -np.inf
                    if exclude_self:
                        s[ids[rows, None] == own] = -np.inf
                    _keep_best(held[rows], score[rows], own, s)
            ok = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(ok.shape)[ok]), pa.array(held[ok]), pa.array(score[ok])], ["query_id", "idx", "score"])

        part = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), vector).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], schema)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "idx")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def with_articles(hits: DataFrame, articles: DataFrame, key: str = "idx") -> DataFrame:
    """Hits with the article's own columns."""
    return hits.join(articles, key)


def hit_at_k(hits: DataFrame, relevant: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, hit, reciprocal_rank) for each query of relevant (query_id, idx), zero where none is found."""
    good = hits.filter(F.col("rank") <= k).join(relevant, ["query_id", "idx"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    every = relevant.select("query_id").distinct()
    return every.join(good, "query_id", "left").select("query_id", F.col("first").isNotNull().alias("hit"), F.coalesce(F.try_divide(F.lit(1.0), F.col("first").cast("double")), F.lit(0.0)).alias("reciprocal_rank"))


def build_context(hits: DataFrame, articles: DataFrame, key: str = "idx") -> DataFrame:
    """(query_id, context) from hits and articles (idx, title, content); k lines a query."""
    rows = hits.join(articles, key)
    return rows.groupBy("query_id").agg(fn.context(F.collect_list(F.struct("rank", "title", "content"))).alias("context"))


def _normalised(batch: pa.RecordBatch, which, size: int) -> Iterator[tuple]:
    """(ids, unit vectors) of the rows ``which`` of (id, v), at most ``size`` at a time."""
    import numpy as np

    ids, m = batch.column("id").to_numpy()[which], _matrix(batch.column("v"))[which]
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for at in range(0, len(ids), size):
        yield ids[at : at + size], m[at : at + size]


def near_pairs(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", blocks: int = 8) -> DataFrame:
    """(a, b, score) with a < b and cosine above the threshold; exact.

    Vectors are dealt to ``blocks`` groups, or to more, so that a group has about ``GROUP`` numbers at most; a task
    compares two groups, a tile of ``PAIRS`` x ``PAIRS`` scores at a time, and gives pairs away as it finds them. Work
    grows with the square of the vectors, as exact comparison does, and so does what is shuffled beyond 8 x ``GROUP``
    numbers.
    """
    import numpy as np

    own = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    blocks = max(blocks, -(-(own.agg(F.sum(F.size("v"))).first()[0] or 0) // GROUP))
    own = own.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("g", o).alias("x"), F.greatest("g", o).alias("y")))
    dealt = own.withColumn("cell", F.explode(F.array_distinct(cells))).select("cell.*", "g", "id", "v")

    def compare(cell: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = (c.as_py() for c in cell)
        tiles = {x: [], y: []}
        for batch in batches:
            g = batch.column("g").to_numpy()
            for side, held in tiles.items():
                held += _normalised(batch, np.flatnonzero(g == side), PAIRS)
        out, n = [], 0
        for k, (ids, m) in enumerate(tiles[x]):
            for l, (others, r) in enumerate(tiles[y][k:] if x == y else tiles[y]):  # noqa: E741
                s = m @ r.T
                i, j = np.nonzero(s > threshold - 1e-8)
                a, b, value = ids[i], others[j], np.round(s[i, j], PLACES)
                ok = (value > threshold) & (a < b if x == y and not l else a != b)
                out.append((np.minimum(a, b)[ok], np.maximum(a, b)[ok], value[ok]))
                n += np.count_nonzero(ok)
                if n >= PAIRS * 64:
                    yield _pairs(out)
                    out, n = [], 0
        if n:
            yield _pairs(out)

    return dealt.groupBy("x", "y").applyInArrow(compare, "a bigint, b bigint, score double").distinct()


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    import numpy as np

    a, b, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(score)], ["a", "b", "score"])


def embedding_contract(vectors: DataFrame, dims: int, eps: float = 1e-3, vector: str = "embedding") -> DataFrame:
    """V4: counts of vectors, of wrong length, not finite, not of unit norm."""
    v = F.col(vector)
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.size(v) != dims, F.lit(True))).alias("wrong_dims"),
        F.count_if(~fv.is_finite(v)).alias("not_finite"),
        F.count_if(~F.coalesce(F.abs(fv.norm(v) - 1) < eps, F.lit(False))).alias("not_unit"),
    )
