"""Windows of a fixed length that start in two places or more: hashing, minimizers, and the exchange that finds them.

Windows (the edges of a De Bruijn graph over windows one item shorter) are dealt out by their minimizer, the
smallest hash of the shorter grams inside. Equal windows have equal minimizers, and neighbouring
windows mostly share one, so a run of windows travels as one row. Callers settle copies within a slice of
rows where they are read and send one of them, so a window that a third of all rows hold costs one row a
slice, not one a row.

Rows: ``key`` (where it goes), the row's own ``doc`` and ``h`` (hash of its text), ``kind`` (of the windows, for callers
that look for several lengths; keys of unlike kinds must differ), ``at`` and ``n`` (window starts at..at+n-1),
``hashes`` (7 bytes a window; null: these windows are known to be repeated).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_BYTES = 7
#: Windows that a task compares at once, up to the end of a key.
BATCH_WINDOWS = 1 << 20


def roll(values, size: int):
    """64-bit polynomial hash of each ``size`` neighbouring 64-bit values, finished with a mix."""
    import numpy as np

    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        # sums of values by Horner's rule over doubling sizes: h(2k)[i] = h(k)[i] * base^k + h(k)[i + k]
        out, done, power = None, 0, {1: values}
        k, p = 1, base
        powers = {1: p}
        while 2 * k <= size:
            h = power[k]
            power[2 * k] = h[:-k] * p + h[k:]
            k, p = 2 * k, p * p
            powers[k] = p
        for k in sorted(power, reverse=True):
            if size & k:
                part = power[k]
                out = part[:n] if out is None else out[:n] * powers[k] + part[done : done + n]
                done += k
        out = out[:n] ^ (out[:n] >> np.uint64(31))
        out = out * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def smallest(values, size: int):
    """Minimum of each ``size`` neighbouring values."""
    import numpy as np

    n = len(values) - size + 1
    out, k = values, 1
    while 2 * k <= size:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[:n], out[size - k : size - k + n])


def runs(flags, *same):
    """Start and length of runs of true flags in which every array of ``same`` keeps its value."""
    import numpy as np

    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for x in same:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def repeated(hashes):
    """(twice, spare): windows whose hash occurs twice or more here, and those of them after the first."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    equal = hashes[order][1:] == hashes[order][:-1]
    twice, spare = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    spare[order[1:][equal]] = True
    return twice, spare


def pack(hashes) -> bytes:
    return hashes.astype("<u8").view("u1").reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpack(packed: list[bytes]):
    import numpy as np

    flat = np.frombuffer(b"".join(packed), "u1").reshape(-1, HASH_BYTES)
    wide = np.zeros((len(flat), 8), "u1")
    wide[:, :HASH_BYTES] = flat
    return wide.view("<u8").ravel()


def schema(doc: T.DataType) -> T.StructType:
    fields = [("key", T.LongType()), ("doc", doc), ("h", T.LongType()), ("kind", T.LongType()), ("at", T.LongType()), ("n", T.LongType()), ("hashes", T.BinaryType())]
    return T.StructType([T.StructField(k, t) for k, t in fields])


def spread(h: pa.Array, row, place):
    """Keys for rows that only pass through the exchange: copies of a text go to different tasks."""
    import numpy as np

    with np.errstate(over="ignore"):
        return np.asarray(h, np.int64) ^ (row.astype(np.int64) * np.int64(0x9E3779B97F4A7C1)) ^ (place.astype(np.int64) * np.int64(0x6EB86659FD93))


NAMES = ["key", "doc", "h", "kind", "at", "n", "hashes"]


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that end with the last row of a key."""
    import numpy as np
    import pyarrow.compute  # noqa: F401

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= BATCH_WINDOWS:
            key = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.append(key[0] != held[-1].column(0)[-1].as_py(), key[1:] != key[:-1]))
            if len(edge):
                if edge[0]:
                    held.append(batch.slice(0, int(edge[0])))
                yield pa.Table.from_batches(held)
                held, size, batch = [], 0, batch.slice(int(edge[0]))
        held.append(batch)
        size += pa.compute.sum(batch.column(NAMES.index("n"))).as_py()
    if held:
        yield pa.Table.from_batches(held)


def settle(rows: DataFrame) -> DataFrame:
    """(doc, h, kind, at, n): runs of repeated windows, from rows of ``schema``. One shuffle, by key."""
    out = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), *[T.StructField(c, T.LongType()) for c in ("h", "kind", "at", "n")]])

    def compare(t: pa.Table) -> pa.RecordBatch:
        import numpy as np

        known = t.filter(pa.compute.is_null(t.column("hashes")))
        t = t.filter(pa.compute.is_valid(t.column("hashes")))
        n = t.column("n").to_numpy()
        hashes = unpack(t.column("hashes").to_pylist())
        row = np.repeat(np.arange(len(n)), n)
        with np.errstate(over="ignore"):
            mixed = hashes ^ (t.column("key").to_numpy().view(np.uint64)[row] * np.uint64(0xD6E8FEB86659FD93))
        twice, _ = repeated(mixed)
        first, length = runs(twice, row)
        own = row[first]
        at = t.column("at").to_numpy()[own] + first - (np.cumsum(n) - n)[own] if len(first) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([*known.column(c).chunks, *t.column(c).take(pa.array(own)).chunks]) if known.num_rows + len(own) else pa.array([], t.schema.field(c).type) for c in ("doc", "h", "kind")] + [pa.concat_arrays([known.column(c).combine_chunks() if known.num_rows else pa.array([], pa.int64()), pa.array(x)]) for c, x in (("at", at), ("n", length))], ["doc", "h", "kind", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buckets(batches):
            yield compare(table)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, out)


def compacted(marks: DataFrame) -> DataFrame:
    """(doc, h, kind, at, n): maximal paths, from pieces that meet or overlap in one row's coordinates.

    Equal pieces are merged before the shuffle; a window then holds the pieces of one text, as many as it has runs at
    most. A piece begins a path if no piece before it reaches its first place.
    """
    pieces = marks.groupBy("doc", "h", "kind", "at").agg(F.max("n").alias("n"))
    order = W.partitionBy("doc", "h", "kind").orderBy("at")
    reach = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1))
    begun = pieces.withColumn("new", F.when(F.col("at") <= reach, 0).otherwise(1))
    numbered = begun.withColumn("path", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = numbered.groupBy("doc", "h", "kind", "path").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("end"))
    return ends.select("doc", "h", "kind", "at", (F.col("end") - F.col("at")).alias("n"))


def spans_by_row(marks: DataFrame) -> DataFrame:
    """(doc, h, spans): the maximal paths of each row; fewer than its text has windows."""
    return compacted(marks).groupBy("doc", "h").agg(F.collect_list(F.struct("kind", "at", "n")).alias("spans"))
