"""Near copies by SimHash over five-word shingles: binary-trie self-joins, exact verification, connected components.

Shingles: A-Z lower-cased, words of the whole text, five in a row as a 64-bit hash (a shorter text is one
shingle; texts without words equal each other). Two texts are near copies if the Jaccard similarity of their
sets of shingles is ``SIMILAR`` or more.

Fingerprints: one of 64 bits cannot tell a similarity of 0.8 (9.7 bits apart) from less with few candidates, so there
are ``PRINTS``. Each shingle of the set votes 3, 1, -1 or -3 for a bit; a bit is set if the votes' sum is above zero.
The sizes of votes keep texts of few shingles from ties.

Candidates: equal texts are merged first. Each fingerprint goes to the tries of the ``TURNS``, rotated so that
another block of ``WIDTH`` bits comes first; a binary-trie self-join below each block value with a budget of ``BITS``
bits (``simhash.trie_links``) gives trees, and the texts of a tree share a bucket. A pair at exactly 0.8 meets in no
trie with a chance of 1e-5, one of four and five shingles with 1e-4, pairs above with less (calculated). All
fingerprints side by side are a sketch; it drops pairs with more than ``UNLIKE`` unlike bits, by which a pair at 0.8 is
lost with a chance of 1e-6. Nothing else is left out.

Links: a text without a like sketch in a bucket leaves it before any set is made, so links of a trie by chance cost no
sets. Each text that stays has one of the texts it is like, the first of a bucket if it can be; these pairs are verified by
the sets themselves. Then all pairs of a bucket that the components so far do not connect, verified the same way, unless a
second sketch of ``FINE`` bytes of minima, made for texts of such buckets only, differs in more than ``FINE_UNLIKE`` (a
pair at 0.8 is lost with a chance of 3e-7; pairs below 0.72 hardly pass). So a large group of near copies costs a link a text; what grows with the square of a bucket
is comparing sketches of texts that are not connected, and verifying those of 0.74 and more. The tries' work grows with
the square of the texts below a block value (1 / 2 ** ``WIDTH`` of all, for unlike texts).

Defined results: repeated rows and equal texts are one document; a null key comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.llm.common import durable, settled, text_slices, written
from evalgrove.llm.simhash import _rotated, components, trie_links

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
PRINTS = 20
#: Bits by which each fingerprint is rotated for its tries, and the bits that must agree in front.
TURNS, WIDTH = (0, 13, 26, 39, 51), 13
#: Most unlike bits of two linked fingerprints.
BITS = 12
#: Most bits of all fingerprints that may differ; at a similarity of 0.8 it is 193 of 1,280 with a deviation of 12.8.
UNLIKE = 276
#: Most bytes of two second sketches that may differ; at 0.8 it is 204 of 1,024 with a deviation of 12.8.
FINE, FINE_UNLIKE = 1_024, 268
#: Bytes of text hashed at once.
BYTES = 1 << 19
#: Pairs of sketches compared at once.
PAIRS = 1 << 15


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE):
    """Hashes of all shingles, in order; one fixed value for a text without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(own))
    n = len(own) - size + 1
    found = own[:n].copy()
    for k in range(1, size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    return _mixed(found)


def _prints(sets: list):
    """Fingerprints (texts, ``PRINTS``) of sets of shingles."""
    import numpy as np

    flip = np.random.default_rng(11).integers(0, 1 << 63, 2 * PRINTS, np.uint64)
    sizes = np.array([len(x) for x in sets])
    values, ends = np.concatenate(sets), np.cumsum(sizes)
    parts = -(-sizes // 255)  # a byte counts up to 255 shingles
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    at = np.repeat(ends - sizes, parts) + 255 * within
    lanes = np.uint64(0x0101010101010101)

    def counts(f):
        own, out = _mixed(values ^ f), np.empty((len(sets), 64), np.int64)
        for k in range(8):
            of_part = np.add.reduceat((own >> np.uint64(k)) & lanes, at).view(np.uint8).reshape(-1, 8)
            out[:, k::8] = np.add.reduceat(of_part, first, axis=0, dtype=np.int64)
        return out

    found = np.empty((len(sets), PRINTS), np.uint64)
    for k in range(PRINTS):
        votes = 4 * counts(flip[2 * k]) + 2 * counts(flip[2 * k + 1]) > 3 * sizes[:, None]
        found[:, k] = np.packbits(votes, axis=1, bitorder="little").view("<u8")[:, 0]
    return found


def prints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, prints) of each row: its key, its text's hash and its fingerprints."""
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in text_slices(batches, "t", BYTES):
            found = _prints([np.unique(shingles(t)) for t in batch.column(2).to_pylist()])
            offsets = pa.array(np.arange(0, found.size + 1, PRINTS, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists.cast(pa.list_(pa.field("element", pa.int64(), False)))], schema=pa.schema([pa.field("k", batch.column(0).type), ("h", pa.int64()), ("prints", pa.list_(pa.field("element", pa.int64(), False)))]))

    return df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def trees(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(b, kind, h): each text h of ``nodes`` (h, prints) once for each trie (kind) in which it has links; texts of a tree share b."""
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("h", T.LongType())])

    def of_group(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        import numpy as np

        t = pa.Table.from_batches(parts)
        kind, turned, h = (t.column(c).to_numpy() for c in ("kind", "turned", "h"))
        bs, kinds, hs = [], [], []
        for k in np.unique(kind):
            of = np.flatnonzero(kind == k)
            values, place = np.unique(turned[of].view(np.uint64), return_inverse=True)
            linked, to = trie_links(values, WIDTH, bits)
            root = np.arange(len(values))
            root[linked] = to
            root = root[place]
            shared = np.bincount(root, minlength=len(values))[root] > 1
            b = _mixed(values[root[shared]] ^ _mixed(np.full(1, k + 1, np.uint64)))
            bs.append(b.view(np.int64))
            kinds.append(np.full(len(b), k, np.int32))
            hs.append(h[of][shared])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (bs, kinds, hs)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= 1 << 19:  # up to where the last block value of this batch begins
                kind, top = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - WIDTH)
                edge = np.flatnonzero((kind[1:] != kind[:-1]) | (top[1:] != top[:-1]))
                if len(edge):
                    cut = int(edge[-1]) + 1
                    yield of_group([*held, batch.slice(0, cut)])
                    held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield of_group(held)

    copies = [F.struct(F.lit(len(TURNS) * k + j).alias("kind"), _rotated(F.col("prints")[k], by).alias("turned")) for k in range(PRINTS) for j, by in enumerate(TURNS)]
    dealt = nodes.select("h", F.explode(F.array(*copies)).alias("x")).select("x.kind", "x.turned", "h")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "kind", F.shiftrightunsigned("turned", 64 - WIDTH)).sortWithinPartitions("kind", "turned").mapInArrow(run, schema)


def _sets(rows: DataFrame) -> DataFrame:
    """(h, s): the set of shingles of each text of rows (h, t); neighbours of the same text are one row."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("s", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last = None
        for batch in text_slices(batches, "t"):
            own = batch.column(0).to_numpy()
            new = np.append(last is None or own[0] != last, own[1:] != own[:-1])
            last = own[-1]
            batch = batch.filter(pa.array(new))
            found = [pa.array(np.unique(shingles(t)).view(np.int64)) for t in batch.column(1).to_pylist()]
            if not found:
                continue
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(found))], schema=pa.schema([("h", pa.int64()), ("s", pa.list_(pa.field("element", pa.int64(), False)))]))

    return rows.select("h", "t").mapInArrow(run, schema)


def _fine(sets: DataFrame) -> DataFrame:
    """(h, fine): the second sketch of each set of (h, s)."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("fine", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        draw = np.random.default_rng(12)
        flip, times = draw.integers(0, 1 << 63, FINE, np.uint64), draw.integers(0, 1 << 63, FINE, np.uint64) * np.uint64(2) + np.uint64(1)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                own = batch.column(1)
                values, sizes = own.flatten().to_numpy().view(np.uint64), pc.list_value_length(own).to_numpy().astype(np.int64)
                start = np.cumsum(sizes) - sizes
                least = [((np.minimum.reduceat((values ^ f) * m, start) >> np.uint64(24)) & np.uint64(255)).astype(np.uint8) for f, m in zip(flip, times, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.stack(least, axis=1)], pa.binary())], schema.names)

    return sets.select("h", "s").mapInArrow(run, schema)


def _of_buckets(members: DataFrame, names: list[str], schema: T.StructType, of_bucket) -> DataFrame:
    """Rows that ``of_bucket`` makes of each bucket b of members, its rows in order of c and h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, last, out, n = [], None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch.column(0).to_numpy()
            start = 0
            for cut in [*(np.flatnonzero(np.append(last is not None and b[0] != last, b[1:] != b[:-1]))).tolist(), None]:
                if cut is None:
                    held.append(batch.slice(start))
                    break
                if cut > start:
                    held.append(batch.slice(start, cut - start))
                for found in of_bucket(pa.Table.from_batches(held).combine_chunks()):
                    out.append(found)
                    n += found.num_rows
                    if n >= 1 << 16 or len(out) >= 1 << 12:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out, n = [], 0
                held, start = [], cut
            last = b[-1]
        for found in of_bucket(pa.Table.from_batches(held).combine_chunks()) if held else ():
            out.append(found)
            if len(out) >= 1 << 12:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select(names).repartition(n, "b").sortWithinPartitions("b", "c", "h").mapInArrow(run, schema)


def _longs(t: pa.Table, name: str):
    import numpy as np

    return t.column(name).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)


def _alike(members: DataFrame) -> DataFrame:
    """(b, kind, h, to) from members (b, kind, c, h, prints): those with a like sketch in their bucket b; to is one that is like h, null for the first of such a group."""
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("to", T.LongType())])

    def of_bucket(t: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sketch, to = _longs(t, "prints"), np.full(t.num_rows, -1)
        led = np.zeros(t.num_rows, bool)
        for a in range(t.num_rows):
            if to[a] >= 0:
                continue
            for k in range(0, t.num_rows, PAIRS):
                b = k + np.flatnonzero(np.bitwise_count(sketch[k : k + PAIRS] ^ sketch[a]).sum(1, dtype=np.int64) <= UNLIKE)
                b = b[b != a]
                if not len(b):
                    continue
                free = b[(to[b] < 0) & ~led[b]]
                to[free], led[a] = a, True
                if len(free) < len(b) and to[a] < 0:  # like a text that has a place already
                    to[a] = np.setdiff1d(b, free)[0]
        kept = led | (to >= 0)
        if kept.any():
            h = t.column("h").to_numpy()
            yield from t.select(["b", "kind", "h"]).append_column("to", pa.array(h[to], mask=to < 0)).filter(pa.array(kept)).combine_chunks().to_batches()

    return _of_buckets(members, ["b", "c", "h", "kind", "prints"], schema, of_bucket)


def _apart(kind: int, c, prints, bits: int) -> Iterator[tuple[int, object]]:
    """(a, others after it) of a bucket of trie ``kind``: pairs of unlike c that the trie links, none before it does, with like sketches."""
    import numpy as np

    ends = np.searchsorted(c, c, "right")
    at, turn = divmod(kind, len(TURNS))
    top = (1 << WIDTH) - 1  # the bits in front of each turn, in their own places
    front = [np.uint64((top << (64 - WIDTH) >> by) | (top << (128 - WIDTH - by)) % 2**64) for by in TURNS]
    own = prints[:, at].copy()
    for a in range(len(c)):
        for k in range(int(ends[a]), len(c), PAIRS):
            unlike = own[k : k + PAIRS] ^ own[a]
            b = k + np.flatnonzero((np.bitwise_count(unlike) <= bits) & (unlike & front[turn] == 0))
            if not len(b):
                continue
            unlike = prints[b] ^ prints[a]
            count = np.bitwise_count(unlike)
            good = count.sum(1, dtype=np.int64) <= UNLIKE
            near = count <= bits
            for t in range(at + 1):
                for j in range(len(TURNS) if t < at else turn):
                    good &= ~(near[:, t] & (unlike[:, t] & front[j] == 0))
            if good.any():
                yield a, b[good]


def _open(members: DataFrame, bits: int) -> DataFrame:
    """Members (b, kind, c, h) that have a pair left to compare in their bucket, from members (b, kind, c, h, prints)."""
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("c", T.LongType()), T.StructField("h", T.LongType())])

    def of_bucket(t: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c, left = t.column("c").to_numpy(), np.zeros(t.num_rows, bool)
        if c[0] == c[-1]:
            return
        for a, b in _apart(t.column("kind")[0].as_py(), c, _longs(t, "prints"), bits):
            left[a] = left[b] = True
        if left.any():
            yield from t.select(schema.names).filter(pa.array(left)).combine_chunks().to_batches()

    return _of_buckets(members, ["b", "c", "h", "kind", "prints"], schema, of_bucket)


def _rest(members: DataFrame, bits: int) -> DataFrame:
    """(u, v), distinct, from members (b, kind, c, h, prints, fine): pairs of unlike c whose second sketches are alike too, each from the first trie that links it."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def of_bucket(t: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        h, fine = t.column("h").to_numpy(), np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        for a, b in _apart(t.column("kind")[0].as_py(), t.column("c").to_numpy(), _longs(t, "prints"), bits):
            b = b[(fine[b] != fine[a]).sum(1) <= FINE_UNLIKE]
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(h[a], h[b])), pa.array(np.maximum(h[a], h[b]))], ["u", "v"])

    return _of_buckets(members, ["b", "c", "h", "kind", "prints", "fine"], schema, of_bucket).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are similar."""
    both = pairs.join(sets.select(F.col("h").alias("v"), F.col("s").alias("sv")), "v").join(sets.select(F.col("h").alias("u"), F.col("s").alias("su")), "u")
    common, every = F.size(F.array_intersect("su", "sv")), F.size("su") + F.size("sv")
    return both.filter(common * SIMILAR[1] >= (every - common) * SIMILAR[0]).select("u", "v")


def roots(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(k, h) of each row, with other columns, and (node, root) of the texts' hashes that have near copies."""
    found = written(prints(df, key, text))
    nodes = found.groupBy("h").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k")).alias("x"), F.first("prints").alias("prints"))
    nodes = written(nodes.select("h", F.col("x.k").alias("k"), "prints"))
    dealt = settled(trees(nodes, bits))
    alike = settled(_alike(dealt.withColumn("c", F.col("h")).join(nodes.select("h", "prints"), "h")), dealt)
    wanted = nodes.join(alike.select("h").distinct(), "h", "left_semi").select(F.col("k").alias("__k"), F.col("h").alias("__h"))
    rows = df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("t"))
    rows = rows.join(wanted.hint("merge"), F.col("k").eqNullSafe(F.col("__k")) & (F.col("h") == F.col("__h")), "left_semi")  # the same plan for every size
    sets = settled(_sets(rows))  # a repeated row repeats a link at most
    star = alike.filter("`to` IS NOT NULL").select(F.least("h", "to").alias("u"), F.greatest("h", "to").alias("v")).distinct()
    first = durable(_similar(star, sets))
    linked = components(first)
    named = alike.join(linked.withColumnRenamed("node", "h"), "h", "left").withColumn("c", F.coalesce("root", "h"))
    apart = settled(_open(named.join(nodes.select("h", "prints"), "h"), bits), alike)
    fine = written(_fine(sets.join(apart.select("h").distinct(), "h", "left_semi")))
    texts = nodes.select("h", "prints").join(fine.groupBy("h").agg(F.first("fine").alias("fine")), "h")
    rest = durable(_similar(_rest(apart.join(texts, "h"), bits), sets))
    return found, settled(linked if rest.isEmpty() else components(first.unionByName(rest)), nodes, sets, apart, fine)


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each component of near copies: that with the smallest key (null last), ties by the text's hash; all columns as they are."""
    found, linked = roots(df, key, text, bits)
    rank = F.struct(F.col("k").isNull().alias("none"), "k", "h")
    first = found.groupBy("h").agg(F.min(rank).alias("x"))  # one row of each text before the join
    kept = first.join(linked.withColumnRenamed("node", "h"), "h", "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("x").alias("x"))
    again = not found.groupBy("k", "h").count().filter("count > 1").isEmpty()  # the same key and text more than once
    kept = settled(kept.select(F.col("x.k").alias("__k"), F.col("x.h").alias("__h")), found, linked)
    rows = df.withColumn("__own", F.xxhash64(F.col(text)))
    rows = rows.join(kept.hint("merge"), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__own") == F.col("__h")), "left_semi")
    if again:
        rows = rows.dropDuplicates([key, "__own"])
    return rows.drop("__own")
