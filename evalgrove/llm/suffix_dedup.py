"""Suffix-array dedup over the UTF-8 bytes of whole texts.

A string of ``LENGTH`` bytes that starts at two places or more is repeated; each byte under one goes. Bytes under
repeated strings of the ``floor`` below it (256 for 400) are counted too. Work is kept off the text that cannot
repeat:

1. Every start belongs to a run of starts whose next ``floor`` bytes have the same minimizer (smallest hash of the
   shorter grams inside); a run's region goes on to ``LENGTH`` bytes behind its last start, or to the end of the text.
   Starts whose next ``floor`` bytes are equal share a minimizer. Runs travel as a few numbers: minimizer, hash of the
   region, place.
2. A region found twice settles all its starts. A minimizer found once settles that none of its starts
   repeats, unless its own region holds it twice. What is left are runs at the edges of repeats.
3. Their regions are cut from the texts and dealt out by minimizer (a minimizer with many of them is dealt
   to several tasks). A task builds the suffix array of its regions by prefix doubling, and the lengths of common
   prefixes from the ranks on the way. In suffix order, the previous and the next start with a smaller position give
   the longest previous factor of each start, with its length: one that reaches the wanted length makes the start a
   later copy and its match an earlier one. Of divided minimizers, one start of each content is compared once more
   by hash, as in ``windows``.
4. Marks go back to their texts by document.

``later_copies`` keeps the first copy, for a bounded set of texts; over a whole table every copy goes, as the marks of
earlier matches are used too.

Tables that are read again are written to the shared folder, after which the shuffles behind them are given back.

Defined results: null and empty texts are no bytes; matches never cross documents; shorter texts are
kept whole; rows that repeat a doc_id and a text are each other's copies; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.llm import windows
from evalgrove.llm.common import settled, text_slices

LENGTH = 400
GRAM = 32
#: Bytes of one text taken up at once.
BYTES = 1 << 20
#: Regions of one minimizer in a task; more are divided.
SHARE = 2_000
#: Longest run that travels as one row.
RUN = 4_096
#: Bytes of regions whose suffixes are sorted at once, up to the end of a minimizer.
SUFFIXES = 1 << 20
#: Symbols that the first ranks compare.
FIRST = 4


def floor_of(length: int) -> int:
    """The shorter length that is looked for as well: the largest power of two up to ``length``."""
    return 1 << (length.bit_length() - 1)


def _values(raw):
    """A 64-bit value for each byte."""
    import numpy as np

    letters = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    return letters[raw]


def loops_of(grams, least, first, n, reach: int):
    """For each run of ``n`` windows from ``first``, whether its minimizer occurs twice in its region; ``reach``: grams in a window."""
    import numpy as np

    edge = np.zeros(reach - 1, np.uint64)
    most = ~windows.smallest(~np.concatenate([edge, least, edge]), reach)  # of the windows that hold a gram
    place = np.flatnonzero(most == grams)  # the smallest of some window
    values, name = np.unique(grams[place], return_inverse=True)
    wide = len(grams) + 1
    known = np.sort(name.astype(np.int64) * wide + place)
    base = np.searchsorted(values, least[first]).astype(np.int64) * wide + first
    return np.searchsorted(known, base + n + reach - 1) - np.searchsorted(known, base) > 1


def runs_of(df: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    """(a, r, doc, h, at, n, size, loops): minimizer, hash of the region, owner, first start, number of starts, bytes of the region, whether it holds its minimizer twice."""
    rows = df.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("r", T.LongType()), rows.schema["doc"], *[T.StructField(c, T.LongType()) for c in ("h", "at", "n", "size")], T.StructField("loops", T.BooleanType())])
    floor = floor_of(length)

    def flush(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        import numpy as np
        import xxhash

        sizes, starts = np.array([len(x) for _, _, x, _ in held]), np.array([k for _, _, _, k in held])
        joined = b"".join(x for _, _, x, _ in held)
        grams = windows.roll(_values(np.frombuffer(joined, np.uint8)), gram)
        least = windows.smallest(grams, floor - gram + 1)
        begin = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(held)), sizes)[: len(least)]
        offset = np.arange(len(least)) - begin[part]
        first, n = windows.runs(offset < starts[part], part, least, offset // RUN)
        of = part[first]
        size = np.minimum(n - 1 + length, (begin + sizes)[of] - first)
        digest, view = xxhash.xxh64_intdigest, memoryview(joined)
        region = np.fromiter((digest(view[a : a + s], k) for a, s, k in zip(first.tolist(), size.tolist(), n.tolist(), strict=True)), np.uint64, len(first))
        loops = loops_of(grams, least, first, n, floor - gram + 1)
        place = offset[first] + np.array([s for _, s, _, _ in held])[of]
        take = pa.array(np.array([r for r, _, _, _ in held])[of])
        return pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), pa.array(region.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(place), pa.array(n), pa.array(size), pa.array(loops)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "t", BYTES):
            held, n = [], 0
            for row, text in enumerate(batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8")
                for start in range(0, max(0, len(raw) - floor + 1), BYTES):
                    held.append((row, start, raw[start : start + BYTES + length - 1], min(BYTES, len(raw) - floor + 1 - start)))
                    n += len(held[-1][2])
                    if n >= BYTES:
                        yield flush(batch, held)
                        held, n = [], 0
            if held:
                yield flush(batch, held)

    return rows.mapInArrow(run, schema)


def ranked(key, bits: int):
    """(order, rank) of unsigned keys of ``bits`` bits; equal keys have equal ranks."""
    import numpy as np

    n = len(key)
    own = max(1, n.bit_length())
    if bits + own <= 64:  # key and place in one number: sorting it needs no indirection
        packed = np.sort((key << np.uint64(own)) | np.arange(n, dtype=np.uint64))
        order, key = (packed & np.uint64((1 << own) - 1)).astype(np.int64), packed >> np.uint64(own)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.zeros(n, np.uint64)
    rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]).astype(np.uint64)[:n]
    return order, rank


def suffixes(symbols, longest: int):
    """(order, ranks): the suffix array by the first ``longest`` symbols at least, and the ranks by 4, 8, 16, ... symbols. Prefix doubling."""
    import numpy as np

    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(FIRST, np.uint16)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(FIRST):
        word = (word << np.uint64(9)) | padded[k : k + n]
    order, rank = ranked(word, 9 * FIRST)
    done, ranks = FIRST, {FIRST: rank.astype(np.int32)}
    wide = n.bit_length()
    while done < longest:
        after = np.zeros(n, np.uint64)
        after[: max(0, n - done)] = rank[done:] + np.uint64(1)
        order, rank = ranked((rank << np.uint64(wide)) | after, 2 * wide)
        done *= 2
        ranks[done] = rank.astype(np.int32)
    return order, ranks


def common_prefix(symbols, ranks: dict, a, b):
    """Symbols that the suffixes at ``a`` and ``b`` share, if fewer than the longest ranks compare (else at least as many)."""
    import numpy as np

    n, shared = len(symbols), np.zeros(len(a), np.int64)
    for size, names in [*((k, ranks[k]) for k in sorted(ranks, reverse=True)), *[(1, symbols)] * (FIRST - 1)]:
        x, y = a + shared, b + shared
        same = (np.maximum(x, y) < n) & (names[np.minimum(x, n - 1)] == names[np.minimum(y, n - 1)])
        shared += np.where(same, size, 0)
    return shared


def smaller_before(values, group):
    """For each value the nearest one before it, of the same group, that is smaller, or -1: pointers jump over larger ones, all at once."""
    import numpy as np

    at = np.arange(len(values)) - 1
    todo = np.arange(len(values))
    while len(todo):
        p = at[todo]
        out = (p < 0) | (group[p] != group[todo])
        at[todo[out]] = -1
        todo = todo[~out]
        todo = todo[values[at[todo]] > values[todo]]
        at[todo] = at[at[todo]]
    return at


def previous_factors(symbols, left, starts, length: int):
    """Longest previous factors of the starts that share ``floor_of(length)`` symbols with another start.

    ``left`` holds, for each place, the symbols up to the end of its string. Returns (start, match, shared): in suffix
    order the previous and the next start with a smaller position, and the symbols that they share with it; the longer
    of the two is the longest previous factor.
    """
    import numpy as np

    floor = floor_of(length)
    order, ranks = suffixes(symbols, length)
    chosen = np.zeros(len(symbols), bool)
    chosen[starts] = True
    line = order[chosen[order]]  # the starts in suffix order
    name = ranks[floor][line]
    near, same = np.zeros(len(line), bool), name[1:] == name[:-1]
    near[1:] |= same
    near[:-1] |= same
    line, name = line[near], name[near]
    before = smaller_before(line, name)
    after = len(line) - 1 - smaller_before(line[::-1], name[::-1])[::-1]
    after[after == len(line)] = -1
    found = []
    for match in (before, after):
        has = np.flatnonzero(match >= 0)
        start, other = line[has], line[match[has]]
        shared = common_prefix(symbols, ranks, start, other)
        found.append((start, other, np.minimum(shared, np.minimum(left[start], left[other]))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def joined(bodies: list[bytes]):
    """(symbols, begin, left): the strings one after the other, bytes as 1..256 and a 0 behind each; where each begins; symbols left in the string, by place."""
    import numpy as np

    sizes = np.array([len(b) for b in bodies], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
    ends = begin + sizes
    symbols[ends] = 0
    return symbols, begin, np.repeat(ends, sizes + 1) - np.arange(len(symbols))


def later_copies(texts: list[bytes], length: int = LENGTH) -> list:
    """Byte masks of the texts: what an earlier place already has, so that the first copy stays. For a bounded list of texts; length of 4 or more."""
    import numpy as np

    if not texts:
        return []
    symbols, _, left = joined(texts)
    starts = np.flatnonzero(left >= length)
    edge = np.zeros(len(symbols) + 1, np.int64)
    if len(starts):
        start, _, shared = previous_factors(symbols, left, starts, length)
        late = np.unique(start[shared >= length])
        edge[late] += 1
        edge[late + length] -= 1
    gone = (np.cumsum(edge[:-1]) > 0) & (symbols > 0)
    return [x[:-1] for x in np.split(gone, np.cumsum([len(t) + 1 for t in texts])[:-1])]


def _regions(df: DataFrame, key: str, text: str, edges_: DataFrame) -> DataFrame:
    """Regions of the runs at edges, cut from their texts: (a, part, doc, h, at, n, region), or none twice within a slice."""
    wanted = edges_.groupBy("doc", "h").agg(F.collect_list(F.struct("a", "parts", "at", "n", "size")).alias("runs"))
    rows = df.select(F.col(key), F.xxhash64(F.col(text)).alias("__h"), F.col(text).cast("string").alias("t"))
    joined = rows.join(wanted, rows[key].eqNullSafe(wanted["doc"]) & (rows["__h"] == wanted["h"]), "inner").select("t", "doc", "h", "runs")
    fields = [T.StructField("a", T.LongType()), T.StructField("part", T.LongType()), joined.schema["doc"], *[T.StructField(c, T.LongType()) for c in ("h", "at", "n")], T.StructField("region", T.BinaryType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "t", BYTES):
            out = {c: [] for c in ("a", "part", "own", "at", "n", "region")}
            for own, (text, h, runs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = text.encode("utf-8")
                for r in runs:
                    out["a"].append(r["a"])
                    out["part"].append((h + r["at"] * 7919) % r["parts"] if r["parts"] > 1 else -1)
                    out["own"].append(own)
                    out["at"].append(r["at"])
                    out["n"].append(r["n"])
                    out["region"].append(raw[r["at"] : r["at"] + r["size"]])
            own = pa.array(out["own"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.int64()), pa.array(out["part"], pa.int64()), batch.column(1).take(own), batch.column(2).take(own), pa.array(out["at"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["region"], pa.binary())], schema.names)

    return joined.mapInArrow(run, schema)


def _matched(regions: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of ``windows.schema``: starts of repeated strings of both lengths (kind) as known, and single starts of divided minimizers by hash."""
    schema = windows.schema(regions.schema["doc"].dataType)
    floor = floor_of(length)

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        t = t.combine_chunks()
        n, at, divided = (t.column(c).to_numpy() for c in ("n", "at", "part"))
        symbols, begin, left = joined(t.column("region").to_pylist())
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        starts, place = begin[row] + offset, at[row] + offset
        start, match, shared = previous_factors(symbols, left, starts, length)
        doc, h = (t.column(c).combine_chunks() for c in ("doc", "h"))
        offers = (divided >= 0).any()
        if offers:
            values = _values((symbols - np.uint16(1)).astype(np.uint8))
            wide = min(4 * gram, (gram + floor) // 2)
            other = windows.smallest(windows.roll(values, wide), floor - wide + 1)  # not all under the one minimizer again
        for kind in (floor, length):
            late, early = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
            late[start[shared >= kind]] = True
            early[match[shared >= kind]] = True
            first, m = windows.runs((late | early)[starts], row)
            own = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([pa.array(windows.spread(h.take(own), row[first], place[first])), doc.take(own), h.take(own), pa.array(np.full(len(first), kind)), pa.array(place[first]), pa.array(m), pa.nulls(len(first), pa.binary())], windows.NAMES)
            if offers:  # one of each, for the other parts of its minimizer
                offer = ~late[starts] & (divided[row] >= 0) & (left[starts] >= kind)
                full = windows.roll(values, kind)
                chosen = np.minimum(starts, len(other) - 1)
                first, m = windows.runs(offer, row, other[chosen])
                packed = [windows.pack(full[starts[x] : starts[x] + k]) for x, k in zip(first.tolist(), m.tolist(), strict=True)]
                own = pa.array(row[first])
                key = (other[chosen][first] ^ np.uint64(kind)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), doc.take(own), h.take(own), pa.array(np.full(len(first), kind)), pa.array(place[first]), pa.array(m), pa.array(packed, pa.binary())], windows.NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.cumsum(pc.binary_length(batch.column(6)).to_numpy().astype(np.int64))
            new = np.append(last is not None and (a[0], part[0]) != last, (a[1:] != a[:-1]) | (part[1:] != part[:-1]))
            start = 0
            for cut in np.flatnonzero(new).tolist():
                if size + int(ends[cut - 1] if cut else 0) - int(ends[start - 1] if start else 0) >= SUFFIXES:
                    yield from compare(pa.Table.from_batches([*held, batch.slice(start, cut - start)]))
                    held, size, start = [], 0, cut
            held.append(batch.slice(start))
            size += int(ends[-1]) - int(ends[start - 1] if start else 0)
            last = (a[-1], part[-1])
        if held:
            yield from compare(pa.Table.from_batches(held))

    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return regions.repartition(n, "a", "part").sortWithinPartitions("a", "part").mapInArrow(run, schema)


def repeated_starts(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, share: int = SHARE) -> DataFrame:
    """(doc, h, spans): for each text with repeated strings, the runs of their starts, by length (kind)."""
    found = settled(runs_of(df, key, text, length, gram))
    often = found.groupBy("a").agg(F.count(F.lit(1)).alias("total"), F.max("loops").alias("any")).filter("total > 1 OR any").select("a")
    met = settled(found.join(often, "a", "left_semi"), found)
    regions = met.groupBy("a", "r").agg(F.count(F.lit(1)).alias("copies"))
    contents = regions.groupBy("a").agg(F.count(F.lit(1)).alias("contents"))
    judged = settled(met.join(regions.join(contents, "a"), ["a", "r"]), met)
    ends = F.greatest(F.lit(0), F.least("n", F.col("size") - length + 1))
    both = F.explode(F.array(F.struct(F.lit(floor_of(length)).cast("long").alias("kind"), F.col("n").alias("m")), F.struct(F.lit(length).cast("long").alias("kind"), ends.alias("m"))))
    whole = judged.filter("copies > 1").select("doc", "h", "at", both.alias("x")).filter("x.m > 0")
    whole = whole.select(F.xxhash64("doc", "h", "at").alias("key"), "doc", "h", "x.kind", "at", F.col("x.m").alias("n"), F.lit(None).cast("binary").alias("hashes"))
    # one region of each repeated content stands for its copies among the regions at edges
    edge = judged.filter("copies = 1").select("a", "doc", "h", "at", "n", "size", "contents")
    stand = judged.filter("copies > 1 AND contents > 1").groupBy("a", "r").agg(F.min_by(F.struct("doc", "h", "at", "n", "size"), F.struct("h", "at")).alias("x"), F.first("contents").alias("contents")).select("a", "x.*", "contents")
    edges_ = edge.unionByName(stand).withColumn("parts", F.ceil(F.col("contents") / share).cast("long")).drop("contents")
    return settled(windows.spans_by_row(windows.settle(_matched(_regions(df, key, text, edges_), length, gram).unionByName(whole))), judged)


def _with_spans(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    marks = repeated_starts(df, key, text, length)
    rows = df.select(F.col(key), F.xxhash64(F.col(text)).alias("__h"), F.col(text).cast("string").alias("t"))
    return rows.join(marks, rows[key].eqNullSafe(marks["doc"]) & (rows["__h"] == marks["h"]), "left").select(key, "t", "spans")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): kept is the remaining bytes."""
    joined = _with_spans(df, key, text, length)
    schema = _schema(joined.schema[key], T.StructField("kept", T.BinaryType()))
    return joined.mapInArrow(lambda batches: _cut(batches, length, schema.names, pa.binary(), bytes), schema)


def repeat_digests(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, n_repeated): the last counts bytes under repeated strings of ``floor_of(length)`` bytes, removed or not."""
    found = _with_spans(df, key, text, length)
    schema = T.StructType([*_schema(found.schema[key], T.StructField("kept_sha256", T.StringType())).fields, T.StructField("n_repeated", T.LongType())])
    return found.mapInArrow(lambda batches: _cut(batches, length, schema.names, pa.string(), lambda b: hashlib.sha256(b).hexdigest(), True), schema)


def removal_digests(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256)."""
    return repeat_digests(df, key, text, length).drop("n_repeated")


def _schema(key: T.StructField, last: T.StructField) -> T.StructType:
    return T.StructType([key, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], last])


def _under(n_bytes: int, spans: list, kind: int):
    """Bytes under strings of ``kind`` bytes that start in the spans of that kind, as a mask."""
    import numpy as np

    edge = np.zeros(n_bytes + 1, np.int32)
    at, n = (np.array([s[c] for s in spans if s["kind"] == kind], np.int64) for c in ("at", "n"))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n - 1 + kind, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch], length: int, names: list[str], kind: pa.DataType, form, count_repeated: bool = False) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in text_slices(batches, "t"):
        counts, kept = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8")
            n_bytes, gone, n_spans, repeated = len(raw), 0, 0, 0
            if spans:
                under = _under(n_bytes, spans, length)
                gone, n_spans = int(under.sum()), int(under[0]) + int((under[1:] & ~under[:-1]).sum())
                repeated = int(_under(n_bytes, spans, floor_of(length)).sum()) if count_repeated else 0
                raw = np.frombuffer(raw, np.uint8)[~under].tobytes() if gone else raw
            counts.append((n_bytes, gone, n_spans, repeated))
            kept.append(form(raw))
        columns = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:3], pa.array(kept, kind), *columns[3 : 3 + count_repeated]], names)
