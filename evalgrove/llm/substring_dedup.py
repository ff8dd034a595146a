"""Substring dedup over words by a De Bruijn graph (``word_graph``).

The k-word windows of all documents are the edges of the graph, the k-1 words between two of them its nodes. Edges found at
two places or more are compacted: first within a minimizer's bucket, then by joins over the nodes, along paths that do not
branch. Source coordinates (document, place) lead back to the words of each piece, whose digests decide whether it repeats.
The paths are laid over the words of their documents, and each word under a path goes.

Scale: texts are hashed twice, first to count the common minimizers; one exchange of 7 bytes a window, two of the texts, each
given back before the next; copies of a window within a slice of rows do not travel, and the windows of common minimizers are dealt out by their own
hashes, so common passages and copies do not gather in one task: a window comes there once a slice at most. The lists
joined to a document are bounded by its own length.

Defined results: null and empty texts have no words and keep the empty string; texts shorter than the window
are kept whole; rows that repeat a doc_id and a text are each other's copies; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.llm import windows, word_graph
from evalgrove.llm.common import settled, text_slices

WINDOW = 35
#: Words of the grams among which a window's minimizer is chosen.
GRAM = 8
#: Words taken up at once.
WORDS = 1 << 18


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def _by_slice(df: DataFrame, key: str, text: str, window: int, gram: int, form, schema: T.StructType | None = None) -> DataFrame:
    """Batches that ``form`` makes of each slice of windows: batch, owner, place, hashes, minimizers, words, index of the first word."""
    rows = df.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("t"))
    schema = schema or windows.schema(rows.schema["doc"].dataType)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(row, first place, words) in pieces that overlap by a window less one."""
        for row, text in enumerate(batch.column(2).to_pylist()):
            words = split_words(text)
            for start in range(0, max(0, len(words) - window + 1), WORDS):
                yield row, start, words[start : start + WORDS + window - 1]

    def flush(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        import numpy as np
        import xxhash

        sizes = np.array([len(w) for _, _, w in held])
        words = [w for _, _, part in held for w in part]
        values = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        full = windows.roll(values, window)
        least = windows.smallest(windows.roll(values, gram), window - gram + 1)
        part = np.repeat(np.arange(len(held)), sizes)[: len(full)]
        offset = np.arange(len(full)) - (np.cumsum(sizes) - sizes)[part]
        inside = offset <= sizes[part] - window
        owner = np.array([r for r, _, _ in held])[part[inside]]
        place = offset[inside] + np.array([s for _, s, _ in held])[part[inside]]
        return form(batch, owner, place, full[inside], least[inside], words, np.flatnonzero(inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "t"):
            held, n = [], 0
            for part in parts(batch):
                held.append(part)
                n += len(part[2])
                if n >= 2 * WORDS:
                    yield flush(batch, held)
                    held, n = [], 0
            if held:
                yield flush(batch, held)

    return rows.mapInArrow(run, schema)


def edges(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of windows by minimizer, rows of ``windows.schema``."""
    return _by_slice(df, key, text, window, gram, lambda batch, *of_windows: word_graph.offered(batch.column(0), batch.column(1), *of_windows, window))


def common_minimizers(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> list[int]:
    """Minimizers whose windows are dealt out one by one; counted over all texts."""
    parts = word_graph.SHARES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "n")])
    return word_graph.common(_by_slice(df, key, text, window, gram, lambda batch, owner, place, hashes, minimizers, *_: word_graph.heavy(hashes, minimizers, parts), schema), parts)


def pieces_found(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(found, pieces): repeated windows by place, and the distinct pieces' places with their digests and nodes."""
    found = settled(word_graph.repeated_edges(edges(df, key, text, window, gram), common_minimizers(df, key, text, window, gram)))
    texts = df.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("t"))
    return found, settled(word_graph.measured(texts, found, window, split_words))


def repeated_paths(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, h, spans): for each document with repeated windows, the runs of their starts."""
    found, pieces = pieces_found(df, key, text, window)
    return settled(word_graph.spans(pieces, word_graph.paths(pieces), found), found, pieces)


def removed(n_words: int, spans: list, window: int):
    """Words under a path, as a mask."""
    import numpy as np

    edge = np.zeros(n_words + 1, np.int32)
    for s in spans or ():
        edge[s["at"]] += 1
        edge[s["at"] + s["n"] - 1 + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def _with_spans(df: DataFrame, key: str, text: str, window: int) -> DataFrame:
    marks = repeated_paths(df, key, text, window)
    rows = df.select(F.col(key), F.xxhash64(F.col(text)).alias("__h"), F.col(text).cast("string").alias("t"))
    return rows.join(marks, rows[key].eqNullSafe(marks["doc"]) & (rows["__h"] == marks["h"]), "left").select(key, "t", "spans")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept): kept words joined by one space."""
    joined = _with_spans(df, key, text, window)
    schema = T.StructType([joined.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(lambda batches: _cut(batches, window, schema.names, lambda kept: kept.decode("utf-8")), schema)


def removal_digests(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256): the same with the kept words' digest in their place."""
    joined = _with_spans(df, key, text, window)
    schema = T.StructType([joined.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(lambda batches: _cut(batches, window, schema.names, lambda kept: hashlib.sha256(kept).hexdigest()), schema)


def _cut(batches: Iterator[pa.RecordBatch], window: int, names: list[str], form) -> Iterator[pa.RecordBatch]:
    from itertools import compress

    for batch in text_slices(batches, "t"):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = split_words(text)
            n_words.append(len(words))
            if spans:
                gone = removed(len(words), spans, window)
                n_removed.append(int(gone.sum()))
                words = compress(words, (~gone).tolist())
            else:
                n_removed.append(0)
            kept.append(form(b" ".join(words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names)


#: The query over ``documents`` in DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents),
starts AS (SELECT rid, unnest(range(1, len(words) - 33)) AS first FROM d WHERE len(words) >= 35),
windows AS (SELECT s.rid, s.first, md5(array_to_string(words[s.first : s.first + 34], ' ')) AS w FROM starts s JOIN d USING (rid)),
marks AS (SELECT rid, first FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
gone AS (SELECT rid, list(DISTINCT p) AS places FROM (SELECT rid, unnest(range(first, first + 35)) AS p FROM marks) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""
