"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the vocabulary's pattern; each piece is encoded by itself. A piece that is a token
as a whole is that token. Otherwise a segment tree whose leaf i holds the rank of the pair formed by
the live token starting at byte i and its right neighbour yields the leftmost minimum in
logarithmic time; a merge changes at most three leaves. Short pieces go through the same trees in
arrays, many pieces side by side; long ones have a tree of their own.

No shuffle: rows stay where they are read. Worker memory is bounded by a slice of texts (longer
texts go in blocks that end between pieces) and a store of known pieces of fixed size. Pieces are
looked up by a 64-bit hash; the ids of each slice are decoded and compared with its bytes, and
encoded again piece by piece should they differ.

Defined results: null and empty texts encode to no ids and decode to no bytes; repeated rows are
encoded alike; other columns are carried through ``encode`` by name (the output column replaces a
column of its own name).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.llm.common import text_slices

#: Pieces that a task keeps encoded (about 50 bytes each); they go when it ends.
KEPT_PIECES = 250_000
#: Code points, and bytes of texts, taken up at once (a block needs about 60 times as many bytes).
BLOCK_CHARS = 1 << 19
SLICE = 1 << 19
#: Pieces of more bytes get a segment tree of their own; shorter ones share arrays of ROWS trees.
WIDEST = 64
ROWS = 1 << 13
_NONE = 1 << 62


class MergeTree:
    """Leftmost minimum pair rank over byte positions."""

    def __init__(self, leaves: list[int]):
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.low = [_NONE] * self.width + leaves + [_NONE] * (self.width - len(leaves))
        for at in range(self.width - 1, 0, -1):
            self.low[at] = min(self.low[2 * at], self.low[2 * at + 1])

    def put(self, leaf: int, rank: int) -> None:
        low, at = self.low, leaf + self.width
        low[at] = rank
        while at > 1:
            at >>= 1
            best = low[2 * at] if low[2 * at] <= low[2 * at + 1] else low[2 * at + 1]
            if low[at] == best:
                return
            low[at] = best

    def leftmost(self) -> int:
        """The first leaf that holds the minimum, or -1 if no pair is left."""
        low, at = self.low, 1
        if low[1] == _NONE:
            return -1
        while at < self.width:
            at = 2 * at + (low[2 * at] > low[2 * at + 1])
        return at - self.width


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = lambda i: ranks.get(piece[i : after[after[i]]], _NONE) if after[i] < n else _NONE
    tree = MergeTree([rank(i) for i in range(n)])
    while (i := tree.leftmost()) >= 0:
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        tree.put(gone, _NONE)
        tree.put(i, rank(i))
        if before[i] >= 0:
            tree.put(before[i], rank(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pairs:
    """Rank of the token that two neighbouring tokens form, for whole arrays: a sorted table of all splits of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        found = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, values = np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], _NONE)

    def rank(self, left, right):
        import numpy as np

        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)


def merge_pieces(pieces: list[bytes], width: int, byte_ids, pairs: Pairs) -> tuple:
    """The same merges for many pieces of at most ``width`` bytes (a power of two): one segment tree a row, a merge a step in each row.

    Returns all ids in order, and the number of ids of each piece.
    """
    import numpy as np

    n, wide = len(pieces), width + 1
    size = np.fromiter(map(len, pieces), np.int64, n)
    tokens = np.zeros((n, wide), np.int64)
    tokens[:, :width] = byte_ids[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)].reshape(n, width)
    live = np.arange(wide) < size[:, None]
    low = np.full((n, 2 * width), _NONE, np.int64)
    low[:, width : 2 * width - 1] = np.where(live[:, 1:width], pairs.rank(tokens[:, : width - 1], tokens[:, 1:width]), _NONE)
    for at in range(width - 1, 0, -1):
        np.minimum(low[:, 2 * at], low[:, 2 * at + 1], out=low[:, at])
    after, before = np.tile(np.arange(1, wide + 1), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
    low, tokens, after, before, flags = low.ravel(), tokens.ravel(), after.ravel(), before.ravel(), live.ravel()
    rows = np.arange(n)
    while len(rows := rows[low[rows * 2 * width + 1] < _NONE]):
        tree, row, end = rows * 2 * width, rows * wide, size[rows]
        at = np.ones(len(rows), np.int64)
        while at[0] < width:
            at = 2 * at + (low[tree + 2 * at] > low[tree + 2 * at + 1])
        i = at - width
        gone = after[row + i]
        next_ = after[row + gone]
        tokens[row + i] = low[tree + at]
        after[row + i] = next_
        flags[row + gone] = False
        before[row + next_] = i
        prior = before[row + i]
        low[tree + width + gone] = _NONE
        low[tree + at] = np.where(next_ < end, pairs.rank(tokens[row + i], tokens[row + np.minimum(next_, width)]), _NONE)
        has = prior >= 0
        low[(tree + width + prior)[has]] = pairs.rank(tokens[(row + prior)[has]], tokens[(row + i)[has]])
        for leaf in (gone, i, np.where(has, prior, i)):
            up = (leaf + width) >> 1
            while up[0]:
                low[tree + up] = np.minimum(low[tree + 2 * up], low[tree + 2 * up + 1])
                up >>= 1
    return tokens[flags], live.sum(1)


#: The pattern that split_runs() answers without a regular expression (fixed value).
RUNS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def _classes():
    """Class of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    import numpy as np
    import regex

    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    kind = np.full(0x110000, 3, np.uint8)
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = value
    return kind


def split_runs(points, first):
    """Where the pieces of RUNS_PATTERN start, from runs of one class. first: starts of the texts within ``points``."""
    import numpy as np

    n = len(points)
    kind = _classes()[points]
    own = np.zeros(n + 1, bool)  # a text starts here
    own[first[first < n]] = own[n] = True
    run = own.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(run)
    start, end = at[:-1], at[1:]
    piece = run[:n].copy()
    # white space before something else of the same text: its last one goes along if it is a space, else stands alone
    gap = (kind[start] == 0) & ~own[end]
    a, b = start[gap], end[gap]
    piece[b - 1] = True
    piece[b[points[b - 1] == 32]] = False
    # an apostrophe that begins a piece takes one of the endings with it
    lone = (kind[start] == 3) & (end - start == 1) & (points[start] == 39) & piece[start] & ~own[end]
    i = start[lone]
    i = i[kind[i + 1] == 1]
    if len(i):
        one, two = points[i + 1], np.where(i + 2 < n, points[np.minimum(i + 2, n - 1)], 0)
        two = np.where(own[i + 2], 0, two)
        is_ = lambda x, c: x == ord(c)
        taken = np.where(is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d"), 1, np.where((is_(one, "r") | is_(one, "v")) & is_(two, "e") | is_(one, "l") & is_(two, "l"), 2, 0))
        i, taken = i[taken > 0], taken[taken > 0]
        piece[i + 1] = False
        rest = (i + 1 + taken)[i + 1 + taken < n]
        piece[rest[kind[rest] == 1]] = True
    return np.flatnonzero(piece)


class Codec:
    def __init__(self, vocabulary: bytes, pattern: str):
        import numpy as np
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.token = {i: b for b, i in self.ranks.items()}
        self.by_runs = pattern == RUNS_PATTERN
        # \s of this library also takes U+001C..U+001F, which are no Unicode white space
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.gap = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
        self.pairs = Pairs(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        top = max(self.token) + 1
        self.token_size = np.array([len(self.token.get(i, b"")) for i in range(top)], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(top)), np.uint8)
        self.letters = np.random.default_rng(9).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.known, self.known_at, self.known_n, self.store = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _starts(self, text: str, points, first):
        import numpy as np

        if self.by_runs:
            return split_runs(points, first)
        found, bounds = [], [*first.tolist(), len(points)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            found += [a + m.start() for m in self.pattern.finditer(text[a:b])]
        return np.array(found, np.int64)

    def _hashes(self, raw, start, size):
        import numpy as np

        most = int(size.max())
        if len(self.powers) < most:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.full(2 * most, 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(raw), dtype=np.int32)
        place -= np.repeat(start.astype(np.int32), size)
        with np.errstate(over="ignore"):
            letters = self.letters[raw]
            letters *= self.powers[place]
            h = np.add.reduceat(letters, start) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def _learn(self, raw, hashes, start, size) -> None:
        """Encode pieces that are not known: hashes in order, places in ``raw``."""
        import numpy as np

        if len(self.known) + len(hashes) > KEPT_PIECES:
            self.forget()
        order, ids, counts = [], [], []
        width = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        for wide in np.unique(width).tolist():
            of = np.flatnonzero(width == wide)
            for part in (of[k : k + ROWS] for k in range(0, len(of), ROWS)):
                pieces = [raw[a : a + n].tobytes() for a, n in zip(start[part].tolist(), size[part].tolist(), strict=True)]
                if wide <= WIDEST:
                    found, n = merge_pieces(pieces, wide, self.byte_ids, self.pairs)
                    whole = [(k, self.ranks[x]) for k, x in enumerate(pieces) if n[k] > 1 and x in self.ranks]
                    if whole:  # a token that its own merges do not reach
                        split = np.split(found, np.cumsum(n)[:-1])
                        for k, i in whole:
                            split[k], n[k] = np.array([i]), 1
                        found = np.concatenate(split)
                else:
                    lists = [merge_piece(x, self.ranks) for x in pieces]
                    found, n = np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists])
                order.append(part)
                ids.append(found.astype(np.uint32))
                counts.append(n)
        order, counts = np.concatenate(order), np.concatenate(counts)
        known = np.concatenate([self.known, hashes[order]])
        at = np.concatenate([self.known_at, len(self.store) + np.cumsum(counts) - counts])
        n = np.concatenate([self.known_n, counts])
        self.store = np.concatenate([self.store, *ids])
        by = np.argsort(known, kind="stable")
        self.known, self.known_at, self.known_n = known[by], at[by], n[by]

    def _block(self, texts: list[str]):
        """Ids of all texts in one array, and how many each has."""
        import numpy as np

        text = "".join(texts)
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        starts = self._starts(text, points, first)
        byte = np.flatnonzero((raw & 0xC0) != 0x80)  # where each code point begins
        start = byte[starts]
        size = np.diff(start, append=len(raw))
        hashes = self._hashes(raw, start, size)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
            new = self.known[near] != unique
        else:
            new = np.ones(len(unique), bool)
        if new.any():
            if len(self.known) + int(new.sum()) > KEPT_PIECES:
                self.forget()
                new[:] = True
            self._learn(raw, unique[new], start[where[new]], size[where[new]])
        near = np.searchsorted(self.known, unique)
        at, n = self.known_at[near][inverse], self.known_n[near][inverse]
        ends = np.cumsum(n)
        ids = self.store[np.arange(int(ends[-1])) + np.repeat(at - (ends - n), n)]
        edge = np.concatenate([[0], ends])[np.searchsorted(starts, np.append(first, len(points)))]
        if not np.array_equal(self._bytes(ids), raw):  # two pieces with one hash
            lists = [[i for m in self.pattern.finditer(t) for i in merge_piece(m[0].encode("utf-8"), self.ranks)] for t in texts]
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        return ids, np.diff(edge)

    def _bytes(self, ids):
        import numpy as np

        n = self.token_size[ids]
        ends = np.cumsum(n)
        return self.token_bytes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.token_at[ids] - (ends - n), n)]

    def _cut(self, text: str) -> Iterator[str]:
        """Blocks that end where a piece ends, at white space after something else."""
        start = 0
        while start < len(text):
            m = self.gap.search(text, start + BLOCK_CHARS) if len(text) - start > BLOCK_CHARS else None
            stop = m.start() if m else len(text)
            yield text[start:stop]
            start = stop

    def encode_all(self, texts: list[str]) -> Iterator[list]:
        """For each text, its ids as a list of arrays."""
        import numpy as np

        if any(len(t) > BLOCK_CHARS for t in texts):
            for text in texts:
                yield [self._block([part])[0] for part in self._cut(text)] or [np.zeros(0, np.uint32)]
            return
        ids, counts = self._block(texts)
        ends = np.cumsum(counts).tolist()
        for n, end in zip(counts.tolist(), ends, strict=True):
            yield [ids[end - n : end]]

    def encode(self, text: str) -> list[int]:
        return [i for part in next(self.encode_all([text])) for i in part.tolist()]

    def decode(self, ids: Iterable[int]) -> bytes:
        import numpy as np

        return self._bytes(np.asarray(ids, np.int64)).tobytes()


@lru_cache(maxsize=2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _shared(df: DataFrame, path: str):
    """The rank file (under 1 MB, a fixed size) as a broadcast value, so executors need no copy of it."""
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(path))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add ``ids``: array of token ids of each whole text."""
    shared = _shared(df, path)
    kept = [c for c in df.columns if c != ids]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = codec(shared.value, pattern)
        for batch in text_slices(batches, text, SLICE):
            found = [np.concatenate(x) for x in c.encode_all([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])]
            values = pa.array(np.concatenate(found).astype(np.int32))
            offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, values)], [*batch.schema.names, ids])
        c.forget()

    return df.select(*kept).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the ids stand for; null ids give no bytes."""
    shared = _shared(df, path)
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            found = [c.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out])

    return df.select(*kept).mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids, and keep counts and digests of both (ids never leave the worker)."""
    shared = _shared(df, path)
    key_field = df.select(key).schema.fields[0]
    schema = T.StructType([key_field, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in text_slices(batches, "t", SLICE):
            counts, of_ids, of_bytes = [], [], []
            for found in c.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for block in found:
                    n += len(block)
                    a.update(block.astype("<u4").tobytes())
                    b.update(c.decode(block))
                counts.append(n)
                of_ids.append(a.hexdigest())
                of_bytes.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    return df.select(F.col(key), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
