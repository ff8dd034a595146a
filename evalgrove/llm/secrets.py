"""Secret scans: fixed patterns, and strings that a primed compressor finds novel in a sensitive context.

Base kinds: ``assign`` (a secret's name, a separator, a value of 6 or more characters), ``access`` (an
access key id of 20 or more), ``hex`` (a run of 24 or more). A run that fails its length is dropped, and the
search goes on behind it.

Novelty: candidates are runs of ``SHORTEST`` or more key characters that no base span overlaps and that have a
sensitive word within ``CONTEXT`` code points before them (runs of letters that are part of a longer word are none). In
NAME=value the value is a candidate by itself, so that its name is before it; the whole run is one if no value is
novel. A zstandard compressor is primed with a dictionary: words of configuration files and the words and word parts
of a public tokenizer's vocabulary. Candidates and surroundings are folded alike: identifiers fall apart into
lower-case words, digits and letters are parted. A candidate's novelty is the number of bytes by which the frame of
its surroundings grows when the candidate is put in, over its own length. Identifiers and natural words,
compounds too, are made of parts that the dictionary has; random keys add about as many bytes as they have
characters, as folding tears them apart, and are reported as kind ``novel``. Not found: random keys of lower-case
letters only, which add no more than long words do, and those shorter than the bounds below.

No shuffle; each text is scanned whole, where it is read. Places are code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; ``scan`` carries
all other columns and replaces a column of its output's name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.llm.common import text_slices

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "novel")

# Fixed patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Least characters of a candidate, of one of letters only, and of one of digits only (16 are a card number).
SHORTEST, SHORTEST_LETTERS, SHORTEST_DIGITS = 8, 12, 17
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
VALUE = re.compile(r"(?<==)[A-Za-z0-9+/_-]+(?:=+$)?")  # of an assignment within a candidate, with its padding
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|credential|bearer|private|signature|login", re.IGNORECASE | re.ASCII)

_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_SENSITIVE_HINTS = (b"key", b"secret", b"token", b"passw", b"pwd", b"auth", b"credential", b"bearer", b"private", b"signature", b"login")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

CONTEXT = 64
#: Bytes that a candidate must add for each of its characters.
NOVELTY = 0.75
LEVEL, EXCERPT, EVEN = 9, 512, 256
#: Where FOLDS matches, a word ends.
FOLDS = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_BREAKS = re.compile(r"[^a-z0-9]+")
#: Vocabulary of a public tokenizer whose words prime the compressor, where no other path is given.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Words of configuration files that prime the compressor too, most likely ones last.
IDENTIFIERS = (
    "algorithm allocate argument assert attribute backend boolean branch bucket buffer bytes callback certificate cluster commit compile constructor context controller cookie "
    "credential database debug decode default deploy dictionary digest directory domain encode encrypt endpoint environment exception execute extension factory filename function "
    "gateway handler hash header hostname identifier implements initialize instance integer interface internal iterator json lambda library listener localhost logger manager "
    "metadata middleware module namespace network object offset override package parameter parse payload permission pipeline policy prefix private process production properties "
    "protocol provider proxy public query queue refresh register release remote repository request resource response runtime schema scope security server service session "
    "setting signature signing socket staging storage string subscription template tenant test thread timeout timestamp transaction undefined update upload url username "
    "validate variable vector version webhook worker wrapper api auth access login client account user password secret token key "
    "0123456789 0123456789abcdef abcdefghijklmnopqrstuvwxyz 1234567890 00000000000000000000 xxxxxxxxxxxxxxxxxxxx"
)


def fold(text: str) -> str:
    """Lower-case words, numbers and letter runs of a text or identifier, parted by one space."""
    return _BREAKS.sub(" ", FOLDS.sub(" ", text).lower())


@lru_cache(maxsize=2)
def dictionary(path: str | None = None) -> bytes:
    """What primes the compressor: the letter-only words of 4 or more letters of a vocabulary file (token in base64, rank), and IDENTIFIERS."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]).strip().lower() for line in f if line.strip()]
    words = sorted({t for t in tokens if len(t) >= 4 and t.isalpha()})
    return b" ".join([*words, IDENTIFIERS.encode()])


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, unordered."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low, found = raw.lower(), []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if b"h" * 24 in raw.translate(_HEX_MAP):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class Novelty:
    """A compressor primed with a dictionary."""

    def __init__(self, words: bytes | None = None) -> None:
        import zstandard

        words = words or dictionary()
        words = words or dictionary()
        # a fixed lead: an excerpt keeps every frame compressed, even bytes keep its literals whole, so that frames differ by content only
        even = b"".join(hashlib.sha256(bytes([k])).digest() for k in range(EVEN // 32))
        self.lead = words[len(words) // 2 :][:EXCERPT] + even
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.size = lambda b, c=zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False): len(c.compress(b))

    def of(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds to its surroundings, over its own characters."""
        around = self.lead + (" " + fold(before) + fold(after) + " ").encode()
        return (self.size(around + fold(candidate).encode()) - self.size(around)) / len(candidate)

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        found, taken, at = [], sorted(base), 0
        hints = [m.end() for m in SENSITIVE.finditer(text)]

        def novel(start: int, end: int) -> bool:
            k = at
            while k < len(taken) and taken[k][0] < end:
                if taken[k][1] > start:
                    return False
                k += 1
            hint = bisect_left(hints, start + 1) - 1  # the last one that ends before
            if hint < 0 or hints[hint] <= start - CONTEXT:
                return False
            own, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
            if not SENSITIVE.search(before) or own.isdigit() and len(own) < SHORTEST_DIGITS:
                return False
            if own.isalpha() and (len(own) < SHORTEST_LETTERS or before[-1:].isalpha() or after[:1].isalpha()):
                return False
            return self.of(before, own, after) >= NOVELTY

        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            values = [(start + v.start(), start + v.end()) for v in VALUE.finditer(m[0]) if v.end() - v.start() >= SHORTEST]
            found += [(a, b, "novel") for a, b in values if novel(a, b)] or ([(start, end, "novel")] if novel(start, end) else [])
        return found


def find(text: str | None, novelty: Novelty) -> list[tuple[int, int, str]]:
    """All spans, by start and then kind."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = base_spans(text, raw)
    low = raw.lower()
    if any(h in low for h in _SENSITIVE_HINTS):
        found = found + novelty.spans(text, found)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _shared(df: DataFrame, vocabulary: str | None):
    """The dictionary (200 KB, a fixed size) as a broadcast value, so executors need no file."""
    return df.sparkSession.sparkContext.broadcast(dictionary(vocabulary))


def scan(df: DataFrame, text: str = "text", out: str = "spans", vocabulary: str | None = None) -> DataFrame:
    """Add ``out``: array of struct(kind, start, end), in order. vocabulary: path of a vocabulary file that primes the compressor."""
    words = _shared(df, vocabulary)
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out, T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words.value)
        for batch in text_slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in find(t, novelty)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _ARROW_SPANS)], [*batch.schema.names, out])

    return df.select(*kept).mapInArrow(run, schema)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span, or each run of overlapping spans, replaced by a mark."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()} REMOVED]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The same rows with secrets in ``text`` replaced; null stays null."""
    words = _shared(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words.value)
        for batch in text_slices(batches, text):
            at = batch.schema.get_field_index(text)
            clean = pa.array([redacted(t, find(t, novelty)) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([clean if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def span_digests(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Counts and joined forms of the spans, made where they are found."""
    words = _shared(df, vocabulary)
    schema = T.StructType([df.select(key).schema.fields[0], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words.value)
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        for batch in text_slices(batches, "t"):
            every = [find(t, novelty) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in every], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(joined(s for s in spans if s[2] != "novel").encode()).hexdigest() for spans in every]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base), pa.array(map(joined, every), pa.string())], schema.names)

    return df.select(F.col(key), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
