"""Media columns: texts' bytes as 8-bit audio, and log-mel features of it as fixed-shape tensors with time spans.

Payload: the UTF-8 bytes of the whole text, padded with byte 255 to a positive multiple of 576,
stored losslessly as the unsigned 8-bit mono samples of a WAV file. The stored bytes are read back and
resampled by a polyphase filter (2 phases, 3 samples a step; value m lies at 1.5 m samples), cut into overlapping
windowed frames (the last one reaches the end, filled up with silence), and turned into log-mel energies. Frames go
into tensors of a fixed shape (BLOCK_FRAMES x MELS, the last one filled up with FLOOR), stored as an Arrow stream of
Arrow's fixed-shape tensor type with each tensor's time span. Segments come from frame energy with hysteresis: they
begin at a frame above the upper threshold and reach as far as frames stay above the lower one.

Every row is computed by itself and in the same order of operations, so equal texts give equal
values. No shuffle; a worker holds a slice of texts and blocks of frames.

Defined results: null and empty texts are 576 bytes of padding; repeated rows get equal values; only
the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.llm.common import text_slices

UNIT = 576
RATE_IN, UP, DOWN = 12_000, 2, 3
RATE = RATE_IN * UP // DOWN
#: Samples under each phase filter, and the width of their window (Kaiser's beta).
TAPS, BETA = 40, 5.0
FRAME, HOP, FFT = 200, 80, 256
MELS = 20
BLOCK_FRAMES = 32
FLOOR = -100.0
#: Hysteresis thresholds in dB around the median frame energy.
ABOVE, BELOW = 1.0, -0.5
#: Output steps of the resampler taken up at once.
CHUNK_STEPS = 1 << 14
FRAMES_AT_ONCE = 1 << 10


def _phase_filters():
    """(TAPS + 1) x UP: column p weighs the samples from 3 s - TAPS / 2 + 1 on for the value at 3 s + 1.5 p."""
    import numpy as np

    at = np.arange(TAPS + 1) - (TAPS // 2 - 1)
    away = at[:, None] - np.arange(UP) * DOWN / UP
    inside = np.abs(away) < TAPS / 2
    window = np.i0(BETA * np.sqrt(np.where(inside, 1 - (2 * away / TAPS) ** 2, 0))) * inside
    phases = np.sinc(away * UP / DOWN) * window
    return phases / phases.sum(0)


@lru_cache(maxsize=1)
def _filters():
    """Phase filters, the frame window, and the mel matrix."""
    import numpy as np

    window = np.hanning(FRAME + 1)[:FRAME]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    bank = np.maximum(0, np.minimum(up, down))
    return _phase_filters().astype(np.float32), window.astype(np.float32), bank.astype(np.float32)


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff"), len(raw)


def store(samples: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE_IN)
        w.writeframes(samples)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def resample(samples: bytes):
    """UP / DOWN times the rate; each step of DOWN samples gives UP values, one for each phase filter."""
    import numpy as np

    phases = _filters()[0]
    x = np.frombuffer(samples, np.uint8).astype(np.float32)
    x = np.pad((x - 128) / 128, (TAPS // 2 - 1, TAPS // 2 + 1))
    steps = len(samples) // DOWN
    seen = np.lib.stride_tricks.sliding_window_view(x, TAPS + 1)[::DOWN][:steps]
    return np.concatenate([(np.ascontiguousarray(seen[k : k + CHUNK_STEPS]) @ phases).ravel() for k in range(0, steps, CHUNK_STEPS)])


def log_mel(signal):
    """Frames x MELS in dB, and the energy of each frame in dB; the last frame holds the last value."""
    import numpy as np

    _, window, bank = _filters()
    n = 1 + max(0, -(-(len(signal) - FRAME) // HOP))
    signal = np.pad(signal, (0, (n - 1) * HOP + FRAME - len(signal)))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    mels, energy = [], []
    for k in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[k : k + FRAMES_AT_ONCE] * window
        spectrum = np.fft.rfft(part, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        mels.append(10 * np.log10(power @ bank + np.float32(1e-10)))
        energy.append(10 * np.log10((part * part).mean(1) + np.float32(1e-10)))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy) -> list[tuple[int, int]]:
    """Frame ranges [start, stop) that stay above the lower threshold and reach the upper one."""
    import numpy as np

    middle = np.median(energy)
    loose, firm = energy >= middle + BELOW, energy >= middle + ABOVE
    edge = np.diff(np.concatenate([[0], loose.astype(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hits = np.concatenate([[0], np.cumsum(firm)])
    held = hits[stop] > hits[start]
    return list(zip(start[held].tolist(), stop[held].tolist(), strict=True))


def features(samples: bytes) -> tuple:
    """(tensors of BLOCK_FRAMES x MELS, spans in ms, number of frames)."""
    import numpy as np

    mels, energy = log_mel(resample(samples))
    blocks = -(-len(mels) // BLOCK_FRAMES)
    tensors = np.full((blocks * BLOCK_FRAMES, MELS), FLOOR, np.float32)
    tensors[: len(mels)] = mels
    spans = [(a * HOP * 1000 // RATE, ((b - 1) * HOP + FRAME) * 1000 // RATE) for a, b in segments(energy)]
    return tensors.reshape(blocks, BLOCK_FRAMES, MELS), spans, len(mels)


def tensor_stream(tensors) -> bytes:
    """An Arrow stream of (tensor, start_ms, end_ms): tensors of Arrow's fixed-shape type with the time each covers."""
    import numpy as np

    first = np.arange(len(tensors)) * BLOCK_FRAMES
    kind = pa.fixed_shape_tensor(pa.float32(), [BLOCK_FRAMES, MELS])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), BLOCK_FRAMES * MELS)
    columns = [pa.ExtensionArray.from_storage(kind, flat), pa.array(first * HOP * 1000 // RATE), pa.array(((first + BLOCK_FRAMES - 1) * HOP + FRAME) * 1000 // RATE)]
    batch = pa.RecordBatch.from_arrays(columns, ["tensor", "start_ms", "end_ms"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    """The table of an Arrow stream made by ``tensor_stream``."""
    return pa.ipc.open_stream(stream).read_all()


def media(text: str | None) -> tuple[bytes, bytes, list[tuple[int, int]], int]:
    """(stored audio, stored tensors, spans in ms, number of frames); features come from the audio as it is read back."""
    stored = store(payload(text)[0])
    tensors, spans, frames = features(read_back(stored))
    return stored, tensor_stream(tensors), spans, frames


SPAN = T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media, n_frames, tensors, spans): tensors is the Arrow stream of the text's fixed-shape tensors."""
    schema = T.StructType([df.select(key).schema.fields[0], T.StructField("media", T.BinaryType()), T.StructField("n_frames", T.LongType()), T.StructField("tensors", T.BinaryType()), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
        for batch in text_slices(batches, "t", 1 << 20):
            stored, tensors, spans, frames = zip(*map(media, batch.column(1).to_pylist()), strict=True)
            spans = [[{"start_ms": a, "end_ms": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stored, pa.binary()), pa.array(frames, pa.int64()), pa.array(tensors, pa.binary()), pa.array(spans, pair)], schema.names)

    return df.select(F.col(key), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def media_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same columns reduced to digests in the worker, where stored audio and stored tensors are read back."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([df.select(key).schema.fields[0], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])

    def digest(text: str | None) -> tuple:
        import numpy as np

        stored, stream, spans, frames = media(text)
        back = read_back(stored)
        tensors = read_tensors(stream).column("tensor").combine_chunks().to_numpy_ndarray()
        steps = np.round(tensors * 2).astype("<i2")  # half dB
        span_hash = hashlib.sha256(repr(spans).encode()).hexdigest()[:16]
        feature = f"{frames}x{MELS}:{len(tensors)}:{len(spans)}:{span_hash}:{hashlib.sha256(steps.tobytes()).hexdigest()[:32]}"
        return len((text or "").encode("utf-8")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "t", 1 << 20):
            found = list(zip(*map(digest, batch.column(1).to_pylist()), strict=True))
            arrays = [pa.array(x, pa.string() if isinstance(k, T.StringType) else pa.int64()) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema.names)

    return df.select(F.col(key), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
