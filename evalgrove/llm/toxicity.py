"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (``ORDERS`` characters) of the lower-cased text with each run of ASCII white space as one
space, hashed to ``SLOTS`` slots; a feature is present or absent. With p and q the smoothed shares of
toxic and other documents that have a feature, its ratio is r = log(p / q) over the whole sample; a
logistic regression with an L2 penalty is trained on x * r (Wang and Manning, 2012), over the features
whose shares differ by ``SURE`` standard errors.

The model is fitted on at most ``SAMPLE`` labelled rows of each class (the first by md5 of doc_id), so
driver memory is bounded; the intercept is moved back to the share of toxic rows among all
labelled rows of the training fold. Scoring reads every whole text where it is; no shuffle.

Defined results: an empty or null text has no features and gets the intercept's score; without
labels of both classes every score is the smoothed share of toxic labels; labels that are
null are not used; a doc_id labelled twice counts as toxic if any label says so. Null doc_ids are
hashed as an empty string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.llm.common import text_slices

ORDERS = (3, 5, 7)
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
SAMPLE = 3_000
SMOOTH = 1.0
PENALTY = 1e-4
STEPS = 200
RATE = 0.05
#: A feature is used if its shares in the two classes differ by this many standard errors, in this many documents.
SURE = 4.5
LEAST_DOCUMENTS = 2
THRESHOLD = 0.7
#: Characters hashed at once.
CHUNK = 1 << 20


def slots(text: str | None) -> Iterator:
    """Slots of a text's n-grams, repeats included, in blocks."""
    import numpy as np

    raw = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())
    if not raw:
        return
    codes = np.frombuffer(f" {raw.decode('utf-8', 'surrogatepass')} ".encode("utf-32-le", "surrogatepass"), "<u4")
    most = max(ORDERS)
    for start in range(0, len(codes), CHUNK):
        part = codes[start : start + CHUNK + most - 1].astype(np.uint64)
        h, done = part, 1
        for n in ORDERS:
            size = len(part) - n + 1
            if size <= 0:
                break
            h = h[:size]
            for k in range(done, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + part[k : k + size]
            done = n
            yield ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * n)) >> np.uint64(64 - SLOT_BITS)


def features(text: str | None):
    """Distinct slots of a text's n-grams."""
    import numpy as np

    seen = np.zeros(SLOTS, bool)
    for found in slots(text):
        seen[found] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: object  # float32, one a slot; 0 where a feature is not used
    intercept: float

    def __post_init__(self):
        self.used = self.weights != 0

    def score(self, text: str | None) -> float:
        import numpy as np

        hits = [s[self.used[s]] for s in slots(text)]
        z = self.intercept
        if hits:
            z += float(self.weights[np.unique(np.concatenate(hits))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(texts: list[str | None], toxic, share: float) -> Model:
    """Train on a bounded sample; ``share`` of toxic rows in the fold it was drawn from."""
    import numpy as np

    toxic = np.asarray(toxic, bool)
    logit = lambda p: float(np.log(p / (1 - p)))
    if not toxic.any() or toxic.all():
        return Model(np.zeros(SLOTS, np.float32), logit(min(max(share, 0.01), 0.99)))
    y = toxic.astype(np.float64)
    n1, n0 = y.sum(), (1 - y).sum()
    positive, negative = np.zeros(SLOTS), np.zeros(SLOTS)
    for t, is_toxic in zip(texts, toxic, strict=True):  # features are made twice rather than kept
        (positive if is_toxic else negative)[features(t)] += 1
    p, q = (positive + SMOOTH) / (n1 + 2 * SMOOTH), (negative + SMOOTH) / (n0 + 2 * SMOOTH)
    pooled = (positive + negative) / (n1 + n0)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n1 + 1 / n0))
    used = (np.abs(positive / n1 - negative / n0) / spread >= SURE) & (positive + negative >= LEAST_DOCUMENTS)
    ratio = np.where(used, np.log(p / q), 0.0)
    place = np.cumsum(used) - 1
    width = int(used.sum())
    kept = [place[x[used[x]]] for x in map(features, texts)]
    sizes = np.array([len(x) for x in kept])
    slot = np.concatenate(kept).astype(np.int64)
    row = np.repeat(np.arange(len(kept)), sizes)
    scale = ratio[used][slot]
    # weights of the classes in the loss are even; the prior comes back at the end
    cost = np.where(toxic, 0.5 / n1, 0.5 / n0)
    w, b = np.full(width, 0.02), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        z = np.bincount(row, scale * w[slot], len(kept)) + b
        g = cost * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grad = np.append(np.bincount(slot, scale * g[row], width) + PENALTY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = w * ratio[used]
    return Model(weights, b + logit(share))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled documents outside the held-out fold; at most ``sample`` of each class come to the driver.

    The sample is chosen by key alone and then looked up, so no text is shuffled.
    """
    known = documents.select(key).filter(~held_out(key)).distinct()
    own = labels.filter(F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias(label)).join(known, key)
    counts = {int(r[0]): r[1] for r in own.groupBy(label).count().collect()}  # a row for each label
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    chosen = [own.filter(F.col(label) == value).orderBy(order, key).limit(sample).select(key, label) for value in (1, 0)]
    ids = chosen[0].unionByName(chosen[1])  # 2 * sample rows of a key and a label
    rows = documents.select(key, text).join(F.broadcast(ids), key).groupBy(key).agg(F.min(text).alias(text), F.max(label).alias(label))
    found = sorted(rows.collect(), key=lambda r: str(r[0]))
    return fit([r[1] for r in found], [int(r[2]) == 1 for r in found], share)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # 4 MB, a fixed size
    schema = T.StructType([df.select(key).schema.fields[0], T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in text_slices(batches, "t"):
            found = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], [key, "score"])

    return df.select(F.col(key), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """The fold that is never trained on."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1
