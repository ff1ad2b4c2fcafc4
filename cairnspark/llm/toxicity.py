"""Toxicity (5): FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import by_bytes, map_arrow, unit_hash

BITS = 20
#: Everything in ASCII but letters, digits and bytes of other alphabets parts words; A-Z are lower-cased.
_TO_WORDS = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _slots(a: np.ndarray, salt: int) -> np.ndarray:
    x = (a + np.uint64(salt)) * _A
    return ((x ^ (x >> np.uint64(31))) * _B >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Slots of the words, pairs of neighbours and pairs with one word between; with repeats, whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    return np.concatenate([_slots(h, 1), _slots(h[:-1] * _A + h[1:], 2), _slots(h[:-2] * _A + h[2:], 3)])


class Ftrl:
    """Per-coordinate rates, L1 and L2; presence features; slot 2**BITS is the intercept, which L1 spares.

    ``choose_rates`` compares values of ``alpha`` and ``l1`` on training labels alone; the README has its figures.
    """

    def __init__(self, alpha: float = 4.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


class ToxicityModel:
    """The non-zero weights: compact, and no more than the features of a bounded sample."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, intercept: float):
        self.at, self.weights, self.intercept = at, weights, intercept
        self._table = None

    def __getstate__(self):
        return {"at": self.at, "weights": self.weights, "intercept": self.intercept, "_table": None}

    @classmethod
    def fit(cls, rows: list[tuple[bytes, int]], passes: int = 4, seed: int = 3, **rates: float) -> ToxicityModel:
        """``rows``: packed slots and label."""
        learner, end = Ftrl(**rates), np.array([1 << BITS])
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            for i in rng.permutation(len(rows)):
                learner.learn(np.concatenate([_unpacked(rows[i][0]), end]), rows[i][1])
        at = np.flatnonzero(np.abs(learner.z[:-1]) > learner.l1)
        return cls(at, learner.weights(at), float(learner.weights(end)[0]) if rows else -4.0)

    def log_loss(self, rows: list[tuple[bytes, int]]) -> float:
        """Mean over packed slots and labels; 0 without rows."""
        table = np.zeros(1 << BITS)
        table[self.at] = self.weights
        margins = np.array([table[_unpacked(slots)].sum() + self.intercept for slots, _ in rows])
        signs = np.array([1 if label else -1 for _, label in rows])
        return float(np.logaddexp(0, -margins * signs).mean()) if rows else 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << BITS)
            self._table[self.at] = self.weights
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            slots = features(text)
            slots = np.unique(slots[self._table[slots] != 0])
            out[i] = self._table[slots].sum() + self.intercept
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_chars: int = 50_000, seed: int = 5) -> list[tuple[bytes, int]]:
    """Packed slots and label of about ``max_rows`` labelled documents at most, drawn alike from both labels, by ascending doc_id.

    A document's label is the largest of its labels; null labels and ids are left out, as are sampled texts of more than
    ``max_chars`` characters. The drawn ids, bounded by ``max_rows``, are broadcast, so that no text is shuffled.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = max_rows / max(1, named.count())
    drawn = F.broadcast(named.where(unit_hash(F.lit(seed), "doc_id") < share))  # about max_rows ids

    def extract(batches):
        for batch in by_bytes(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_packed(np.unique(features(t))) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "toxic", "slots"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).join(drawn, "doc_id")
    found = rows.select("doc_id", "toxic", "text").transform(map_arrow, extract, "doc_id long, toxic int, slots binary").toArrow()
    order = np.lexsort((found.column("toxic").to_numpy(), found.column("doc_id").to_numpy()))
    slots, toxic = found.column("slots"), found.column("toxic").to_numpy()
    return [(slots[int(i)].as_py(), int(toxic[i] > 0)) for i in order]


def fit_toxicity(docs: DataFrame, labels: DataFrame, **rates: float) -> ToxicityModel:
    """Fits on the labelled sample."""
    return ToxicityModel.fit(labelled_sample(docs, labels), **rates)


def choose_rates(docs: DataFrame, labels: DataFrame, alphas=(0.5, 1.0, 2.0, 4.0, 8.0, 16.0), l1s=(2.0, 4.0, 8.0, 16.0), parts: int = 4) -> DataFrame:
    """alpha, l1, log_loss and weights (how many aren't zero) for each pair of rates, a task for each.

    ``labels`` are the training labels alone. One of ``parts`` parts of the labelled sample is kept from fitting and
    gives the loss; rows with the same slots, such as copies, are in the same part. Without labels every loss is 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(labelled_sample(docs, labels))  # max_rows rows of compressed slots

    def measure(batches):
        kept = [zlib.crc32(slots) % parts == 0 for slots, _ in shared.value]
        fitted, compared = ([r for r, k in zip(shared.value, kept, strict=True) if k == side] for side in (False, True))
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            models = [ToxicityModel.fit(fitted, alpha=a, l1=b) for a, b in pairs]
            columns = ([a for a, _ in pairs], [b for _, b in pairs], [m.log_loss(compared) for m in models], [len(m.at) for m in models])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.float64(),) * 3 + (pa.int64(),), strict=True)], ["alpha", "l1", "log_loss", "weights"])

    grid = [(float(a), float(b)) for a in alphas for b in l1s]
    rates = spark.createDataFrame(grid, "alpha double, l1 double").repartitionByRange(len(grid), "alpha", "l1")
    return rates.transform(map_arrow, measure, "alpha double, l1 double, log_loss double, weights long")


def _packed(slots: np.ndarray) -> bytes:
    """Ascending slots as compressed steps: the sample is on the driver for as long as it is learned from."""
    return zlib.compress(np.diff(slots, prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every whole text; a null or empty text has the intercept's score. Keeps ``held_out`` if it is there."""
    flag = ["held_out"] if "held_out" in docs.columns else []

    def apply(batches):
        for batch in by_bytes(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist())), *([batch.column(2)] if flag else [])], ["doc_id", "score", *flag])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *flag).transform(map_arrow, apply, "doc_id long, score double" + ", held_out boolean" * bool(flag))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """Learns from labelled rows where ``held_out`` (a function of doc_id) is false, scores all.

    Repeated rows and null ids are scored each; other columns are ignored; without labels every score
    is the same low one; an empty table gives no rows.
    """
    model = fit_toxicity(docs, labels.where(~held_out))
    return score(docs.select("doc_id", "text", held_out.alias("held_out")), model)


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that the model rejects, all columns as they are.

    Null and empty texts have no features and get the model's bias alone; repeated rows and ties are judged by their
    text alone, so alike; an empty table stays empty.
    """
    model = fit_toxicity(docs, labels.where(~held_out))
    names = docs.columns
    place = names.index("text")

    def keep(batches):
        for batch in by_bytes(batches, place):
            yield batch.filter(pa.array(model.scores(batch.column(place).to_pylist()) < threshold))

    return docs.transform(map_arrow, keep, docs.schema)
