"""Language ID (2): blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression.

k(x, y) = mean over n of |grams_n(x) & grams_n(y)| / sqrt(|grams_n(x)| * |grams_n(y)|), where grams_n(x)
is the set of distinct character n-grams of x that some landmark has often enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.common import by_bytes, map_arrow, unit_hash

SIZES = (1, 2, 3, 4)
SCHEMA = "doc_id long, lang_pred string, score double"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x30000)]))
    return _letters[0]


def code_points(text: str) -> np.ndarray | None:
    """Lower-cased letters, each run of anything else as one space, a space at either end; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    table = _letter_table()
    letter = table[np.minimum(codes, len(table) - 1)]
    if not letter.any():
        return None
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint64)
    space = codes == 32
    return codes[~(space & np.concatenate([[False], space[:-1]]))]


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each n, a 64-bit value of every window of n code points."""
    out, h = [], None
    for n in SIZES:
        if len(codes) < n:
            out.append(np.zeros(0, np.uint64))
            continue
        h = codes.copy() if h is None else h[:-1] * _MIX + codes[n - 1 :]
        out.append((h ^ (h >> np.uint64(29))) * _MIX + np.uint64(n))
    return out


class StringKernel:
    """A fitted model: a vocabulary and a weight matrix for each n, and the classes. Its size is bounded by its parameters."""

    def __init__(self, vocabularies: list[np.ndarray], weights: list[np.ndarray], classes: list[str]):
        self.vocabularies, self.weights, self.classes = vocabularies, weights, classes
        self._tables = None

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], landmarks: int = 240, vocabulary: int = 4096, ridge: float = 1e-3, seed: int = 7) -> StringKernel:
        codes = [(code_points(t), y) for t, y in zip(texts, labels, strict=True)]
        grams = [(gram_hashes(c), y) for c, y in codes if c is not None]
        classes = sorted({y for _, y in grams})
        if not classes:
            return cls([], [], [])
        rng = np.random.default_rng(seed)
        marks = []
        for y in classes:
            own = [i for i, g in enumerate(grams) if g[1] == y]
            marks += list(rng.permutation(own)[: max(1, landmarks // len(classes))])
        vocabularies, presence = [], []
        for k in range(len(SIZES)):
            found, counts = np.unique(np.concatenate([np.unique(grams[i][0][k]) for i in marks]), return_counts=True)
            vocabularies.append(np.sort(found[np.lexsort((found, -counts))[:vocabulary]]))
            rows = np.zeros((len(grams), len(vocabularies[k])), np.float32)
            for i, (g, _) in enumerate(grams):
                at = np.searchsorted(vocabularies[k], g[k])
                at = np.minimum(at, len(vocabularies[k]) - 1)
                rows[i, at[vocabularies[k][at] == g[k]]] = 1
            presence.append(rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)))
        # Nystroem: features of all samples from their kernel values with the landmarks.
        kernel = sum(p.astype(np.float64) @ p[marks].T for p in presence) / len(SIZES)
        values, vectors = np.linalg.eigh(kernel[marks])
        keep = values > values.max() * 1e-6
        project = vectors[:, keep] / np.sqrt(values[keep])
        features = np.hstack([kernel @ project, np.ones((len(grams), 1))])
        target = np.array([[1.0 if y == c else -1.0 for c in classes] for _, y in grams])
        weight = 1 / np.array([sum(g[1] == y for g in grams) for _, y in grams])[:, None]  # classes count alike
        solved = np.linalg.solve(features.T @ (features * weight) + ridge * np.eye(features.shape[1]), features.T @ (target * weight))
        dual = project @ solved[:-1]  # one weight for each landmark and class
        weights = [(p[marks].T @ dual / len(SIZES)).astype(np.float32) for p in presence]
        return cls(vocabularies, [*weights, solved[-1:].astype(np.float32)], classes)

    def decide(self, texts: list[str | None], block: int = 256) -> tuple[list[str], list[float]]:
        """Blocks of presence rows times the landmark weights; a softmax of the class scores."""
        if self._tables is None:
            self._tables = []
            for v in self.vocabularies:
                table = np.full(1 << 18, -1, np.int32)
                table[(v >> np.uint64(46)).astype(np.int64)] = np.arange(len(v))
                lost = np.flatnonzero(table[(v >> np.uint64(46)).astype(np.int64)] != np.arange(len(v)))
                self._tables.append((table, v[lost], lost))
        names, scores = [], []
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            known = np.zeros(len(part), bool)
            rows = [np.zeros((len(part), len(v)), np.float32) for v in self.vocabularies]
            for i, text in enumerate(part):
                codes = code_points(text) if text else None
                if codes is None or not self.classes:
                    continue
                known[i] = True
                for k, h in enumerate(gram_hashes(codes)):
                    table, rest, places = self._tables[k]
                    hit = table[(h >> np.uint64(46)).astype(np.int64)]
                    hit = hit[hit >= 0][self.vocabularies[k][hit[hit >= 0]] == h[hit >= 0]]
                    rows[k][i, hit] = 1
                    if len(rest):
                        rows[k][i, places[np.isin(rest, h)]] = 1
            if self.classes:
                total = self.weights[-1] + sum((r / np.sqrt(np.maximum(r.sum(1, keepdims=True), 1))) @ w for r, w in zip(rows, self.weights, strict=False))
                odds = np.exp(4 * (total - total.max(1, keepdims=True)))
                best, share = total.argmax(1), odds.max(1) / odds.sum(1)
            for i in range(len(part)):
                names.append(self.classes[best[i]] if known[i] else "und")
                scores.append(float(share[i]) if known[i] else 0.0)
        return names, scores


def fit_language_id(labelled: DataFrame, per_language: int = 300, max_chars: int = 20_000, max_texts: int = 6_000, seed: int = 11) -> StringKernel:
    """Fits on a bounded sample: ``per_language`` distinct texts of each language at most, none longer than ``max_chars``, and
    ``max_texts`` in all: with more languages each has fewer, one at least. Of more languages than that those with most texts are learned.

    ``labelled`` has text and lang; rows with a null in either are left out. Texts are drawn by a hash, and a text
    that many rows repeat is one text. A language with longer texts alone has none to learn from. What reaches the driver is the sample itself,
    ranked by its hash in Spark.
    """
    spark = labelled.sparkSession
    usable = labelled.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("hash")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= max_chars))
    sizes = usable.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_texts).toArrow()  # a row for each language, max_texts at most
    per_language = max(1, min(per_language, max_texts // max(1, sizes.num_rows)))
    # A margin over the quota, wide for small ones, so that a language hardly ever falls short of it, and a rank has few rows to sort.
    shares = np.minimum(1.0, (1.3 * per_language + 20) / np.maximum(1, sizes.column("n").to_numpy()))
    table = spark.createDataFrame(pa.table({"lang": sizes.column("lang").combine_chunks(), "share": pa.array(shares, pa.float64())}))
    rows = usable.join(F.broadcast(table), "lang").withColumn("u", unit_hash(F.lit(seed), "hash")).where("u < share")
    drawn = rows.dropDuplicates(["lang", "hash"]).select("u", "text", "lang")
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))).where(F.col("rank") <= per_language)
    chosen = [(r["text"], r["lang"]) for r in sorted(ranked.collect(), key=lambda r: (r["u"], r["text"], r["lang"]))]  # max_texts at most
    return StringKernel.fit([t for t, _ in chosen], [y for _, y in chosen])


def identify(docs: DataFrame, model: StringKernel) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every whole text, and ``held_out`` if ``docs`` has it.

    ``und`` with score 0: a null text, or one without letters, or a model that learned no language.
    """
    flag = "held_out" if "held_out" in docs.columns else None

    def decide(batches):
        for batch in by_bytes(batches, 1):
            names, scores = model.decide(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *([batch.column(2)] if flag else [])], ["doc_id", "lang_pred", "score", *([flag] if flag else [])])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([flag] if flag else []))
    return rows.transform(map_arrow, decide, SCHEMA + (", held_out boolean" if flag else ""))


def language_id(docs: DataFrame, held_out) -> DataFrame:
    """Learns from rows where ``held_out`` is false, predicts for all. Null ids and repeated rows stay; an empty table gives no rows."""
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    return identify(rows, fit_language_id(rows.where(~F.col("held_out"))))
