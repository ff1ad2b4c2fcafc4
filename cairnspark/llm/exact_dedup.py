"""Exact dedup (8): a log-structured merge index over digests, with DataFrame operations only.

A batch of rows is a memtable: it is flushed as a run of distinct digests, sorted, with a bitmap filter of its own.
Runs of a level are compacted into one of the next level when there are ``FANOUT`` of them: digests that the other
runs' filters don't have are copied, the rest is merged, and each digest keeps one identifier. Rows whose
digest has more than one row are compared byte by byte.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import ascii_lower, stored

#: Runs of a level that are compacted together.
FANOUT = 4
#: Most bits of a run's filter: 32 MB. It has 16 bits for each digest as long as they fit; it only saves work.
FILTER_BITS = 1 << 28
#: Filters up to this size are broadcast, larger ones are joined by a shuffle.
BROADCAST_BITS = 1 << 25
_ROW = 1 << 15  # bits in one row of bitmap_construct_agg
RUN = "digest binary, doc_id long, tag long, n long"


def normal(text: Column) -> Column:
    """The text that is compared: A-Z lower-cased; null counts as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(normalised: Column) -> Column:
    """sha-256 of a normalised text, as bytes."""
    return F.unhex(F.sha2(normalised.cast("binary"), 256))


def digest_hex(text: Column) -> Column:
    """sha-256 of the text with A-Z lower-cased, in hex; null counts as empty."""
    return F.lower(F.hex(sha256(normal(text))))


def _slot(digest: Column | str, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


class Run:
    """Distinct digests, sorted within files, each with the identifier that stays and how many rows it has."""

    def __init__(self, rows: DataFrame, level: int):
        self.level = level
        self.rows = stored(rows.sortWithinPartitions("digest"), f"digest-run-{level}")
        self.size = self.rows.count()


def bitmaps(rows: DataFrame, bits: int, *keys: str) -> DataFrame:
    """(keys, bucket, bits): a bitmap over the digests of ``rows``, one for each key."""
    slots = rows.select(*keys, _slot("digest", bits).alias("slot"))
    return slots.groupBy(*keys, F.floor(F.col("slot") / _ROW).alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % _ROW).alias("bits"))


def filtered(rows: DataFrame, bitmap: DataFrame, bits: int, *keys: str) -> DataFrame:
    """``rows`` with ``__inside``: does the bitmap (of ``bits`` bits, for the row's keys) have the row's digest. Without false negatives."""
    bitmap = F.broadcast(bitmap) if bits <= BROADCAST_BITS else bitmap  # BROADCAST_BITS / 8 bytes at most for each of FANOUT keys
    found = rows.withColumn("bucket", F.floor(_slot("digest", bits) / _ROW)).join(bitmap, [*keys, "bucket"], "left")
    slot = _slot("digest", bits)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (slot % _ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.bit_get(byte, (slot % 8).cast("int")) == 1, F.lit(False))
    return found.withColumn("__inside", inside).drop("bucket", "bits")


class DigestIndex:
    """Runs by level. ``insert`` flushes a batch and compacts levels that are full; ``merged`` is one run of everything."""

    def __init__(self, keep: str = "max", fanout: int = FANOUT):
        self.keep, self.fanout, self.levels, self.compactions = keep, fanout, {}, 0

    def _best(self) -> Column:
        """Of rows with a digest: the largest (smallest) id; of these the one with the least tag; a null id loses to any other."""
        sign = 1 if self.keep == "max" else -1
        return F.max_by(F.struct("doc_id", "tag"), F.struct(F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id"), F.lit(0)) * sign, -F.col("tag"))).alias("best")

    def _kept(self, rows: DataFrame) -> DataFrame:
        kept = rows.groupBy("digest").agg(self._best(), F.sum("n").alias("n"))
        return kept.select("digest", "best.doc_id", "best.tag", "n")

    def insert(self, rows: DataFrame) -> None:
        """``rows`` (digest, doc_id, tag) are a memtable: one row for each digest is flushed as a run of level 0."""
        self._add(Run(self._kept(rows.select("digest", "doc_id", "tag", F.lit(1).cast("long").alias("n"))), 0))

    def _add(self, run: Run) -> None:
        runs = self.levels.setdefault(run.level, [])
        runs.append(run)
        if len(runs) == self.fanout:
            self._add(self._compacted(self.levels.pop(run.level)))

    def _compacted(self, runs: list[Run]) -> Run:
        """One run of the next level. Only digests that another run's filter has are shuffled."""
        self.compactions += 1
        bits = min(FILTER_BITS, max(_ROW, 1 << (16 * max(r.size for r in runs)).bit_length()))
        rows = reduce(DataFrame.unionByName, [r.rows.withColumn("run", F.lit(i)) for i, r in enumerate(runs)])
        filters = stored(bitmaps(rows, bits, "run"), "digest-filters")
        others = filters.join(filters.select(F.col("run").alias("other"), "bucket", F.col("bits").alias("seen")), "bucket").where("run <> other")
        others = others.groupBy("run", "bucket").agg(F.bitmap_or_agg("seen").alias("bits"))
        rows = stored(filtered(rows, others, bits, "run").drop("run"), "digest-candidates")
        alone = rows.where("not __inside").drop("__inside")
        return Run(alone.unionByName(self._kept(rows.where("__inside"))), max(r.level for r in runs) + 1)

    def runs(self) -> list[Run]:
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def merged(self) -> Run | None:
        """Compacts what is left into one run."""
        runs = self.runs()
        if len(runs) > 1:
            run = self._compacted(runs)
            self.levels = {run.level: [run]}
        return next(iter(self.runs()), None)


def _verified(docs: DataFrame, index: DigestIndex, merged: Run, digest) -> DataFrame:
    """Digests that stand for different texts. Only rows that the filter of repeated digests has are compared; copies are combined before the shuffle."""
    repeated = stored(merged.rows.where("n > 1").select("digest"), "digest-repeated")
    bits = min(BROADCAST_BITS, max(_ROW, 1 << (16 * repeated.count()).bit_length()))
    bitmap = bitmaps(repeated, bits)
    rows = docs.select(normal(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    texts = filtered(rows, bitmap, bits).where("__inside").groupBy("digest", "text").agg(F.count("*").alias("n"))
    return texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def exact_dedup(docs: DataFrame, keep: str = "max", batches: int = 4, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row: of equal texts the largest (or smallest) doc_id stays.

    The rows are inserted in ``batches``; the texts are read once for their digests and once for the byte
    verification. Texts are equal when identical after lower-casing A-Z; null counts as empty. Bytes decide: where
    different texts share a digest, their rows are grouped by the text itself. Of repeated rows with the id
    that stays, one is kept. A null id stays only if its text has no other id. Other columns are ignored; an empty
    table gives no rows.
    """
    rows = docs.select(digest(normal(docs["text"])).alias("digest"), docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tag"))
    rows = stored(rows, "digests")
    index = DigestIndex(keep)
    for b in range(batches):
        index.insert(rows.where(F.pmod("tag", F.lit(batches)) == b))
    merged = index.merged()
    shared = stored(_verified(docs, index, merged, digest), "digest-collisions")
    best = merged.rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("tag").alias("keep_tag"), F.col("n").alias("group_size"))
    collided = not shared.isEmpty()
    found = rows.join(shared, "digest", "left_anti") if collided else rows
    out = found.join(best, "digest").select("doc_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return out.unionByName(_by_text(docs, shared, keep, digest)) if collided else out


def _by_text(docs: DataFrame, shared: DataFrame, keep: str, digest) -> DataFrame:
    """``exact_dedup``'s rows for texts whose digest others have too: grouped by the text itself."""
    rows = docs.select(normal(docs["text"]).alias("text"), docs["doc_id"].cast("long").alias("doc_id")).withColumn("digest", digest(F.col("text")))
    rows = stored(rows.join(shared, "digest", "left_semi").withColumn("tag", F.monotonically_increasing_id()), "digest-collided")
    best = rows.groupBy("digest", "text").agg(DigestIndex(keep)._best(), F.count("*").alias("group_size"))
    found = rows.join(best, ["digest", "text"])
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("best.tag")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are, whatever their names.

    The row with the largest (or smallest) doc_id stays; a null id only where the text has no other; of rows that
    repeat id and text any one; null and empty texts are one group; an empty table stays empty.
    """
    kept = exact_dedup(docs, keep).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"), "group_size")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), digest_hex(docs["text"]).alias("digest"))
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    return found.where("group_size = 1").select("row.*").unionByName(found.where("group_size > 1").dropDuplicates(["id", "digest"]).select("row.*"))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
