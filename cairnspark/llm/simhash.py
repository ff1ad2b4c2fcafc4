"""SimHash near-dedup (11): pivot distance tables.

Each distinct fingerprint has a table of its Hamming distances to fixed reference fingerprints. By the triangle
inequality two fingerprints of distance k differ by k at most in every coordinate. Coordinates to references that
differ from the first one in one block name the cells in which pairs meet; of those pairs the ones whose largest coordinate
difference is over k are discarded, and the rest are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import UPPER, by_bytes, map_arrow, stored
from cairnspark.llm.components import components

SEED = 42
#: Bytes of a text that are words at once; bounds memory, whatever the length of a text.
CHUNK = 1 << 20
#: A cell with more fingerprints makes no pairs: its members meet in the fingerprints around them instead.
FULL = 64
#: Bits of a block, in which one reference differs from the first one.
BLOCK = 2
#: The first reference.
FIRST = 0x5A17C3E96B2D48F1
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: References that are 32 bits apart from each other: rows of a Hadamard matrix, the parity of row & column at each bit.
SPREAD = [_signed(sum(((row & bit).bit_count() & 1) << bit for bit in range(64))) for row in range(1, 64, 4)]


def shingle_hashes(data: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included, in slices; with fewer words, of the whole sequence."""
    from xxhash import xxh64_intdigest

    before: list[bytes] = []
    rest, short = b"", True
    for at in range(0, len(data), CHUNK):
        part, rest = rest + data[at : at + CHUNK].translate(_LOWER), b""
        if at + CHUNK < len(data):
            cut = max(part.rfind(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) + 1
            part, rest = part[:cut], part[cut:]
        found = before + part.split()
        before = found[max(0, len(found) - words + 1) :]
        if len(found) >= words:
            short = False
            joined = b" ".join(found)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ends = np.cumsum(sizes + 1) - 1
            spans = zip((ends - sizes)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
            yield np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), "<u8", len(found) - words + 1)
    if short and before:
        yield np.array([xxh64_intdigest(b" ".join(before), SEED)], "<u8")


def fingerprint(data: bytes, words: int) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without words. As a signed 64-bit number."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(data, words):
        for at in range(0, len(h), 1 << 16):
            part = h[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, fingerprint (long) of every row of ``docs`` (doc_id, text); null counts as empty."""

    def measure(batches):
        for batch in by_bytes(batches, 1):
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, measure, "doc_id long, fingerprint long")


def pivot_table(prints: DataFrame, groups: int) -> DataFrame:
    """fingerprint, near0, near1 (distances to eight spread references each, a byte each) and one code for each group of blocks.

    A block's reference differs from the first one in this block alone, so the difference of the two distances tells
    how many of the block's bits differ from the first reference: a digit of its group's code.
    """
    x = F.col("fingerprint")
    apart = lambda reference: F.bit_count(x.bitwiseXOR(F.lit(_signed(reference)))).cast("long")
    packed = [sum((F.shiftleft(apart(r), 8 * k) for k, r in enumerate(SPREAD[at : at + 8])), F.lit(0)) for at in (0, 8)]
    mask, digits = (1 << BLOCK) - 1, 64 // BLOCK
    digit = [F.shiftright(apart(FIRST) + BLOCK - apart(FIRST ^ (mask << BLOCK * j)), 1) for j in range(digits)]
    codes = [sum((digit[j] * (BLOCK + 1) ** j for j in range(g, digits, groups)), F.lit(0)) for g in range(groups)]
    return prints.select("fingerprint", *(p.alias(f"near{k}") for k, p in enumerate(packed)), *(c.alias(f"code{g}") for g, c in enumerate(codes)))


def _largest_difference(x: str, y: str) -> Column:
    place = lambda side, k: F.shiftright(F.col(f"{side}.near{k // 8}"), k % 8 * 8).bitwiseAND(F.lit(255))
    return F.greatest(*(F.abs(place(x, k) - place(y, k)) for k in range(len(SPREAD))))


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between fingerprints, or a fingerprint and one that lies between two; their components are those of all pairs of distinct
    ``prints`` (fingerprint; a stored table) that differ in ``distance`` bits or fewer.

    ``distance`` differences touch as many groups of blocks at most, so two such fingerprints share the codes of the rest:
    each choice of the rest is a cell. Cells of up to FULL members compare their pairs. Fingerprints of fuller cells name every
    fingerprint within half the distance, and those that name the same one are linked: at most 65 for a distance of 2.
    """
    if distance not in (0, 1, 2):
        raise ValueError("distance must be 0, 1 or 2")
    groups = distance + 4
    table = stored(pivot_table(prints.select("fingerprint"), groups), "pivot-table")
    chosen = [F.struct(F.lit(k).alias("choice"), sum((F.col(f"code{g}") for g in kept), F.lit(0)).alias("code")) for k, kept in enumerate(combinations(range(groups), groups - distance))]
    cells = table.select("fingerprint", "near0", "near1", F.explode(F.array(*chosen)).alias("cell")).select("fingerprint", "near0", "near1", "cell.*")
    sizes = stored(cells.groupBy("choice", "code").agg(F.count("*").alias("n")).where("n > 1"), "cell-sizes")
    key = ["choice", "code"]
    shared = stored(cells.join(sizes.where(F.col("n") <= FULL).select(*key), key), "cells")
    close = (F.col("x.fingerprint") < F.col("y.fingerprint")) & (_largest_difference("x", "y") <= distance)
    close &= F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))) <= distance
    pairs = shared.alias("x").join(shared.alias("y"), key).where(close).select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))

    dense = stored(cells.join(sizes.where(F.col("n") > FULL).select(*key), key, "left_semi").select("fingerprint").distinct(), "dense")
    x = F.col("fingerprint")
    around = dense.select("fingerprint", F.explode(F.array(x, *(x.bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)))).alias("hub"))
    if distance == 1:  # what is named has to be a fingerprint itself
        rest = around.join(dense.select(x.alias("hub")), "hub").where("hub <> fingerprint").select(F.col("fingerprint").alias("a"), F.col("hub").alias("b"))
    else:
        members = around.groupBy("hub").agg(F.collect_set("fingerprint").alias("members")).where(F.size("members") > 1)
        rest = members.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b")
    return pairs.union(rest.where(F.lit(distance > 0))).distinct()


def simhash_groups(docs: DataFrame, words: int = 5, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of ``docs`` (doc_id, text).

    Texts are lower-cased in A-Z and cut into shingles of ``words`` words, repeats included; a bit of the fingerprint is 1
    if it is set in over half of their XXH64. Fingerprints link at ``distance`` or fewer differing bits; component_id is
    the smallest doc_id reachable by links, itself included. Every link counts: nothing is capped or sampled.

    Null and empty texts have the fingerprint zero, which links like any other. A null doc_id takes part but never names
    a component unless there is no other; repeated rows get the same result each; very long texts are read in
    slices; other columns are ignored; an empty table gives no rows.
    """
    ids = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(ids.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    labels = components(links(nodes, distance)).select(F.col("node").alias("fingerprint"), "component")
    joined = nodes.join(labels, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    found = stored(joined.drop("least").join(least, "component").select("fingerprint", "component_id"), "fingerprint-components")
    hexadecimal = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return ids.join(found, "fingerprint", "left").select("doc_id", hexadecimal.alias("fingerprint"), "component_id")
