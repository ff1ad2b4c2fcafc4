"""N-gram Jaccard join (7): vertical partitioning of a global n-gram order.

Equal shingle sets are one node. Rare-first prefixes give candidate pairs; each candidate's sets are cut
into fragments of the global order, whose overlaps are counted apart and summed per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.llm import encoders
from cairnspark.llm.common import by_bytes, map_arrow, stored
from cairnspark.llm.components import components
from cairnspark.llm.words import hashed_words, mixed

#: Shingles that the global order puts last, the most frequent ones: 4 MB. It bears on speed, not on results.
FREQUENT = 1 << 18
#: Most bits of the filter that tells which documents' sets a verification needs: 16 MB. It has 16 bits for each set
#: as long as they fit; false positives cost time and are joined away.
MEMBER_BITS = 1 << 27
#: Pairs of one set that are verified together; a set with more of them is dealt over several keys.
SHARE = 256
#: Sets with one shingle in their prefixes that one task may join; a shingle of more sets is dealt over several keys.
HOT = 4_096
_ROW = 1 << 15
SKETCH = 4  # words of 64 bits, beside each prefix shingle
WIDE = 2048  # bits of the sketch that is compared once per candidate pair
_A = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, words: int):
    """For each text: sorted distinct 64-bit values of its word shingles, A-Z lower-cased; with fewer words, the whole sequence as one."""
    for _, values, bounds in hashed_words(column):
        sizes = np.diff(bounds)
        if not len(values):
            yield from (values for _ in sizes)
            continue
        wide = np.full(max(0, len(values) - words + 1), words, np.uint64)
        for k in range(words if len(wide) else 0):
            wide = (wide ^ (wide >> np.uint64(29))) * _A + values[k : len(values) - words + 1 + k]
        wide = mixed(wide)
        for n, start in zip(sizes.tolist(), bounds.tolist(), strict=False):
            if n >= words:
                yield np.unique(wide[start : start + n - words + 1])
            else:
                acc = np.full(min(n, 1), n, np.uint64)
                for k in range(n):
                    acc = (acc ^ (acc >> np.uint64(29))) * _A + values[start + k]
                yield mixed(acc)


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def prefix_length(n, percent: int):
    """A set of n and any set that it links to share one of its first so many shingles in the global order."""
    return n - -(-percent * n // 100) + 1


def _needed(na, nb, percent: int):
    """The overlap from which two sizes link: 100 * i >= percent * (na + nb - i)."""
    return F.ceil(percent * (na + nb) / F.lit(100 + percent) - F.lit(1e-9))


def _scan(docs: DataFrame, words: int, flush: int = 1_000_000) -> DataFrame:
    """A row per document (doc_id, n, node, hash of the text), and a row for each shingle that is there twice or more among ``flush`` that a task met one after the other (node: the shingle, n: how often)."""

    names = ["shingle", "doc_id", "n", "node", "hash"]

    def measure(batches):
        encoders.release()
        held: list[np.ndarray] = []
        size = 0

        def frequent():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keys, counts = keys[counts > 1], counts[counts > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), bool)), pa.nulls(len(keys), pa.int64()), pa.array(counts.astype(np.int64)), pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.int64())], names)

        for batch in by_bytes(batches, 1):
            sizes, nodes = [], []
            for s in shingle_sets(batch.column(1), words):
                sizes.append(len(s))
                nodes.append(node_of(s))
                held.append(s)
                size += len(s)
                if size >= flush:
                    yield frequent()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), bool)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), batch.column(2)], names)
        if held:
            yield frequent()

    return stored(docs.withColumn("hash", F.xxhash64("text")).transform(map_arrow, measure, "shingle boolean, doc_id long, n long, node long, hash long"), "shingle-scan")


def _frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts."""
    counts = scan.where("shingle").groupBy("node").agg(F.sum("n").alias("n"))
    table = counts.orderBy(F.desc("n"), "node").limit(FREQUENT).toArrow()
    keys, n = table.column("node").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _prefixes(docs: DataFrame, words: int, percent: int, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """node, n, prefix (its first shingles, rare ones first) and a parity sketch of the whole set, for sets that another one can link to."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts))  # at most FREQUENT entries
    least = -(-percent // (100 - percent)) if percent < 100 else None
    names = ["node", "n", "prefix", "wide", *(f"s{i}" for i in range(SKETCH))]

    def measure(batches):
        keys, counts = shared.value
        for batch in by_bytes(batches, 1):
            rows: list[tuple] = []
            for s in shingle_sets(batch.column(1), words):
                if least is None or len(s) < least:
                    continue
                order = s
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    df = np.where(keys[at] == s, counts[at], 0)
                    if df.any():
                        order = s[np.argsort(df, kind="stable")]
                wide = (np.bincount((s >> np.uint64(20)).astype(np.int64) % WIDE, minlength=WIDE) % 2).astype(np.uint8)
                sketch = np.packbits(wide.reshape(-1, 64 * SKETCH).sum(axis=0, dtype=np.uint8) % 2).view(np.int64)
                rows.append((node_of(s), len(s), order[: prefix_length(len(s), percent)].view(np.int64), np.packbits(wide).tobytes(), *sketch.tolist()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), *[pa.int64()] * SKETCH]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "node long, n long, prefix array<long>, wide binary, " + ", ".join(f"s{i} long" for i in range(SKETCH))
    return docs.transform(map_arrow, measure, schema).dropDuplicates(["node"])


def _refined(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance): the pairs whose wide sketches differ in no more bits than the sets may in shingles."""

    def compare(batches):
        for batch in by_bytes(batches, 4):
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, WIDE // 8) for i in (4, 5))
            distance = np.unpackbits(x ^ y, axis=1).sum(axis=1, dtype=np.int64)
            keep = distance <= na + nb + 2 * (-percent * (na + nb) // (100 + percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance)], ["a", "b", "distance"]).filter(pa.array(keep))

    of = {x: info.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab"}
    rows = pairs.join(of["a"], "a").join(of["b"], "b").select("a", "b", "na", "nb", "wide_a", "wide_b")
    return rows.transform(map_arrow, compare, "a long, b long, distance long")


def _slot(node, doc_id, bits: int):
    return F.pmod(F.pmod(node, F.lit(bits)) + F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(bits)) * 7919, F.lit(bits))


def _members(pairs: DataFrame, nodes: DataFrame) -> list[np.ndarray]:
    """For either side of the pairs a bitmap, packed, over the smallest documents of its nodes; of MEMBER_BITS at most."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side")))).alias("s")).select("s.*").distinct()
    found = stored(sides.join(nodes, "node").select("side", "node", "least"), "members")
    size = min(MEMBER_BITS, max(_ROW, 1 << (16 * found.count()).bit_length()))
    slots = found.select("side", _slot(F.col("node"), F.col("least"), size).alias("slot"))
    rows = slots.groupBy("side", F.floor(F.col("slot") / _ROW).alias("row")).agg(F.bitmap_construct_agg(F.col("slot") % _ROW).alias("bits")).collect()
    bits = [np.zeros(size // 8, np.uint8) for _ in "ab"]
    for r in rows:
        bits[r["side"]][r["row"] * _ROW // 8 : (r["row"] + 1) * _ROW // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, percent: int, fragments: int) -> DataFrame:
    """The pairs (a, b; a stored table) that link: overlaps are counted fragment by fragment of the global order and summed.

    A set's pairs are dealt over as many keys as they need, so that the centre of a large star isn't one task's work.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_members(pairs, nodes))
    names, kinds = ["node", "fragment", "tag", "part", "n", "is_a", "is_b"], [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.bool_()]

    def cut(batches):
        member, tag = shared.value, TaskContext.get().partitionId() << 36
        for batch in by_bytes(batches, 1):
            rows: list[tuple] = []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                if not len(s):
                    continue
                node, inside = node_of(s), []
                for bits in member:
                    size = len(bits) * 8
                    slot = (node % size + (doc_id or 0) % size * 7919) % size
                    inside.append(bool(bits[slot >> 3] >> (slot & 7) & 1))
                if any(inside):
                    tag += 1
                    edges = np.searchsorted(s, (np.arange(1, fragments, dtype=np.float64) / fragments * 2.0**64).astype(np.uint64))
                    rows += [(node, f, tag, part.view(np.int64), len(s), *inside) for f, part in enumerate(np.split(s, edges))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    parts = stored(docs.transform(map_arrow, cut, "node long, fragment int, tag long, part array<long>, n long, is_a boolean, is_b boolean"), "fragments")
    # Repeated rows and false positives give a set's fragments more than once: the first of them stand for it.
    firsts = {x: parts.where(f"fragment = 0 and is_{x}").groupBy(F.col("node").alias(x)).agg(F.min("tag").alias(f"tag_{x}")) for x in "ab"}
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).join(firsts["a"], "a")
    shares = stored(shares, "verify-shares")
    dealt = pairs.select("a", "b").join(shares, "a").join(firsts["b"], "b").select("a", "b", "tag_b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    right = parts.where("is_b").select(F.col("node").alias("b"), F.col("tag").alias("tag_b"), "fragment", F.col("part").alias("part_b"), F.col("n").alias("nb"))
    left = parts.where("is_a").select(F.col("node").alias("a"), F.col("tag").alias("tag_a"), "fragment", F.col("part").alias("part_a"), F.col("n").alias("na"))
    left = left.join(shares, ["a", "tag_a"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("tag_a", "shares")
    partial = dealt.join(right, ["b", "tag_b"]).join(left, ["a", "fragment", "share"]).select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).alias("overlap"))
    sums = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return sums.where(F.col("overlap") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _may_link(x: str, y: str, percent: int):
    """Sizes and parity sketches let two sets link: the sketches differ in no more bits than the sets in shingles."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    different = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return (nx * 100 >= ny * percent) & (ny * 100 >= nx * percent) & (different <= nx + ny - 2 * _needed(nx, ny, percent))


def _hot(spark: SparkSession, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, deals) for the shingles that more than HOT documents were seen to have: at most FREQUENT rows, so they are broadcast."""
    hot = counts > HOT
    table = pa.table({"token": keys[hot].view(np.int64), "deals": -(-counts[hot].astype(np.int64) // HOT)})
    return F.broadcast(spark.createDataFrame(table, "token long, deals long"))


def _deal(token: str, deals, share):
    """A shingle's key, or one of its ``deals`` keys. Two shingles of one key make more candidates, never fewer."""
    return F.when(deals > 1, F.xxhash64(token, share)).otherwise(F.col(token))


def _dealt(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``key``: rows of a hot shingle go to one of its keys, by node."""
    rows = df.join(hot, "token", "left")
    return rows.withColumn("key", _deal("token", F.col("deals"), F.pmod(F.xxhash64("node"), F.col("deals")))).drop("deals")


def _spread(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``key``: rows of a hot shingle are there once for each of its keys."""
    rows = df.join(hot, "token", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1)) - 1)))
    return rows.withColumn("key", _deal("token", F.col("deals"), F.col("share"))).drop("deals", "share")


def _several(named: DataFrame) -> DataFrame:
    """(token, cuts) for the shingles whose sets are of different components, from rows (token, node, place, component).

    Of shingles that the same sets have, the first in the global order stands for all: it makes the same pairs, once. A hash of 64 bits,
    the count and the outermost components name the sets; a shingle that is earlier in the order is earlier in each of them, so its least place is less.
    """
    first = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("sets"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.min("place").alias("place")]
    tokens = named.groupBy("token").agg(*first).where("lo <> hi")
    return tokens.groupBy("lo", "hi", "sets", "mark").agg(F.min_by("token", "place").alias("token")).select("token", F.ceil(F.col("sets") / HOT).alias("cuts"))


def _grouped(docs: DataFrame, words: int, percent: int, fragments: int) -> DataFrame:
    """For every row doc_id, hash (of the text), n, component_id, and whether it is its component's first: least by id (null last), node and hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = _scan(rows, words)
    ids = scan.where("not shingle").select("doc_id", "n", "node", "hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "hash")).alias("first")
    nodes = stored(ids.where("n > 0").groupBy("node").agg(first).select("node", F.col("first.doc_id").alias("least"), "first"), "nodes")
    frequent = _frequent(scan)
    hot = _hot(docs.sparkSession, *frequent)
    info = stored(_prefixes(rows, words, percent, *frequent), "prefixes")
    sketch = [f"s{i}" for i in range(SKETCH)]
    postings = _dealt(info.select("node", F.posexplode("prefix").alias("place", "token")), hot)
    # A hot shingle is kept whatever its count; the window holds the postings of one key.
    shared = postings.withColumn("nodes", F.count("*").over(Window.partitionBy("key"))).where("nodes > 1 or key <> token").drop("nodes", "key")
    buckets = stored(shared.join(info.select("node", "n", *sketch), "node"), "buckets")

    # Stars: every node is compared to the nodes that its shingles name. All that may link are verified, not the most alike alone: where a
    # node links to several centres, their stars become one component, and fewer pairs of different components are left.
    centre = F.min_by(F.struct("node", "n", *sketch), F.xxhash64("node")).alias("c"), F.max_by(F.struct("node", "n", *sketch), F.xxhash64("node")).alias("d")
    centres = buckets.groupBy("token").agg(*centre).select("token", F.explode(F.array("c", "d")).alias("c")).select("token", "c.*")
    near = _dealt(buckets, hot).drop("token").alias("x").join(_spread(centres, hot).drop("token").alias("y"), "key").where((F.col("x.node") != F.col("y.node")) & _may_link("x", "y", percent))
    stars = stored(_refined(near.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct(), info, percent), "stars")
    links = _verified(rows, stars, nodes, words, percent, fragments)
    labels = stored(components(links), "labels")

    # Then all candidates of different components. Of two sets that link, the smaller one shares a shingle of its shorter index prefix.
    named = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named, "named-buckets")
    several = _several(named)
    named = _dealt(named, hot).join(_spread(several, hot).select("key", "token", "cuts"), ["key", "token"]).drop("key")
    # Sizes of sets that link are in the same band or the next one, so a shingle that many sets share is dealt by size,
    # and its band by a grid: a set's row (of the smaller ones) or column is by its node, and it is there in all cells of it.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(math.log(100 / percent), 1e-3) * 1.001)).cast("int")
    early = F.col("place") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent) - F.lit(1e-9))
    own, others = F.pmod(F.xxhash64("node"), F.col("cuts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))
    sides = ["node", "n", "place", "component", *sketch, "cell"]
    smaller = named.where(early).withColumn("band", F.explode(F.array(band, band + 1))).withColumn("other", others).withColumn("cell", F.xxhash64("token", "band", own, "other")).select(sides)
    larger = named.withColumn("band", band).withColumn("other", others).withColumn("cell", F.xxhash64("token", "band", "other", own)).select(sides)
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    # The first shingle that they share has as many behind it, in either set, as they need in all: at others a pair need not be made.
    behind = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    first = behind >= _needed(F.col("x.n"), F.col("y.n"), percent)
    rest = smaller.alias("x").join(larger.alias("y"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.component") != F.col("y.component")) & ordered & first & _may_link("x", "y", percent))
    rest = _refined(rest.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct(), info, percent)
    more = _verified(rows, stored(rest, "pairs"), nodes, words, percent, fragments)
    labels = components(more.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    joined = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("first").alias("first"))
    found = stored(joined.drop("first").join(least, "component").select("node", "first"), "node-components")
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "node", "hash")
    return ids.join(found, "node", "left").select("doc_id", "hash", "n", F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), own.eqNullSafe(F.col("first")).alias("is_first"))


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, fragments: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of distinct word shingles;
    component_id is the smallest doc_id reachable by links, itself included. Sets are compared exactly but
    for 64-bit hashing of shingles.

    Nodes are distinct sets, so copies of any number cost one node. Candidates share a prefix shingle. First
    every node is compared to the most alike of the nodes picked for its prefix shingles (stars), and what links
    becomes one component; then all candidate pairs of different components are compared, so no component
    is missed, and the pairs within a dense group aren't made.

    Null and empty texts have no shingles and link with nothing: their component is their own doc_id. A null
    doc_id takes part but never names a component unless there is no other; repeated rows get the same
    result each; other columns are ignored; an empty table gives no rows.
    """
    found = _grouped(docs, words, percent, fragments)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the smallest doc_id's (null last; one of its rows, if it is repeated), all columns as they are.

    It is decided for each (doc_id, text), so rows without an id and the other texts of an id stay. Texts without
    shingles (null, empty, white space) all stay; an empty table stays empty; column names of any kind stay untouched.
    """
    kinds = _grouped(docs, words, percent, 4).where("n > 0").groupBy("doc_id", "hash").agg(F.first("is_first").alias("is_first"), F.count("*").alias("times"))
    kinds = stored(kinds.where("not is_first or times > 1").select(F.col("doc_id").alias("kind_id"), F.col("hash").alias("kind_hash"), "is_first"), "not-kept")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("kind_id")) & (F.col("hash") == F.col("kind_hash"))
    kept = rows.join(kinds, same, "left_anti")
    repeated = kinds.where("is_first")
    if not repeated.isEmpty():
        kept = kept.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["id", "hash"]))
    return kept.select("row.*")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
