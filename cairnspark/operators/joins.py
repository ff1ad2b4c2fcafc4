"""Guarded lookups, grid-cell radius joins, k-nearest joins by widening rings, cascading comparables, feature-space k-NN."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.functions.scalar import haversine_km
from cairnspark.operators.ranges import cut

#: No place has fewer km to a degree of latitude.
KM_PER_DEGREE = 110.5
#: More than half of any great circle.
WHOLE_GLOBE_KM = 20_200.0
#: Numbers in the vectors of a block of rows, and of the pairs whose distances are taken at once.
VISIT_VALUES = 1 << 18


def _dealt(df: DataFrame) -> DataFrame:
    """A table that grows with the input: joined by sorted shuffles, never sent whole to the driver, however small its files are.

    Spark compares the size of files with its broadcast threshold; repeated values and few columns make millions of rows look small.
    """
    return df.hint("merge")


def many_to_one(fact: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that raises if the dimension repeats a key or lacks one: two checks, one aggregate each."""
    if dimension.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"the dimension repeats a key of {list(keys)}")
    if fact.join(dimension, list(keys), "left_anti").limit(1).count():
        raise ValueError(f"rows without a match on {list(keys)}")
    return fact.join(dimension, list(keys), "left")


def lookup(df: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str], default: Column | float | None = None) -> DataFrame:
    """Left join to a lookup with one row per key; nulls take the default. A looked-up column takes the place of one of that name."""
    joined = df.drop(*[c for c in columns if c not in keys]).join(values.select(*keys, *columns), list(keys), "left")
    return joined if default is None else joined.withColumns({c: F.coalesce(c, default if isinstance(default, Column) else F.lit(default)) for c in columns})


def orphans(fact: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fact.join(dimension, list(keys), "left_anti")


def _cells(df: DataFrame, lat: str, lon: str, km: float | Column, reach: int = 0) -> DataFrame:
    """Adds cell row and column; with ``reach`` a row for each cell that a circle of reach * km can touch.

    Rows of cells are ``km`` high. A cell row's width in degrees is that of its own latitude farthest
    from the equator, so neighbours are looked up row by row with that row's width; columns wrap at 180 degrees.
    """
    step = (km if isinstance(km, Column) else F.lit(km)) / KM_PER_DEGREE

    def width(row: Column) -> Column:
        edge = F.least(F.greatest(F.abs(row), F.abs(row + 1)) * step, F.lit(89.0))
        return F.least(step / F.cos(F.radians(edge)), F.lit(360.0))

    row = F.floor(F.col(lat) / step).cast("long")
    placed = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if not reach:
        return placed.withColumn("cy", row).withColumn("cx", F.floor((F.col(lon) + 180) / width(F.col("cy"))).cast("long"))
    rows = placed.withColumn("cy", F.explode(F.sequence(row - reach, row + reach)))
    # the circle's widest half-angle in longitude, by the latitude farthest from the equator that it touches
    far = F.least(F.abs(F.col(lat)) + step * reach, F.lit(89.0))
    half = F.least(step * reach / F.cos(F.radians(far)), F.lit(180.0))
    left, right = F.col(lon) + 180 - half, F.col(lon) + 180 + half
    w = width(F.col("cy"))
    spans = F.sequence(F.floor(left / w).cast("long"), F.floor(right / w).cast("long"))
    seam = F.when((left < 0) | (right > 360), F.concat(spans, F.sequence(F.floor(F.pmod(left, F.lit(360.0)) / w).cast("long"), F.floor(F.lit(360.0) / w).cast("long")), F.sequence(F.lit(0).cast("long"), F.floor(F.pmod(right, F.lit(360.0)) / w).cast("long")))).otherwise(spans)
    return rows.withColumn("cx", F.explode(F.array_distinct(seam)))


def radius_pairs(queries: DataFrame, pool: DataFrame, km: float | Column, same: Sequence[str] = (), lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs (q_*, p_*, km) within the radius and equal in ``same``: an equi join on cells, then the exact distance.

    A radius that is a column is an expression over columns of ``same``, which both sides have.
    """
    q = _cells(queries, lat, lon, km, 1)
    p = _cells(pool, lat, lon, km)
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], "cy", "cx", (km if isinstance(km, Column) else F.lit(km)).alias("__km"), *[F.col(c).alias(f"__{c}") for c in same])
    p = p.select(*[F.col(c).alias(f"p_{c}") for c in pool.columns], "cy", "cx", *[F.col(c).alias(f"__{c}") for c in same])
    pairs = q.join(_dealt(p), ["cy", "cx", *[f"__{c}" for c in same]]).drop("cy", "cx", *[f"__{c}" for c in same])
    distance = haversine_km(F.col(f"q_{lat}"), F.col(f"q_{lon}"), F.col(f"p_{lat}"), F.col(f"p_{lon}"))
    return pairs.withColumn("km", distance).where(F.col("km") <= F.col("__km")).drop("__km")


def _start_levels(queries: DataFrame, pool: DataFrame, k: int, unit: float, lat: str, lon: str, same: Sequence[str], top_level: int) -> DataFrame:
    """Queries with ``__level``: the radius unit * 2^(level / 2) that should hold k of the pool, by the pool's density around the query.

    Counts of the finest cells of a quadtree in degrees, whose root is the whole globe, are added up for coarser ones;
    a query takes the density of the smallest cell around it that holds k. A wrong guess costs a round, never a result.
    Where the pool has fewer than k rows the radius is the whole globe at once.
    """
    finest, depth = 1 / 1024, 20
    cell = {"__y": F.floor((F.col(lat) + 90) / finest).cast("long"), "__x": F.floor((F.col(lon) + 180) / finest).cast("long")}
    keys = [f"__s_{c}" for c in same]
    named = {f"__s_{c}": F.col(c) for c in same}
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("__j")
    up = [F.expr("shiftright(__y, __j)").alias("__uy"), F.expr("shiftright(__x, __j)").alias("__ux")]
    counts = pool.withColumns({**cell, **named}).groupBy("__y", "__x", *keys).agg(F.count("*").alias("__c"))
    tree = counts.select("*", levels).groupBy("__j", *up, *keys).agg(F.sum("__c").alias("__c")).where(F.col("__c") >= k)
    mine = queries.withColumns({**cell, **named}).select("__y", "__x", *keys).distinct()
    smallest = mine.select("*", levels).select("*", *up).join(_dealt(tree), ["__j", "__uy", "__ux", *keys]).groupBy("__y", "__x", *keys).agg(F.min(F.struct("__j", "__c")).alias("__m"))
    side = F.pow(F.lit(2.0), F.col("__m.__j")) * finest * KM_PER_DEGREE
    area = side * side * F.greatest(F.cos(F.radians(F.col(lat))), F.lit(0.01))
    radius = F.sqrt((k + 3 * k**0.5 + 1) * area / F.col("__m.__c") / F.pi())
    # null where no cell holds k; greatest would skip the null, so that comes first
    level = F.coalesce(F.ceil(2 * F.log2(radius / unit)), F.lit(top_level))
    level = F.least(F.greatest(level, F.lit(-40)), F.lit(top_level)).cast("int")
    return queries.withColumns({**cell, **named}).join(_dealt(smallest), ["__y", "__x", *keys], "left").withColumn("__level", level).drop("__y", "__x", "__m", *keys)


def nearest(queries: DataFrame, pool: DataFrame, k: int, key: str, km: float = 1.0, lat: str = "lat", lon: str = "lon", exclude: tuple[str, str] | None = None, same: Sequence[str] = ()) -> DataFrame:
    """The k nearest of the pool for each query, ranked by (distance to 1e-6 km, pool key); ``key`` is unique in both tables.

    Each query starts with a radius by the density around it and goes on with twice the radius until it has k or the
    radius spans the globe, so none is lost; ``km`` is only the unit of the radii. ``exclude`` names a query and a pool
    column that must differ (the own group). Only keys and places are joined and ranked; other columns follow at the end.
    Of pool rows at one place only those that can be among any query's k are kept. No all-pairs join at any size.
    Rows without a place have no neighbours.
    """
    top_level = math.ceil(2 * math.log2(WHOLE_GLOBE_KM / km))
    mine, theirs = exclude or (key, key)
    both = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    q = queries.where(both).select(F.col(key).alias("q"), F.col(lat).alias("a"), F.col(lon).alias("o"), F.col(mine).alias("e"), *[F.col(c).alias(f"s_{c}") for c in same])
    p = pool.where(both).select(F.col(key).alias("p"), F.col(lat).alias("a"), F.col(lon).alias("o"), F.col(theirs).alias("e"), *[F.col(c).alias(f"s_{c}") for c in same])
    place = ["a", "o", *[f"s_{c}" for c in same]]
    if exclude:
        p = p.withColumn("i", F.row_number().over(Window.partitionBy(*place, "e").orderBy("p"))).where(F.col("i") <= k)
    # any one excluded value has at most k of these, so 2k hold the k least of the rest
    p = p.withColumn("i", F.row_number().over(Window.partitionBy(*place).orderBy("p"))).where(F.col("i") <= (2 * k if exclude else k)).drop("i")
    p = cut(p)
    left = cut(_start_levels(q, p, k, km, "a", "o", [f"s_{c}" for c in same], top_level))
    parts = []
    while levels := [r[0] for r in left.select("__level").distinct().collect()]:  # about 80 levels at most
        radius = F.least(F.lit(km) * F.pow(F.lit(2.0), F.col("__level") / 2), F.lit(WHOLE_GLOBE_KM))
        shelves = p.select("*", F.explode(F.array(*map(F.lit, levels))).alias("__level"))
        pairs = radius_pairs(left, shelves, radius, [f"s_{c}" for c in same] + ["__level"], "a", "o")
        if exclude:
            pairs = pairs.where(~F.col("q_e").eqNullSafe(F.col("p_e")))
        near = pairs.select("q_q", "p_p", "km", "q___level", F.row_number().over(Window.partitionBy("q_q").orderBy(F.round("km", 6), "p_p")).alias("rank")).where(F.col("rank") <= k)
        ranked = cut(near.withColumn("n", F.count("*").over(Window.partitionBy("q_q"))))
        complete = (F.col("n") >= k) | (F.col("q___level") >= top_level)
        parts.append(ranked.where(complete).select("q_q", "p_p", "km", "rank"))
        done = ranked.where(complete & (F.col("rank") == 1)).select(F.col("q_q").alias("q"))
        left = cut(left.where(F.col("__level") < top_level).join(_dealt(done), "q", "left_anti").withColumn("__level", F.least(F.col("__level") + 2, F.lit(top_level))))
    none = p.sparkSession.createDataFrame([], T.StructType([T.StructField("q_q", queries.schema[key].dataType), T.StructField("p_p", pool.schema[key].dataType), T.StructField("km", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    found = reduce(DataFrame.unionByName, parts, none) if not parts else reduce(DataFrame.unionByName, parts)
    wide_q = queries.select(F.col(key).alias("q_q"), *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != key])
    wide_p = pool.select(F.col(key).alias("p_p"), *[F.col(c).alias(f"p_{c}") for c in pool.columns if c != key])
    # queries last, and their key from the joined one: what groups by it needs no further shuffle
    both = found.join(_dealt(wide_p), "p_p").join(_dealt(wide_q), "q_q")
    return both.select("km", "rank", *[(F.col("q_q") if c == key else F.col(f"q_{c}")).alias(f"q_{c}") for c in queries.columns], *[(F.col("p_p") if c == key else F.col(f"p_{c}")).alias(f"p_{c}") for c in pool.columns])


def neighbour_stats(ranked: DataFrame, key: str, value: str, ks: Sequence[int]) -> DataFrame:
    """Mean and population deviation of the neighbours' value, for several k of one ranking."""
    columns = [f(F.when(F.col("rank") <= k, F.col(f"p_{value}"))).alias(f"{name}_k{k}") for k in ks for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return ranked.groupBy(F.col(f"q_{key}").alias(key)).agg(*columns)


def comparables(ranked: DataFrame, key: str, value: str, attribute: str, size: str, band: float, k: int) -> DataFrame:
    """Median of the first k candidates of the strictest tier that has k: attribute and size band, attribute, band, all.

    ``ranked`` has the nearest candidates with the own group in it already dropped; a null attribute or size of a
    query switches that filter off.
    """
    same = F.coalesce(F.col(f"q_{attribute}").isNull() | (F.col(f"q_{attribute}") == F.col(f"p_{attribute}")), F.lit(False))
    close = F.coalesce(F.col(f"q_{size}").isNull() | F.col(f"p_{size}").between(F.col(f"q_{size}") * (1 - band), F.col(f"q_{size}") * (1 + band)), F.lit(False))
    mine = Window.partitionBy(f"q_{key}")
    tiers = {1: same & close, 2: same, 3: close, 4: F.lit(True)}
    rows = ranked.withColumns({f"n{t}": F.count(F.when(c, 1)).over(mine) for t, c in tiers.items() if t < 4})
    rows = rows.withColumn("tier", F.when(F.col("n1") >= k, 1).when(F.col("n2") >= k, 2).when(F.col("n3") >= k, 3).otherwise(4))
    inside = F.when(F.col("tier") == 1, tiers[1]).when(F.col("tier") == 2, tiers[2]).when(F.col("tier") == 3, tiers[3]).otherwise(F.lit(True))
    chosen = rows.where(inside).withColumn("place", F.row_number().over(mine.orderBy("rank"))).where(F.col("place") <= k)
    return chosen.groupBy(F.col(f"q_{key}").alias(key)).agg(F.median(f"p_{value}").alias("comparable"), F.min("tier").cast("int").alias("tier"), F.count("*").alias("n_used"))


def _pieces(batches: Iterable[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """Batches of ``rows`` at most, so that distances to all pivots take a bounded table."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((rows * rows).sum(1)[:, None] - 2 * rows @ pivots.T + (pivots * pivots).sum(1)[None, :], 0.0))


def _slack(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """More than a distance to a pivot can be wrong by, for each row."""
    return 1e-6 * (1 + np.sqrt((rows * rows).sum(1)) + np.sqrt((pivots * pivots).sum(1).max(initial=0.0)))


def _in_blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of all batches in tables of ``rows`` rows; the last may have fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if (n := sum(x.num_rows for x in held)) >= rows:
            table, whole = pa.Table.from_batches(held), n - n % rows
            yield from (table.slice(i, rows) for i in range(0, whole, rows))
            held = table.slice(whole).to_batches()
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table, which all have one length, a row for each; floats stay as they are, to be stored."""
    rows = _numbers(table["v"].combine_chunks().flatten()).reshape(table.num_rows, -1)
    return rows if rows.dtype == np.float32 else rows.astype(float)


def _vectors(batch: pd.DataFrame) -> np.ndarray:
    """To reckon with: sums of squares of floats would be wrong by more than ``_slack``."""
    return np.stack(batch["v"].to_numpy()).astype(float)


def _lists(*columns) -> list[pa.Array]:
    """A row that holds each column as one list."""
    arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns]
    return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays]


def _first_copies(keys: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places, in order, of the rows that have fewer than k equal ones with lesser keys: of equal rows no others can be among k nearest."""
    order = np.argsort(keys, kind="stable")
    values = pd.Series([rows[i].tobytes() for i in order])
    return np.sort(order[(values.groupby(values).cumcount() < k).to_numpy()])


@contextmanager
def _few_records(spark: SparkSession, n: int) -> Iterator[None]:
    """Queries that run inside send Python ``n`` rows at a time, for rows that hold blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Nearest:
    """The k nearest rows so far, by (distance, key), for each query of a block; ``within`` bounds the k-th distance."""

    def __init__(self, rows: np.ndarray, within: np.ndarray, k: int):
        self.rows, self.within, self.k = rows.astype(float), within.copy(), k
        self.norms, self.found, self.waiting = (self.rows * self.rows).sum(1), [], 0

    def meet(self, mine: np.ndarray, keys: np.ndarray, others: np.ndarray, ys: np.ndarray) -> None:
        """Queries ``mine`` meet rows: by matrix product those that can be near enough, of these the exact distances.

        Comparisons are turned so that what is no number is kept, and sorted last as in SQL.
        """
        sizes, step, pairs = (others * others).sum(1), max(1, (1 << 20) // len(others)), max(1, VISIT_VALUES // max(1, others.shape[1]))
        for part in (mine[i : i + step] for i in range(0, len(mine), step)):
            rough, norms, within = sizes - 2 * self.rows[part] @ others.T, self.norms[part], self.within[part]
            if len(others) > self.k and len(open_ := np.flatnonzero(np.isinf(within))):
                near = np.partition(rough[open_], self.k - 1, axis=1)[:, self.k - 1]
                within[open_] = np.sqrt(np.maximum(near + norms[open_], 0.0))
            # more than the product, and distances that are equal to 1e-9, can be off by
            slack = 1e-9 * (norms + sizes.max() + within * within) + 2e-9 * within + 1e-18
            query, other = np.nonzero(~(rough > (within * within - norms + slack)[:, None]))
            for i in range(0, len(query), pairs):
                q, o = part[query[i : i + pairs]], other[i : i + pairs]
                d = np.round(np.sqrt(((others[o] - self.rows[q]) ** 2).sum(1)), 9)
                self.found.append((q, keys[o], ys[o], d))
                self.waiting += len(q)
            if self.waiting > 4 * self.k * len(self.rows) + VISIT_VALUES:
                self.least()

    def least(self) -> tuple[np.ndarray, ...] | None:
        """Drops all but the k nearest: (query, key, y, distance)."""
        if not self.found:
            return None
        q, keys, ys, d = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((keys, d, q))
        rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        kept, last = order[rank < self.k], order[rank == self.k - 1]
        self.within[q[last]] = np.fmin(self.within[q[last]], d[last])
        self.found, self.waiting = [(q[kept], keys[kept], ys[kept], d[kept])], 0
        return self.found[0]


def partition_neighbours(queries: DataFrame, pool: DataFrame, k: int, block_rows: int, max_pivots: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest (q, p, y, d) of ``pool`` (k, v, y) for ``queries`` (k, v), among some that aren't, and the (home, pivot) partitions that met.

    Pool rows belong to their nearest pivot, of which the greatest and least distance are known. A query first meets its home, the nearest
    partitions that hold k rows; its k-th distance there bounds the rest: by the triangle inequality a partition whose distances to
    the pivot all differ from the query's by more can't hold a nearer row and is skipped. Exact in any space; how much is skipped depends on the data.

    Queries of near homes and rows of near pivots are packed into blocks, a row of a table for each, of which pairs are joined where one
    may want the other. No row is sent anywhere for each partition that it meets, so that what is shuffled and written grows with
    the input even if every query must meet all rows; pairs of blocks stream through tasks that keep k rows for each query of one block.
    """
    spark = pool.sparkSession
    answer = T.StructType([T.StructField("q", queries.schema["k"].dataType), T.StructField("p", pool.schema["k"].dataType), T.StructField("y", T.DoubleType()), T.StructField("d", T.DoubleType())])
    if not (n_p := pool.count()):
        return spark.createDataFrame([], answer), spark.createDataFrame([], "home int, pivot int")
    n_pivots = 1 if n_p <= block_rows else min(max_pivots, 4 * -(-n_p // block_rows))
    chosen = pool.orderBy(F.xxhash64("k"), "k").limit(n_pivots).select("v").collect()  # max_pivots rows at most
    pivots = np.unique(np.nan_to_num(np.array([r[0] for r in chosen], dtype=float), posinf=0.0, neginf=0.0), axis=0)  # any point can be one
    rows_at_most = max(1, min(block_rows, VISIT_VALUES // max(1, pivots.shape[1])))

    def blocks(rows: DataFrame, n: int, by: Sequence[str], packed, kind: str) -> DataFrame:
        """Rows in order, packed into blocks and written in files of few blocks."""
        n = max(1, -(-n // rows_at_most))
        files = max(min(n, spark.sparkContext.defaultParallelism), -(-n // 16))
        return cut(rows.repartitionByRange(files, *by).sortWithinPartitions(*by).mapInArrow(packed, kind))

    def assigned(batches):
        for batch in _pieces(batches):
            d = _distances(_vectors(batch), pivots)
            yield batch.assign(pivot=d.argmin(1).astype("int32"), far=d.min(1))

    def pool_blocks(batches):
        for table in _in_blocks(batches, rows_at_most):
            table = table.take(_first_copies(_numbers(table["k"]), _matrix(table), k))
            vectors, held = pa.array([_matrix(table).tobytes()], pa.binary()), np.unique(_numbers(table["pivot"]))
            columns = {n: x for n, x in zip(("p", "y", "pivot", "far", "held"), _lists(*(table[n] for n in ("k", "y", "pivot", "far")), held), strict=True)}
            yield pa.RecordBatch.from_pydict({**columns, "w": vectors})

    key_of = lambda df: df.schema["k"].dataType.simpleString()
    placed = pool.mapInPandas(assigned, T.StructType([*pool.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("far", T.DoubleType())]))
    placed = blocks(placed, n_p, ["pivot", "far", "k"], pool_blocks, f"p array<{key_of(pool)}>, y array<double>, pivot array<int>, far array<double>, held array<int>, w binary")
    each = placed.select(F.explode(F.arrays_zip("pivot", "far")).alias("r")).groupBy("r.pivot").agg(F.count("*").alias("n"), F.min("r.far").alias("lo"), F.max("r.far").alias("hi"))
    stats = {r["pivot"]: (r["n"], r["lo"], r["hi"]) for r in each.collect()}  # a row for each pivot
    count, low, high = (np.array([stats.get(i, (0, np.inf, -np.inf))[j] for i in range(len(pivots))]) for j in range(3))

    def homed(batches):
        """Each query's nearest pivot, and how far from it those pivots are whose partitions hold k rows."""
        for batch in _pieces(batches):
            d = _distances(_vectors(batch), pivots)
            order = np.argsort(d, axis=1, kind="stable")
            enough = (np.cumsum(count[order], axis=1) >= k).argmax(1) if count.sum() >= k else np.full(len(d), len(pivots) - 1)
            yield batch.assign(home=order[:, 0].astype("int32"), within=np.take_along_axis(d, order, 1)[np.arange(len(d)), enough])

    def wants(rows: np.ndarray, within: np.ndarray, these: np.ndarray, first: bool) -> np.ndarray:
        """Whether a row wants to meet the partition of each of these pivots."""
        d, most = _distances(rows, pivots[these]), (within + _slack(rows, pivots))[:, None]
        return (count[these] > 0) & ~((d if first else np.maximum(d - high[these], low[these] - d)) > most)

    def visits(first: bool):
        def emit(batches):
            for batch in _pieces(batches):
                asked = wants(_vectors(batch), batch["within"].to_numpy(), np.arange(len(pivots)), first)
                query, pivot = np.nonzero(asked)
                yield pd.DataFrame({"home": batch["home"].to_numpy()[query], "pivot": pivot.astype("int32")}).drop_duplicates()

        return emit

    def met(asked: DataFrame, first: bool) -> DataFrame:
        """The k nearest that queries find in each part of the pool's blocks, in partitions that they want."""
        everything = np.arange(len(pivots))

        def query_blocks(batches):
            for table in _in_blocks(batches, rows_at_most):
                rows, within = _matrix(table), _numbers(table["within"])
                wanted = np.zeros(len(pivots), dtype=bool)
                for i in range(0, len(rows), 512):
                    wanted |= wants(rows[i : i + 512].astype(float), within[i : i + 512], everything, first).any(0)
                columns = dict(zip(("k", "within", "wanted"), _lists(table["k"], table["within"], np.flatnonzero(wanted).astype("int32")), strict=True))
                yield pa.RecordBatch.from_pydict({**columns, "v": pa.array([rows.tobytes()], pa.binary())})

        def compared(batches):
            block, state, keys, kinds = None, None, None, None

            def ended():
                if state and (best := state.least()):
                    q, p, y, d = best
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(q)), pa.array(p, kinds), pa.array(y, pa.float64()), pa.array(d, pa.float64())], ["q", "p", "y", "d"])

            for batch in batches:
                for i in range(batch.num_rows):
                    if batch["block"][i].as_py() != block:
                        yield from ended()
                        block, keys, kinds = batch["block"][i].as_py(), batch["k"][i].values, batch["p"].type.value_type
                        bounds = _numbers(batch["within"][i].values)
                        rows = np.frombuffer(batch["v"][i].as_buffer(), query_type).reshape(len(keys), -1)
                        state = _Nearest(rows, np.full(len(keys), np.inf) if first else bounds, k)
                    theirs, ys, owner = (_numbers(batch[c][i].values) for c in ("p", "y", "pivot"))
                    others = np.frombuffer(batch["w"][i].as_buffer(), pool_type).reshape(len(theirs), -1)
                    held = np.unique(owner)
                    for pivot, asking in zip(held, wants(state.rows, bounds if first else state.within, held, first).T, strict=True):
                        if asking.any():
                            its = np.flatnonzero(owner == pivot)
                            state.meet(np.flatnonzero(asking), theirs[its], others[its].astype(float), ys[its])
            yield from ended()

        left = blocks(asked, n_q, ["home", "k"], query_blocks, f"k array<{key_of(queries)}>, within array<double>, wanted array<int>, v binary").withColumn("block", F.monotonically_increasing_id())
        pairs = left.join(placed.drop("far").hint("shuffle_replicate_nl"), F.arrays_overlap("wanted", "held"))
        with _few_records(spark, 8):
            return cut(pairs.select("block", "k", "within", "v", "p", "y", "pivot", "w").mapInArrow(compared, answer))

    query_type, pool_type = ("float32" if df.schema["v"].dataType.elementType == T.FloatType() else "float64" for df in (queries, pool))
    asked = cut(queries.mapInPandas(homed, T.StructType([*queries.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("within", T.DoubleType())])))
    n_q = asked.count()
    found = met(asked, True)
    if len(pivots) == 1:
        return found, asked.mapInPandas(visits(True), "home int, pivot int").distinct()
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "p")))
    limits = ranked.where(F.col("r") == k).select(F.col("q").alias("k"), F.col("d").alias("limit"))
    bounded = asked.drop("within").join(_dealt(limits), "k", "left").select("k", "v", "home", F.coalesce("limit", F.lit(float("inf"))).alias("within"))
    return met(bounded, False), bounded.mapInPandas(visits(False), "home int, pivot int").distinct()


def feature_knn(queries: DataFrame, pool: DataFrame, key: str, vector: str, target: str, k: int, block_rows: int = 4_096, max_pivots: int = 1_024) -> DataFrame:
    """k-NN regression on vectors with inverse-distance weights; exact matches alone vote where there are some.

    Exact: the pool is parted by pivots and a query meets only parts that the triangle inequality can't rule out, in blocks of
    at most ``block_rows`` rows, each pair of them a matrix product. Distances are taken to 1e-9, ties by pool key.
    Rows without a vector or target are left out. The pool is read some times over instead of being written twice.
    """

    def of(df: DataFrame, *more: Column) -> DataFrame:
        kind = df.schema[vector].dataType
        v = F.col(vector) if kind in (T.ArrayType(T.FloatType(), True), T.ArrayType(T.FloatType(), False)) else F.col(vector).cast("array<double>")  # floats are exact in half the bytes
        return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), v.alias("v"), *more)

    q, p = of(queries), of(pool.where(F.col(target).isNotNull()), F.col(target).cast("double").alias("y"))
    found, _ = partition_neighbours(q, p, k, block_rows, max_pivots)
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "p"))).where(F.col("r") <= k)
    exact = F.avg(F.when(F.col("d") == 0, F.col("y")))
    weight = F.when(F.col("d") > 0, 1 / F.when(F.col("d") > 0, F.col("d")))
    return found.groupBy(F.col("q").alias(key)).agg(F.coalesce(exact, F.sum(weight * F.col("y")) / F.sum(weight)).alias("predicted"))
