"""Every registered query against its SQL in DuckDB, and invariants of the harder operators."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnspark.functions import clean, scalar, text
from cairnspark.operators import boosting, circles, contract, encode, joins, learn, pyramid, ranges, stats
from cairnspark.plans.registry import ORACLE, QUERIES, places
from cairnspark.sources import tables
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def norm(v):
        return None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(norm(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine, theirs = rows(QUERIES[name](spark, SF).toPandas().astype(object)), rows(con.sql(ORACLE[name]).df().astype(object))
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1], strict=True):
        assert a == pytest.approx(b, rel=1e-6) if all(isinstance(x, float) for x in a) else all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-5 * (1 + abs(y))) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("km", [3.0, 20.0])
def test_radius_join_is_all_pairs_and_plans_no_nested_loop(spark, km):
    c = places(spark, SF).withColumn("lon", F.col("lon") + 264.99)  # across the 180th meridian
    c = c.withColumn("lon", F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon")))
    pairs = joins.radius_pairs(c, c, km)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    x, y = c.alias("x"), c.alias("y")
    brute = x.crossJoin(y).where(joins.haversine_km(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon")) <= km)
    assert {tuple(r) for r in pairs.select("q_k", "p_k").collect()} == {tuple(r) for r in brute.select("x.k", "y.k").collect()}


def test_own_group_never_moves_its_encoding(spark):
    data = [("a", g, float(v)) for g, v in (("p", 1), ("p", 3), ("q", 5), ("r", 9))]
    base = spark.createDataFrame(data, "c string, g string, y double")
    moved = base.withColumn("y", F.when(F.col("g") == "p", F.col("y") + 100).otherwise(F.col("y")))
    one, two = (stats.leave_group_out(d, ["c"], "g", "y", 0.0).where("g = 'p'").first()["encoded"] for d in (base, moved))
    assert one == two == 7.0


def test_folds_keep_groups_together_and_cover_all_rows(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey")
    f = stats.balanced_folds(o, "o_custkey", 5)
    assert f.count() == o.count()
    assert f.groupBy("o_custkey").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_contract_rules(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (1, "x", 50.0), (2, None, 7.0)], "k long, name string, v double")
    spec = contract.Contract({"key": ("any", ["k"]), "n": ("numeric", ["v", "gone"]), "t": ("numeric", ["name"])}, {"v": (0, 10)}, ["k", "name"], ["name"])
    found = {(r.kind, r.column): r.n for r in contract.validate(df, spec).collect()}
    assert found == {("missing", "gone"): 1, ("type", "name"): 1, ("bounds", "v"): 1, ("null", "name"): 1, ("duplicate", "k,name"): 2}


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=40)
    model = learn.ridge(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double"), "y", ["a", "b"], 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(model.coefficients.toArray(), np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc), atol=1e-8)


def test_unknown_learner_raises():
    with pytest.raises(KeyError):
        learn.trainer("none such")


def test_nearest_loses_no_query_at_any_density(spark):
    """A crowd at one place, pairs a metre apart, far islands, the 180th meridian, a pole, rows without a place."""
    points = [(i, 10.0, 10.0) for i in range(60)] + [(100, 10.00001, 10.0), (101, -45.0, 179.999), (102, -45.0, -179.999), (103, 89.9, 3.0), (104, 0.0, -120.0)]
    df = spark.createDataFrame([(i, f"g{i % 2}", a, o) for i, a, o in points] + [(200, "g0", None, 1.0)], "k long, g string, lat double, lon double")
    x, y = df.alias("x"), df.alias("y")
    distance = joins.haversine_km(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
    for column in ("k", "g"):
        pairs = x.crossJoin(y).where(F.col(f"x.{column}") != F.col(f"y.{column}")).withColumn("km", F.round(distance, 6)).where("km is not null").select("x.k", F.col("y.k").alias("p"), "km").collect()
        wanted = set()
        for q in {r[0] for r in pairs}:
            wanted |= {(q, r[1]) for r in sorted((r for r in pairs if r[0] == q), key=lambda r: (r[2], r[1]))[:3]}
        for unit in (0.1, 500.0):
            assert {(r.q_k, r.p_k) for r in joins.nearest(df, df, 3, "k", unit, exclude=(column, column)).collect()} == wanted
    assert joins.nearest(df.limit(0), df, 3, "k").count() == 0
    assert joins.nearest(df, df.limit(0), 3, "k").count() == 0


def test_lonely_queries_take_few_rounds(spark, monkeypatch):
    """Queries in another hemisphere than the whole pool start from its density, not from the least radius."""
    tables = []
    monkeypatch.setattr(joins, "cut", lambda df: tables.append(df) or ranges.cut(df))
    pool = spark.range(200).selectExpr("id AS k", "10.0 + id * 0.001 AS lat", "20.0 AS lon")
    far = spark.createDataFrame([(1000, -60.0, -170.0), (1001, -89.0, 5.0)], "k long, lat double, lon double")
    assert {(r.q_k, r["rank"], r.p_k) for r in joins.nearest(far, pool, 2, "k", 0.1).collect()} == {(1000, 1, 0), (1000, 2, 1), (1001, 1, 0), (1001, 2, 1)}
    # the root cell's density says about 900 km at 89 degrees south, and each round doubles it: 2 tables a round, not 38 rounds from the least radius
    assert len(tables) <= 2 + 2 * 7
    tables.clear()
    assert joins.nearest(far, pool.limit(1), 2, "k", 0.1).count() == 2
    assert len(tables) == 4


def test_nearest_sends_no_table_to_the_driver(spark, monkeypatch):
    """Tables that grow with the input aren't broadcast, however small their files: not in the rounds, the result or the encodings made of it."""
    plans = []
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(joins, "cut", lambda df: seen(df) or ranges.cut(df))
    c = stats.group_folds(places(spark, SF), "k", 3)
    seen(joins.neighbour_stats(joins.nearest(c, c, 3, "k", exclude=("fold", "fold")), "k", "value", [3]))
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("small", [1 << 17, 0])
def test_exact_percentiles_and_ranks(spark, monkeypatch, small):
    monkeypatch.setattr(ranges, "SMALL_GROUP", small)
    values = [5.0, 1.0, 1.0, None, 8.0, 3.0, 3.0, 3.0]
    df = spark.createDataFrame([(None if i % 2 else "a", v) for i, v in enumerate(values)], "g string, v double")
    frame = df.toPandas()
    assert ranges.percentiles(df, (), "v", [0.0, 0.3, 0.5, 1.0]).first()[0] == pytest.approx([frame.v.quantile(q) for q in (0.0, 0.3, 0.5, 1.0)])
    found = {r.g: r.quantiles[0] for r in ranges.percentiles(df, ["g"], "v", [0.5]).collect()}
    assert found == {g if isinstance(g, str) else None: m for g, m in frame.groupby("g", dropna=False).v.median().items()}
    assert {r.value: r["rank"] for r in ranges.average_ranks(df, "v").collect()} == dict(zip(frame.v.dropna(), frame.v.dropna().rank(), strict=True))
    assert ranges.percentiles(df.limit(0), (), "v", [0.5]).count() == 0


def test_guards_raise(spark):
    n = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeats"):
        joins.many_to_one(n, n, ["k"])
    with pytest.raises(ValueError, match="without a match"):
        joins.many_to_one(n.withColumn("k", F.lit(3)), n.limit(1), ["k"])
    with pytest.raises(ValueError, match="both sides"):
        clean.no_overlap(n, n, ["k"])
    with pytest.raises(KeyError):
        clean.renamed(n, {"gone": "x"})
    with pytest.raises(FileNotFoundError):
        tables.first_readable(spark, [tables.new_path(spark, "absent")])


def test_weights_are_nonnegative_least_squares():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=200)
    w = learn._nonnegative(x.T @ x, x.T @ y)
    slope = x.T @ (y - x @ w)
    assert (w >= 0).all() and (slope <= 1e-8).all() and np.abs(slope[w > 0]).max() <= 1e-8


def test_out_of_fold_goes_on_where_it_stopped(spark):
    """A whole part is taken as it is, a broken one is fitted again, and other parameters or data never take it."""
    df = spark.createDataFrame([(i, i % 2, float(i), 2.0 * i) for i in range(20)], "k long, fold int, x double, y double")
    bases, path = {"a": {"learner": "linear", "features": ["x"], "regParam": 0.0}}, tables.new_path(spark, "resumed")
    run = lambda d=df, b=bases: {(r.fold, r.k): r.prediction for r in learn.out_of_fold(d, "y", "fold", 2, b, "k", path=path).collect()}
    part = learn.part_path(path, learn.fingerprint(df, ["k", "fold", "y", "x"]), "y", "a", bases["a"], 0, 0)
    spark.createDataFrame([(0, -1.0, 0, "a", 0.5)], "k long, prediction double, fold int, base string, seconds double").write.parquet(part)
    found = run()
    assert found[0, 0] == -1.0 and len(found) == 11 and found[1, 3] == pytest.approx(6.0)
    assert run(b={"a": {**bases["a"], "regParam": 1e-9}})[0, 0] == pytest.approx(0.0, abs=1e-6)
    assert len(run(d=df.withColumn("y", F.col("y") + 1))) == 20
    timed = learn.out_of_fold(df, "y", "fold", 2, bases, "k", path=path, timed=True)
    assert {r.fold: r.seconds for r in learn.fold_metrics(timed, df, "y", "fold", "k").collect()}[0] == 0.5


def test_tasks_of_joined_predictions_have_bounded_rows(spark, monkeypatch):
    """The rows of a task stay as they are when the table grows, whatever the session's shuffle partitions."""
    monkeypatch.setattr(ranges, "TASK_ROWS", 100)
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("fold"), F.col("id").cast("double").alias("y"))
    found = df.select("k", "fold", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("base"), F.col("y").alias("prediction")).where("not (k = 7 and base = 'b')")
    for table, rows in ((learn.scored(found, df, "y", "k"), 5999), (learn.wide(found, "k", ["a", "b"]), 2999)):
        assert table.count() == rows
        assert max(r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()) < 200
    assert {(r.fold, r.base): (r.n, r.mae) for r in learn.fold_metrics(found, df, "y", "fold", "k").collect()} == {(0, "a"): (1500, 0.0), (1, "a"): (1500, 0.0), (0, "b"): (1500, 0.0), (1, "b"): (1499, 0.0)}


def test_halving_finds_the_grid_winner_with_fewer_fits(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 4, float(i), 2.0 * i + i % 3) for i in range(60)], "k long, fold int, x double, y double")
    grid, path = [{"features": ["x"], "regParam": r} for r in (50.0, 20.0, 5.0, 1.0, 0.0)], tables.new_path(spark, "halving")
    fits, real = [], learn.trainer
    monkeypatch.setattr(learn, "trainer", lambda *a, **k: fits.append(1) or real(*a, **k))
    whole = learn.search(df, "y", "fold", 4, "linear", grid, "k")
    full, fits[:] = len(fits), []
    found = learn.halving(df, "y", "fold", 4, "linear", grid, "k", path=path)
    assert found[0][:2] == whole[0] and full == 20 and len(fits) < full and found[0][2] == 4 and len(found) == 5
    fits.clear()
    assert learn.halving(df, "y", "fold", 4, "linear", grid, "k", path=path)[0] == found[0] and not fits


def test_boosting_stops_early(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 7 > 3)) for i in range(200)], "k long, fold int, x double, y double")
    found = learn.out_of_fold(df, "y", "fold", 2, {"boosted": {"features": ["x"], "early_stop": True, "maxIter": 3}}, "k")
    assert found.count() == 200


def test_held_out_rows_move_no_unit_value(spark):
    df = spark.createDataFrame([("a", 10.0, 1), ("b", 1000.0, 0), ("b", 1000.0, 0)], "c string, v double, known int").withColumn("size", F.lit(1))
    assert {r.unit_value for r in stats.unit_value(df, "c", "v", "size", F.col("known") == 1).collect()} == {10.0}


def test_standardised_keeps_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    found = stats.standardised(df, ["a", "b"]).collect()
    assert [r.b for r in found] == [None] * 3 and sorted(r.a for r in found) == pytest.approx([-1.5**0.5, 0.0, 1.5**0.5])


def test_single_quoted_lists_keep_their_names(spark):
    texts = ["""[{'n': "O'Hare"}]""", "{'n': 'None Such'}", r"{'n': 'it\'s'}", """{'n': 'a "b" c'}""", "{'n': None}", "{'n': 'True'}", "{'n': 'x", "None", "[None, {'n': 'y'}]", '{"n": "None \'q\'"}', None, "", "'" * 5000]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean.structs(F.col("t"), "n string")).collect()]
    assert [x and [y.n for y in x] for x in found] == [["O'Hare"], ["None Such"], ["it's"], ['a "b" c'], [None], ["True"], None, None, ["y"], ["None 'q'"], None, None, None]


def test_lookup_takes_the_place_of_a_column(spark):
    left, right = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, v double"), spark.createDataFrame([(1, 7.0)], "k int, v double")
    found = joins.lookup(left, right, ["k"], ["v"], 0.0)
    assert found.columns == ["k", "v"] and {tuple(r) for r in found.collect()} == {(1, 7.0), (2, 0.0)}


def test_null_levels_and_categories(spark):
    df = spark.createDataFrame([(None, 1.0, 0), ("__missing__", 3.0, 0), ("a", None, 1), ("b", 5.0, 1)], "c string, y double, fold int")
    found = {r.c: (r.mean_1, r.n_1) for r in stats.nested_means(df, ["c"], "y", 0.0).where("c <> 'a' or c is null").collect()}
    assert found == {None: (1.0, 1), "__missing__": (3.0, 1), "b": (5.0, 1)}
    assert {r.c: r.encoded for r in stats.smoothed_means(df, "c", "y", 2.0).collect()}["a"] == 3.0
    assert {r.c: r.encoded for r in stats.leave_fold_out(df, "c", "y", "fold", 2.0).collect()} == {None: 5.0, "__missing__": 5.0, "a": 2.0, "b": 2.0}


@pytest.mark.parametrize("small", [1 << 17, 0])
def test_own_fold_never_moves_its_encodings(spark, monkeypatch, small):
    monkeypatch.setattr(ranges, "SMALL_GROUP", small)
    """Mean, median and neighbours of a fold's rows stay when its targets change, and are those of a plain loop over folds."""
    c = stats.group_folds(places(spark, SF), "k", 3).withColumn("value", F.when(F.col("k") % 13 > 0, F.round("value", -2))).withColumn("attr", F.when(F.col("k") % 7 > 0, F.col("attr")))
    names = ["encoded", "median", "n_rest", "near"]
    both = [{r.k: tuple(r) for r in encode.fold_encodings(d, "k", "attr", "value", "nation", "fold", 5.0, 3).select("k", "fold", *names).collect()} for d in (c, c.withColumn("value", F.when(F.col("fold") == 1, F.col("value") * 3 + 7).otherwise(F.col("value"))))]
    assert {k: v for k, v in both[0].items() if v[1] == 1} == {k: v for k, v in both[1].items() if v[1] == 1} and both[0] != both[1]
    frame = c.toPandas()
    for fold in range(3):
        rest = frame[(frame.fold != fold) & frame.value.notna()]
        middle, n = rest.groupby("attr").value.median(), rest.groupby("attr").value.size()
        for r in frame[frame.fold == fold].itertuples():
            got = both[0][r.k]
            assert got[3:5] == ((pytest.approx(middle[r.attr]), n[r.attr]) if isinstance(r.attr, str) else (pytest.approx(rest.value.median()), 0))


@pytest.mark.parametrize("small", [1 << 17, 0])
def test_medians_of_several_columns_take_one_pass(spark, monkeypatch, small):
    monkeypatch.setattr(ranges, "SMALL_GROUP", small)
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), (None, 9.0, None), ("b", None, None)], "g string, x double, y double")
    found = {r.g: (r.mx, r.my) for r in ranges.medians(df, ["g"], {"mx": F.col("x"), "my": F.col("y")}).collect()}
    assert found == {"a": (2.0, 2.0), None: (9.0, None)}
    assert tuple(ranges.medians(df.limit(0), (), {"mx": F.col("x")}).first()) == (None,)


@pytest.mark.parametrize("small", [1 << 17, 0])
def test_structure_of_small_groups_is_one_aggregate(spark, monkeypatch, small):
    """The same rows either way, with null groups and values; small groups need one shuffle and no join."""
    monkeypatch.setattr(ranges, "SMALL_GROUP", small)
    df = spark.createDataFrame([("a", 1.0, "x", 2), ("a", 3.0, None, 1), ("a", None, "y", 3), (None, 2.0, "x", 1), ("b", None, None, 1)], "g string, v double, k string, r long")
    found = stats.structure(df, "g", "v", "k", "r")
    assert {r.g: tuple(r)[1:8] for r in found.collect()} == {"a": (3, 2, 2, 1.0, 3.0, None, 2.0), None: (1, 1, 1, 2.0, 2.0, "x", 2.0), "b": (1, 0, 0, None, None, None, None)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert small == 0 or ("Join" not in plan and plan.count("Exchange") == 1)


def test_range_counts_are_those_of_all_pairs(spark):
    """Near the pole, across the 180th meridian, at crowded places, with and without an own group, for several radii."""
    import random

    rng = random.Random(4)
    points = [(i, rng.choice(["a", "b", None]), i % 3, 50 + rng.random(), 8 + rng.random()) for i in range(150)] + [(i, "a", i % 2, 10.0, 10.0) for i in range(200, 260)]
    points += [(300 + i, "b", i, rng.choice([89.2, 89.7, -45.0]), rng.choice([179.99, -179.99, 10.0, -170.0])) for i in range(20)] + [(400, "a", 0, None, 1.0)]
    df = spark.createDataFrame(points, "k long, attr string, g int, lat double, lon double")
    x, y = df.alias("x"), df.alias("y")
    pairs = x.crossJoin(y).withColumn("km", joins.haversine_km(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))).select("x.k", "km", (F.col("x.attr") == F.col("y.attr")).alias("same"), (F.col("x.g") != F.col("y.g")).alias("other")).toPandas()
    for km, same, exclude in ((20.0, ["attr"], "g"), (3.0, [], None), (300.0, [], "g")):
        kept = pairs[(pairs.km <= km) & (pairs.same.eq(True) if same else True) & (pairs.other if exclude else True)]
        want = {p[0]: int((kept.k == p[0]).sum()) for p in points}
        assert {r.k: r.n for r in pyramid.range_counts(df, df, "k", km, same, exclude).collect()} == want


@pytest.mark.parametrize("km", [2.0, 25.0, 300.0])
def test_strips_count_what_all_pairs_count(monkeypatch, km):
    """On grids, at random places, across the 180th meridian and near a pole; and most of a circle is counted without a comparison."""
    import numpy as np

    rng, compared = np.random.default_rng(3), []
    exact = circles._km
    monkeypatch.setattr(circles, "_km", lambda *x: compared.append(np.broadcast(*x).size) or exact(*x))
    for lat, lon, grid in ((33.0, -85.0, 0), (33.0, -85.0, 97), (-71.0, 179.5, 0), (88.5, 10.0, 0)):
        a, o = (s + (rng.integers(0, grid, 4000) / grid if grid else rng.random(4000)) for s in (lat, lon))
        o, n = (o + 180) % 360 - 180, rng.integers(1, 4, 4000)
        compared.clear()
        found = circles._counts(a[:90], o[:90], a, o, n, km)
        assert km > 25 or lat > 80 or sum(compared) < 0.15 * 90 * 4000
        assert (found == [int((exact(x, y, a, o) <= km) @ n) for x, y in zip(a[:90], o[:90], strict=True)]).all()


def test_blocks_are_dealt_in_shares(spark, monkeypatch):
    """Many small shares of queries and pool give the same counts as one."""
    c = places(spark, SF)
    whole = {r.k: r.n for r in pyramid.range_counts(c, c, "k", 30.0, ["attr"], "nation").collect()}
    monkeypatch.setattr(circles, "QUERY_ROWS", 2)
    monkeypatch.setattr(circles, "POOL_ROWS", 3)
    assert {r.k: r.n for r in pyramid.range_counts(c, c, "k", 30.0, ["attr"], "nation").collect()} == whole and sum(whole.values()) > 0


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_percentiles_in_circles_make_no_pairs(spark, monkeypatch, most):
    """Those of all pairs, with null values, own rows, the 180th meridian and crowded cells; pairs are joined for crowded cells only."""
    joined = []
    monkeypatch.setattr(circles, "VALUE_ROWS", most)
    monkeypatch.setattr(circles, "radius_pairs", lambda *x: joined.append(x) or joins.radius_pairs(*x))
    c = places(spark, SF).withColumn("value", F.when(F.col("k") % 7 > 0, F.col("value"))).withColumn("lon", F.when(F.col("lon") < -84.5, F.col("lon") + 264.5).otherwise(F.col("lon") - 95.5))
    found = circles.percentiles(c, c, "k", "value", 30.0, [0.0, 0.3, 0.5], ["attr"])
    assert len(joined) == 1 and ("Union" in found._jdf.queryExecution().executedPlan().toString()) == (most == 1)
    x, y = c.alias("x"), c.alias("y")
    pairs = x.crossJoin(y).where((F.col("x.k") != F.col("y.k")) & (F.col("x.attr") == F.col("y.attr")) & (joins.haversine_km(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon")) <= 30.0)).select("x.k", F.col("y.value").alias("v")).toPandas()
    got = {r.k: r for r in found.collect()}
    assert len(got) == pairs.k.nunique() > 50
    for k, v in pairs.groupby("k").v:
        assert got[k].n == len(v)
        if v.notna().any():
            assert got[k].q == pytest.approx([v.quantile(s) for s in (0.0, 0.3, 0.5)])


def test_compared_pairs_grow_with_the_border(spark):
    """Four times the places in a circle: well under four times the comparisons; crowds at one place are compared once."""
    def compared(n):
        rows = spark.range(n).select(((F.col("id") * 7919 % 10007) / 10007 + 40).alias("a"), ((F.col("id") * 104729 % 10009) / 10009 + 9).alias("o"), F.lit(1).cast("long").alias("n"))
        q = spark.createDataFrame([(1, 40.5, 9.5)], "__q long, a double, o double")
        found = pyramid.decomposed(q, rows, 30.0, [])
        return found.leaves.join(found.places.drop("a", "o"), ["level", "y", "x"]).count(), found.totals.agg(F.sum("n")).first()[0]

    (few, inside), (more, inside4) = compared(2500), compared(10000)
    assert inside4 > 3 * inside and more < 3 * few


def test_pruned_neighbours_are_exact_and_skip_partitions(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 4)) * 100
    points = [(i, (centres[i % 12] + rng.normal(size=4)).tolist(), float(i % 7)) for i in range(600)] + [(600 + i, centres[0].tolist(), 1.0) for i in range(40)]
    df = spark.createDataFrame(points, "k long, v array<double>, y double")
    asked = df.where("k % 5 = 0").select("k", "v")
    for k in (1, 6):
        found, visits = joins.partition_neighbours(asked, df, k, 50, 16)
        best = {}
        for r in found.collect():
            best.setdefault(r.q, set()).add((r.d, r.p))
        v = np.array([p[1] for p in points])
        for q in range(0, 640, 5):
            d = np.round(np.sqrt(((v - v[q]) ** 2).sum(1)), 9)
            assert sorted(best[q])[:k] == sorted(zip(d.tolist(), range(640), strict=True))[:k]
        homes, met = visits.select("home").distinct().count(), visits.count()
        assert met < 0.5 * homes * 16
    assert joins.feature_knn(df.limit(0), df, "k", "v", "y", 3).count() == 0 == joins.feature_knn(df, df.limit(0), "k", "v", "y", 3).count()


def test_visits_come_in_bounded_batches(spark, monkeypatch):
    """Queries that rule out no partition ask for all of them: their vectors leave a task a few at a time, and the neighbours stay."""
    import numpy as np

    v = np.random.default_rng(5).normal(size=(400, 24))
    df = spark.createDataFrame([(i, x.tolist(), float(i % 7)) for i, x in enumerate(v)], "k long, v array<double>, y double")
    sizes = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(joins, "VISIT_VALUES", 25 * 40)
    emitted = []

    def watched(self, function, schema):
        def run(batches):
            for out in function(batches):
                if list(out.columns) == ["k", "v", "home", "pivot"] and len(out) > 40 + 64:
                    sizes.add(1)
                yield out

        emitted.append(schema)
        return original(self, run, schema)

    original = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", watched)
    found, visits = joins.partition_neighbours(df.select("k", "v"), df, 3, 10, 64)
    best = {}
    for r in found.collect():
        best.setdefault(r.q, set()).add((r.d, r.p))
    assert len(emitted) == 3 and sizes.value == 0 and visits.count() > 1000
    for q in range(400):
        d = np.round(np.sqrt(((v - v[q]) ** 2).sum(1)), 9)
        assert sorted(best[q])[:3] == sorted(zip(d.tolist(), range(400), strict=True))[:3]


def test_neighbours_that_meet_all_rows_take_little_disk(spark):
    """Queries that rule out no partition: what is shuffled and written stays a few times the vectors, however many partitions meet."""
    import numpy as np

    v = np.random.default_rng(6).normal(size=(1500, 32))
    df = spark.createDataFrame([(i, x.tolist(), float(i % 7)) for i, x in enumerate(v)], "k long, v array<double>, y double")
    path = tables.new_path(spark, "vectors")
    df.write.parquet(path)
    df, context = spark.read.parquet(path), spark.sparkContext._jsc.sc()
    folder, none = tables.shared_folder(spark).removeprefix("file://"), spark.sparkContext._jvm.java.util.ArrayList()

    def used():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}, sum(os.path.getsize(f) for f in glob.glob(f"{folder}/*/*.parquet"))

    earlier, kept = used()
    found, visits = joins.partition_neighbours(df.where("k % 5 = 0").select("k", "v"), df.where("k % 5 <> 0"), 3, 20, 64)
    stages, written = used()
    shuffled = sum(n for stage, n in stages.items() if stage not in earlier)
    assert 0 < shuffled < 4 * v.nbytes and written - kept < 4 * v.nbytes
    rows = found.collect()
    assert visits.count() > 0.9 * visits.select("home").distinct().count() * 64
    others = np.flatnonzero(np.arange(1500) % 5)
    for q in range(0, 1500, 5):
        d = np.round(np.sqrt(((v[others] - v[q]) ** 2).sum(1)), 9)
        assert sorted((r.d, r.p) for r in rows if r.q == q)[:3] == sorted(zip(d.tolist(), others.tolist(), strict=True))[:3]


def test_neighbours_among_copies_and_without_numbers(spark):
    """Ties of copies in many blocks go by key, also by text; vectors that hold no number come last, as in SQL, and a query that has one gets its row."""
    nan = float("nan")
    vectors = [[1.0, 0.0]] * 60 + [[0.0, 1.0]] * 60 + [[float(i), 3.0] for i in range(30)] + [[nan, 0.0]] * 2
    df = spark.createDataFrame([(f"{i * 37 % 152:03}", v, float(i % 11)) for i, v in enumerate(vectors)], "k string, v array<float>, y double")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 5.0]), ("d", [nan, 1.0]), ("e", [nan, 0.0])], "k string, v array<float>")
    found = {r.k: r.predicted for r in joins.feature_knn(asked, df, "k", "v", "y", 7, 8, 16).collect()}
    rows = [(r.k, r.v, r.y) for r in df.collect()]
    for q, v in {"a": (1.0, 0.0), "b": (1.0, 1.0), "c": (0.0, 5.0)}.items():
        best = sorted((round(math.dist(v, w), 9), k, y) for k, w, y in rows if w[0] == w[0])[:7]
        same = [y for d, _, y in best if d == 0]
        assert found[q] == pytest.approx(sum(same) / len(same) if same else sum(y / d for d, _, y in best) / sum(1 / d for d, _, _ in best))
    assert len(found) == 5 and math.isnan(found["d"]) and math.isnan(found["e"])
    few = joins.feature_knn(asked, df.where("k >= '148'"), "k", "v", "y", 7, 2, 4)
    assert few.count() == 5


def test_median_boosting_is_the_plain_loop(spark):
    """Each round's leaf values are the medians of its residuals, predictions their sum, and the error falls; early stopping keeps the best rounds."""
    frame = pd.DataFrame({"k": range(240)})
    frame["x"], frame["z"] = frame.k * 37 % 101 / 10.0, frame.k % 5 * 1.0
    frame["y"] = (frame.x > 5) * 10.0 + frame.z + (frame.k % 17 == 0) * 500.0
    data = learn.assembled(spark.createDataFrame(frame), ["x", "z"])
    model = boosting.MedianBoosting(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.5).fit(data)
    plain = pd.Series(frame.y.median(), index=frame.k)
    y = frame.set_index("k").y
    for i, tree in enumerate(model.trees):
        leaf = tree.copy().setLeafCol("leaf").transform(data).select("k", "leaf").toPandas().set_index("k").leaf
        middle = (y - plain).groupby(leaf).median()
        assert middle.to_dict() == pytest.approx(model.leaves[i])
        plain = plain + 0.5 * leaf.map(middle)
    found = model.transform(data).select("k", "prediction").toPandas().set_index("k").prediction
    assert found.sort_index().to_numpy() == pytest.approx(plain.sort_index().to_numpy())
    ordinary = y[y < 400].index
    assert (y - found)[ordinary].abs().mean() < 0.5 * (y - y.median())[ordinary].abs().mean()
    stopped = boosting.MedianBoosting(labelCol="y", maxIter=6, maxDepth=2, stepSize=2.5, validationIndicatorCol="held", patience=1).fit(data.withColumn("held", F.col("k") % 4 == 0))
    assert len(stopped.trees) < 6
    folds = learn.out_of_fold(data.withColumn("fold", F.col("k").cast("int") % 2), "y", "fold", 2, {"boosted_median": {"maxIter": 2}}, "k")
    assert folds.count() == 240 and folds.where("prediction is null").count() == 0


def test_dictionary_codes_bring_no_labels_to_the_driver(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 4999).cast("string").alias("c"))
    codes = learn.dictionary(df, "c")
    assert {r.value: r.code for r in codes.collect()} == {v: i for i, v in enumerate(sorted(str(x) for x in range(4999)))}
    plan = learn.encoded(df, "c", codes, "code")._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "Python" not in plan
    assert [r.code for r in learn.encoded(spark.createDataFrame([("no",), (None,)], "c string"), "c", codes, "code").collect()] == [4999, 4999]


def test_curve_cells_nest_and_prune_files(spark):
    c = places(spark, SF).withColumn("code", scalar.curve_code(F.col("lat"), F.col("lon"), 20))
    names = c.select(*[scalar.curve_cell(F.col("lat"), F.col("lon"), n).alias(f"n{n}") for n in (3, 9, 20)]).collect()
    assert all(r.n20.startswith(r.n9) and r.n9.startswith(r.n3) and len(r.n20) == 20 for r in names)
    path = tables.new_path(spark, "clustered")
    c.repartitionByRange(16, "code").sortWithinPartitions("code").write.parquet(path)
    cell = c.select(scalar.curve_code(F.col("lat"), F.col("lon"), 10).alias("cell")).groupBy("cell").count().orderBy("count", "cell").first()["cell"]
    low, high = spark.range(1).select(*scalar.curve_range(F.lit(cell), 10, 20)).first()
    asked = spark.read.parquet(path).where(F.col("code").between(low, high))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(code,{low})" in plan and f"LessThanOrEqual(code,{high})" in plan
    assert asked.count() == c.where(scalar.curve_code(F.col("lat"), F.col("lon"), 10) == cell).count() > 0
    assert asked.select(F.input_file_name()).distinct().count() <= 3


def test_long_word_lists_compile(spark):
    df = spark.createDataFrame([("Token 99999 here",), ("none",), (None,), ("The Old  Mill Inn",)], "t string")
    assert [r[0] for r in df.select(text.any_of_many(F.col("t"), [f"token {i}" for i in range(1000, 101000)])).collect()] == [1, 0, 0, 0]
    assert [r[0] for r in df.select(text.any_of_many(F.col("t"), [])).collect()] == [0] * 4
    entries = spark.range(100000).select(F.concat(F.lit("token "), F.col("id")).alias("v")).union(spark.createDataFrame([("old",), ("OLD  mill",)], "v string"))
    found = {r.t: r.brand for r in text.brands(df, "t", entries, "v", "brand").collect()}
    assert found == {"Token 99999 here": "token 99999", "none": "none", None: clean.SENTINEL, "The Old  Mill Inn": "old  mill"}


def test_checked_writes_take_one_job_and_find_what_validate_finds(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (2, None, 50.0), (3, "y", -1.0)], "k long, name string, v double")
    spec = contract.Contract({"any": ("any", ["k"]), "n": ("numeric", ["v", "name"])}, {"v": (0, 10)}, identity=["name"])
    tracker, group = spark.sparkContext.statusTracker(), "checked"
    spark.sparkContext.setJobGroup(group, group)
    path = tables.new_path(spark, "checked")
    found = contract.write_checked(df, spec, path)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1 and sorted(map(tuple, found.collect())) == sorted(map(tuple, contract.validate(df, spec).collect()))
    assert spark.read.parquet(path).count() == 3 and contract.summary(found).count("\n") == found.count() - 1
