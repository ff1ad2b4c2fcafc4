"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.functions import clean, scalar, text
from cairnspark.operators import circles, contract, encode, joins, learn, pyramid, ranges, stats
from cairnspark.sources import tables
from cairnspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Places for customers: the same arithmetic in both engines.
_PLACES = "SELECT c_custkey AS k, c_mktsegment AS attr, c_nationkey AS nation, c_acctbal AS value, 33 + CAST(c_custkey * 7919 % 997 AS DOUBLE) / 997 AS lat, -85 + CAST(c_custkey * 104729 % 1009 AS DOUBLE) / 1009 AS lon FROM customer"
_KM = "2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
_PAIRS = f"WITH c AS ({_PLACES}), pairs AS (SELECT x.k AS k, x.attr AS qa, x.value AS qv, y.k AS p, y.attr AS pa, y.value AS pv, {_KM.format(a='x.', b='y.')} AS km FROM c x JOIN c y ON x.k <> y.k)"
#: Word lists of our own test bed.
ANCHORS = {"north": (33.9, -84.5), "south": (33.1, -84.4), "west": (33.5, -84.95)}
BRANDS = ("part", "misty", "lavender blue")
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
STREETS = {"street": "st", "st": "st", "avenue": "ave", "ave": "ave", "road": "rd", "rd": "rd"}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    lat = F.lit(33) + (F.col("c_custkey") * 7919 % 997).cast("double") / 997
    lon = F.lit(-85) + (F.col("c_custkey") * 104729 % 1009).cast("double") / 1009
    return c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("attr"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("value"), lat.alias("lat"), lon.alias("lon"))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with two predictions made by arithmetic, for error tables."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * (F.lit(90) + F.col("o_orderkey") % 21) / 100).alias("p_a"), (F.col("o_totalprice") + (F.col("o_orderkey") % 7 - 3) * 1000).alias("p_b"))


_PRICED = "WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice AS y, o_totalprice * (90 + o_orderkey % 21) / 100 AS p_a, o_totalprice + (o_orderkey % 7 - 3) * 1000 AS p_b FROM orders)"


# --- B: cleaning ---------------------------------------------------------------------------------
@query("""SELECT o_orderkey, CASE WHEN t IN ('Yes', 'T', '1') THEN 1 WHEN t IN ('no', '') THEN 0 END AS flag FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'no' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'odd' END END AS t FROM orders)""")
def clean_bool_tokens(spark, d):
    o = table(spark, d, "orders")
    token = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "no").when(F.col("o_orderkey") % 2 == 0, "T").otherwise("odd")
    return o.select("o_orderkey", clean.flag(token, ["Yes", "T"], ["no", ""]).alias("flag"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN 2 WHEN p_size < 40 THEN 3 END AS grade FROM part")
def grade_ordinal(spark, d):
    letter = F.when(F.col("p_size") < 10, "c").when(F.col("p_size") < 20, "B").when(F.col("p_size") < 40, " a ").otherwise("?")
    return table(spark, d, "part").select("p_partkey", clean.ordinal(letter, ["C", "B", "A"]).alias("grade"))


@query("""SELECT event_id, (props::JSON->>'k')::DOUBLE AS k, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE 1 END::INTEGER AS size FROM events""")
def json_parse_match(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[{'name': 'x', 'size': 9}, {'name': 'y', 'size': "), (F.col("event_id") % 5).cast("string"), F.lit("}]"))).otherwise('{"name": "z", "size": 1}')
    item = clean.matching(clean.structs(raw, "name string, size int"), "name", F.lit("y"))
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), item["size"].alias("size"))


@query("SELECT o_orderkey, greatest(0, 2000 - nullif(year(o_orderdate), 1996))::INTEGER + CASE WHEN year(o_orderdate) = 1996 THEN NULL ELSE 0 END AS age, CASE WHEN year(o_orderdate) = 1996 THEN 'missing' ELSE (year(o_orderdate) // 10 * 10)::VARCHAR || 's' END AS decade FROM orders")
def age_clip(spark, d):
    year = F.nullif(F.year("o_orderdate"), F.lit(1996))
    return table(spark, d, "orders").select("o_orderkey", scalar.age(year, 2000).alias("age"), scalar.decade(year).alias("decade"))


@query("SELECT n_nationkey AS nation_id, n_name AS label, 'v1' AS version, n_regionkey::DOUBLE AS region_value, n_nationkey AS nation_copy FROM nation")
def schema_projection(spark, d):
    return clean.renamed(table(spark, d, "nation"), {"n_nationkey": "nation_id", "n_name": "label", "n_regionkey": "region_value"}, {"nation_copy": "nation_id"}, {"version": "v1"}, {"region_value": "double"}, first=["label"])


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '__missing__') AS status FROM orders WHERE o_totalprice > 0 AND o_orderkey % 11 <> 0")
def usable_rows(spark, d):
    o = table(spark, d, "orders").withColumn("size", F.nullif(F.col("o_orderkey") % 11, F.lit(0)))
    return clean.usable(o, "o_totalprice", present=["size"]).select("o_orderkey", clean.or_sentinel(F.nullif("o_orderstatus", F.lit("P"))).alias("status"))


# --- C: scalars and text -------------------------------------------------------------------------
@query(f"WITH c AS ({_PLACES}), e AS (SELECT k, " + ", ".join(f"{_KM.format(a='', b='').replace('radians(lat - lat)', f'radians({y} - lat)').replace('cos(radians(lat)) * cos(radians(lat))', f'cos(radians(lat)) * cos(radians({y}))').replace('radians(lon - lon)', f'radians({x} - lon)')} AS dist_{n}_km" for n, (y, x) in ANCHORS.items()) + " FROM c) SELECT *, least(dist_north_km, dist_south_km, dist_west_km) AS dist_min_km FROM e")
def anchor_distances(spark, d):
    each = scalar.anchor_distances(F.col("lat"), F.col("lon"), ANCHORS)
    return places(spark, d).select("k", *[c.alias(n) for n, c in each.items()])


@query(f"WITH c AS ({_PLACES}) SELECT k, CASE WHEN k % 11 = 0 THEN '__missing__' ELSE floor(lat / 0.05::DOUBLE)::BIGINT || '_' || floor(lon / 0.05::DOUBLE)::BIGINT END AS fine, CASE WHEN k % 11 = 0 THEN '__missing__' ELSE floor(lat / 0.25::DOUBLE)::BIGINT || '_' || floor(lon / 0.25::DOUBLE)::BIGINT END AS coarse FROM c")
def grid_cells(spark, d):
    lat = F.when(F.col("k") % 11 != 0, F.col("lat"))
    return places(spark, d).select("k", scalar.grid_cell(lat, F.col("lon"), 0.05).alias("fine"), scalar.grid_cell(lat, F.col("lon"), 0.25).alias("coarse"))


@query("SELECT p_partkey, p_size * p_retailprice AS product, p_retailprice / CASE WHEN p_size % 5 > 0 THEN p_size % 5 ELSE 1 END AS safe, CASE WHEN p_size % 5 > 0 THEN p_retailprice / (p_size % 5) END AS strict, ln(1 + p_size) AS log_size, least(p_size / 40.0::DOUBLE, 1.0::DOUBLE) AS clipped FROM part")
def interactions_ratios(spark, d):
    size, b = F.col("p_size"), F.col("p_size") % 5
    return table(spark, d, "part").select("p_partkey", (size * F.col("p_retailprice")).alias("product"), scalar.safe_ratio(F.col("p_retailprice"), b).alias("safe"), scalar.ratio(F.col("p_retailprice"), b).alias("strict"), scalar.log1p_or_zero(size).alias("log_size"), scalar.unit_clip(size / F.lit(40.0)).alias("clipped"))


@query("SELECT p_partkey, ((coalesce(s, -1) >= 0)::INT + (coalesce(s, -1) >= 10)::INT + (coalesce(s, -1) >= 25)::INT) AS bin, coalesce(round_even(s / 2.0::DOUBLE, 0), -1)::INT AS half FROM (SELECT p_partkey, nullif(p_size, 7) AS s FROM part)")
def edge_bins(spark, d):
    s = F.nullif("p_size", F.lit(7))
    return table(spark, d, "part").select("p_partkey", scalar.edge_bin(s, [0, 10, 25]).alias("bin"), scalar.half_even(s / F.lit(2.0)).alias("half"))


@query("SELECT o_orderkey, ln(1 + o_totalprice) AS log_y, greatest(o_totalprice, 1000.0::DOUBLE) AS back, ln(1 + o_totalprice / (1 + o_orderkey % 9)) AS log_unit FROM orders")
def log_target_roundtrip(spark, d):
    y, size = F.col("o_totalprice"), 1 + F.col("o_orderkey") % 9
    return table(spark, d, "orders").select("o_orderkey", scalar.log_target(y).alias("log_y"), F.greatest(F.round(scalar.from_log_target(scalar.log_target(y), floor=1000.0), 4), F.lit(1000.0)).alias("back"), scalar.log_target(y, size).alias("log_unit"))


_ADDRESS = "(1 + p_partkey % 90)::VARCHAR || CASE WHEN p_partkey % 4 = 0 THEN '-7' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' NE' ELSE '' END || '  Oak Hill ' || CASE p_partkey % 3 WHEN 0 THEN 'Street' WHEN 1 THEN 'Ave' ELSE 'Way' END"


def _addresses(spark, d):
    k = F.col("p_partkey")
    address = F.concat((1 + k % 90).cast("string"), F.when(k % 4 == 0, "-7").otherwise(""), F.when(k % 3 == 0, " NE").otherwise(""), F.lit("  Oak Hill "), F.when(k % 3 == 0, "Street").when(k % 3 == 1, "Ave").otherwise("Way"))
    return table(spark, d, "part").withColumn("address", address)


@query(rf"""WITH t AS (SELECT p_partkey, lower(p_name) AS n, {_ADDRESS} AS a FROM part) SELECT p_partkey, CASE WHEN n LIKE 'lavender blue %' OR n = 'lavender blue' THEN 'lavender blue' WHEN n LIKE 'misty %' OR n = 'misty' THEN 'misty' WHEN n LIKE 'part %' OR n = 'part' THEN 'part' ELSE regexp_extract(n, '^\S+') END AS brand, CASE p_partkey % 3 WHEN 0 THEN 'st' WHEN 1 THEN 'ave' ELSE '__missing__' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'ne oak hill street' WHEN p_partkey % 3 = 1 THEN 'oak hill ave' ELSE 'oak hill way' END AS street, CASE WHEN p_partkey % 3 = 0 THEN 'NE' ELSE '__missing__' END AS direction, 1 + p_partkey % 90 AS house FROM t""")
def text_brand_street(spark, d):
    a = F.col("address")
    return _addresses(spark, d).select("p_partkey", text.brand(F.col("p_name"), BRANDS).alias("brand"), text.street_type(a, STREETS).alias("kind"), text.street_name(a).alias("street"), text.direction(a, COMPASS).alias("direction"), text.house_number(a).alias("house"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents) SELECT doc_id, (lower(t) LIKE '%the%' OR lower(t) LIKE '%der %')::INT AS has_any, regexp_matches(t, '^(The|Der|La)\s')::INT AS starts, regexp_matches(t, '[0-9]')::INT AS digit, (t LIKE '%&%')::INT AS ampersand, length(t) AS n_chars, CASE WHEN trim(t, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(t, ' '), '\s+')) END::INT AS n_words, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) / greatest(length(t), 1)::DOUBLE AS upper_ratio, (contains(lower(t), lang))::INT AS lang_in FROM t""")
def text_flags_stats(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.any_of(t, ["the", "der "]).alias("has_any"), text.like(t, r"^(The|Der|La)\s").alias("starts"), text.like(t, "[0-9]").alias("digit"), text.like(t, "&").alias("ampersand"), *[c.alias(n) for n, c in text.statistics(t).items()], text.first_word_in(F.col("lang"), t).alias("lang_in"))


@query("WITH v AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2]) AS v FROM part WHERE p_partkey % 3 = 0 AND p_name LIKE '% %'), n AS (SELECT p_partkey, lower(p_name) AS n, string_split(lower(p_name), ' ') AS w FROM part) SELECT p_partkey, coalesce(v, w[1]) AS brand FROM n LEFT JOIN v ON v = w[1] || ' ' || w[2]")
def long_vocabulary(spark, d):
    """Names against a vocabulary that is a table: the first two words of a third of all names."""
    p = table(spark, d, "part")
    words = F.split(F.lower("p_name"), " ")
    vocabulary = p.where("p_partkey % 3 = 0 and p_name like '% %'").select(F.array_join(F.slice(words, 1, 2), " ").alias("v"))
    return text.brands(p, "p_name", vocabulary, "v", "brand").select("p_partkey", "brand")


@query("SELECT doc_id, coalesce(contains(lower(text), 'the') OR contains(lower(text), 'der ') OR contains(lower(text), 'qu') OR contains(lower(text), '99'), false)::INT AS has_any FROM documents")
def many_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.any_of_many(F.col("text"), ["the", "der ", "qu", "99", *[f"not in any text {i}" for i in range(2000)]]).alias("has_any"))


@query(f"WITH c AS ({_PLACES}), t AS (SELECT k, CASE WHEN k % 11 > 0 THEN floor((lat + 90) / (360 / 4096.0::DOUBLE))::BIGINT END AS y, floor((lon + 180) / (360 / 4096.0::DOUBLE))::BIGINT AS x FROM c), n AS (SELECT k, coalesce(list_aggregate(list_transform(range(11, -1, -1), lambda i: (((y >> i) & 1) * 2 + ((x >> i) & 1))::VARCHAR), 'string_agg', ''), '') AS s, y FROM t) SELECT k, CASE WHEN y IS NULL THEN '__missing__' ELSE s END AS fine, CASE WHEN y IS NULL THEN '__missing__' ELSE left(s, 7) END AS coarse FROM n")
def curve_cells(spark, d):
    """Cells along a Z-curve at two levels; the coarse name is a prefix of the fine one."""
    lat = F.when(F.col("k") % 11 != 0, F.col("lat"))
    return places(spark, d).select("k", scalar.curve_cell(lat, F.col("lon"), 12).alias("fine"), scalar.curve_cell(lat, F.col("lon"), 7).alias("coarse"))


# --- D: joins ------------------------------------------------------------------------------------
@query("SELECT c_custkey, c_name, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def m2o_join_guard(spark, d):
    fact = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    dimension = table(spark, d, "nation")
    clean.no_overlap(fact, dimension, ["n_nationkey"])
    return joins.many_to_one(fact, dimension, ["n_nationkey"]).select("c_custkey", "c_name", "n_name", "n_regionkey")


@query("SELECT o_orderkey, a.mean, a.n FROM orders JOIN (SELECT o_custkey, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY o_custkey) a USING (o_custkey)")
def group_broadcast(spark, d):
    o = table(spark, d, "orders")
    means = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n"))
    return joins.lookup(o, means, ["o_custkey"], ["mean", "n"]).select("o_orderkey", "mean", "n")


@query(f"{_PAIRS} SELECT c.k, count(p) AS n FROM c LEFT JOIN pairs ON pairs.k = c.k AND km <= 8 AND qa = pa GROUP BY c.k")
def radius_count(spark, d):
    c = places(spark, d)
    found = pyramid.range_counts(c, c, "k", 8.0, ["attr"])
    return found.select("k", F.greatest(F.col("n") - 1, F.lit(0)).alias("n"))  # not the customer itself


@query(f"{_PAIRS}, a AS (SELECT k, count(*) AS n, quantile_cont(pv, [0.25, 0.5, 0.75]) AS q FROM pairs WHERE km <= 8 AND qa = pa GROUP BY k HAVING count(*) >= 3) SELECT c.k, q[1] AS p25, q[2] AS p50, q[3] AS p75, q[3] - q[1] AS iqr FROM c LEFT JOIN a ON a.k = c.k")
def radius_percentiles(spark, d):
    return _radius_percentiles(spark, d, 8.0)


@query(f"{_PAIRS.replace('c_nationkey AS nation', 'c_nationkey AS nation')}, n AS (SELECT x.k, count(y.k) AS n FROM c x LEFT JOIN c y ON x.attr = y.attr AND x.nation <> y.nation AND {_KM.format(a='x.', b='y.')} <= 25 GROUP BY x.k) SELECT k, n FROM n")
def range_count_rivals(spark, d):
    """Customers of the same segment and another nation within 25 km, counted in blocks of cells."""
    c = places(spark, d)
    return pyramid.range_counts(c, c, "k", 25.0, ["attr"], exclude="nation")


def _radius_percentiles(spark, d, km):
    c = places(spark, d)
    g = circles.percentiles(c, c, "k", "value", km, [0.25, 0.5, 0.75], ["attr"]).where("n >= 3").hint("merge")
    return c.select("k").join(g, "k", "left").select("k", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _radius_percentiles(spark, sf_dir, 40.0)


@query(f"{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(km, 6), p) AS i FROM pairs) SELECT k, avg(pv) FILTER (WHERE i <= 3) AS mean_k3, stddev_pop(pv) FILTER (WHERE i <= 3) AS std_k3, avg(pv) AS mean_k5, stddev_pop(pv) AS std_k5 FROM r WHERE i <= 5 GROUP BY k")
def knn_stats(spark, d):
    c = places(spark, d)
    return joins.neighbour_stats(joins.nearest(c, c, 5, "k", exclude=("k", "k")), "k", "value", [3, 5])


@query(f"{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(km, 6), p) AS i FROM pairs), t AS (SELECT *, qa = pa AS s, pv BETWEEN qv * 0.8::DOUBLE AND qv * 1.2::DOUBLE AS b FROM r WHERE i <= 40), n AS (SELECT *, count(*) FILTER (WHERE s AND b) OVER w AS n1, count(*) FILTER (WHERE s) OVER w AS n2, count(*) FILTER (WHERE b) OVER w AS n3 FROM t WINDOW w AS (PARTITION BY k)), z AS (SELECT *, CASE WHEN n1 >= 4 THEN 1 WHEN n2 >= 4 THEN 2 WHEN n3 >= 4 THEN 3 ELSE 4 END AS tier FROM n), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS j FROM z WHERE CASE tier WHEN 1 THEN s AND b WHEN 2 THEN s WHEN 3 THEN b ELSE true END) SELECT k, median(pv) AS comparable, min(tier)::INT AS tier, count(*) AS n_used FROM f WHERE j <= 4 GROUP BY k")
def comparables_cascade(spark, d):
    c = places(spark, d)
    return joins.comparables(joins.nearest(c, c, 40, "k", exclude=("k", "k")), "k", "value", "attr", "value", 0.2, 4)


@query("""WITH t AS (SELECT o_orderkey, o_totalprice AS y, o_orderpriority AS a, o_orderstatus AS b, (o_custkey % 50)::VARCHAR AS c FROM orders), l3 AS (SELECT a, b, c, avg(y) AS v FROM t GROUP BY ALL HAVING count(*) >= 5), l2 AS (SELECT a, b, avg(y) AS v FROM t GROUP BY ALL HAVING count(*) >= 5), l1 AS (SELECT a, avg(y) AS v FROM t GROUP BY ALL HAVING count(*) >= 5) SELECT o_orderkey, coalesce(l3.v, l2.v, l1.v, (SELECT avg(y) FROM t)) AS fallback, CASE WHEN l3.v IS NOT NULL THEN 3 WHEN l2.v IS NOT NULL THEN 2 WHEN l1.v IS NOT NULL THEN 1 ELSE 0 END AS depth FROM t LEFT JOIN l3 USING (a, b, c) LEFT JOIN l2 USING (a, b) LEFT JOIN l1 USING (a)""")
def hier_fallback(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"), (F.col("o_custkey") % 50).alias("c"))
    return stats.fallback(t, ["a", "b", "c"], "y", 5).select("o_orderkey", "fallback", "depth")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 10 = 0), p AS (SELECT * FROM embeddings WHERE vec_id % 10 <> 0), r AS (SELECT q.vec_id, p.label::DOUBLE AS y, round(sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))), 9) AS d, p.vec_id AS pid FROM q CROSS JOIN p), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, pid) AS i FROM r) SELECT vec_id, coalesce(avg(y) FILTER (WHERE d = 0), sum(y / d) FILTER (WHERE d > 0) / sum(1 / d) FILTER (WHERE d > 0)) AS predicted FROM k WHERE i <= 5 GROUP BY vec_id""")
def feature_knn_regression(spark, d):
    e = table(spark, d, "embeddings")
    return joins.feature_knn(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), "vec_id", "embedding", "label", 5)


# --- E, F, G: aggregates, windows, top-k ---------------------------------------------------------
@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_quantity) AS n_sizes, count(DISTINCT l_returnflag) AS n_kinds, min(l_quantity) AS size_min, max(l_quantity) AS size_max, median(l_quantity) AS size_median, arg_min(l_returnflag, l_linenumber * 1000000.0::DOUBLE + l_extendedprice) AS first_kind FROM lineitem GROUP BY l_orderkey), s AS (SELECT *, (size_max - size_min) / nullif(size_median, 0) AS spread FROM g) SELECT *, (n >= 3)::INT + (n_sizes >= 2)::INT + (n_kinds >= 2)::INT + coalesce(spread > 0.5, false)::INT AS score, ((n >= 3) AND (n_sizes >= 2) AND (n_kinds >= 2) AND coalesce(spread > 0.5, false))::INT AS is_mixed FROM s""")
def group_typology(spark, d):
    items = table(spark, d, "lineitem").withColumn("row", F.col("l_linenumber") * F.lit(1000000.0) + F.col("l_extendedprice"))
    return stats.structure(items, "l_orderkey", "l_quantity", "l_returnflag", "row")


@query("""WITH e AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT o_orderpriority, avg(v) AS o_totalprice_mean, median(v) AS o_totalprice_median, stddev_samp(v) AS o_totalprice_std, count(v) AS o_totalprice_count FROM e GROUP BY ALL""")
def geo_stats(spark, d):
    return stats.level_stats(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["o_totalprice"])


@query("""WITH g AS (SELECT avg(o_totalprice) AS g FROM orders) SELECT o_custkey, (sum(o_totalprice) + 10 * any_value(g)) / (count(*) + 10) AS encoded, count(*) AS n FROM orders, g GROUP BY o_custkey""")
def smoothed_encode(spark, d):
    return stats.smoothed_means(table(spark, d, "orders"), "o_custkey", "o_totalprice", 10.0)


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice / (1 + o_orderkey % 9) AS u, o_orderkey % 9 + 1 AS size FROM orders), m AS (SELECT o_orderpriority, median(u) AS m FROM o WHERE o_orderpriority NOT LIKE '1%' GROUP BY ALL) SELECT o_orderkey, coalesce(m, (SELECT median(u) FROM o WHERE o_orderpriority NOT LIKE '1%')) * size AS unit_value FROM o LEFT JOIN m USING (o_orderpriority)""")
def group_unit_price(spark, d):
    o = table(spark, d, "orders").withColumn("size", F.col("o_orderkey") % 9 + 1)
    return stats.unit_value(o, "o_orderpriority", "o_totalprice", "size", ~F.col("o_orderpriority").startswith("1")).select("o_orderkey", "unit_value")


@query("""WITH p AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS m, min(o_totalprice) AS v FROM orders GROUP BY ALL), w AS (SELECT o_custkey, min(v) FILTER (WHERE m = DATE '1997-12-01') AS lag_1, min(v) FILTER (WHERE m = DATE '1997-11-01') AS lag_2, min(v) FILTER (WHERE m = DATE '1996-12-01') AS lag_13 FROM p WHERE m IN (DATE '1997-12-01', DATE '1997-11-01', DATE '1996-12-01') GROUP BY o_custkey) SELECT *, CASE WHEN lag_13 > 0 THEN lag_1 / lag_13 - 1 END AS yoy FROM w""")
def lag_pivot_yoy(spark, d):
    panel = table(spark, d, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("m")).agg(F.min("o_totalprice").alias("v"))
    w = stats.lag_pivot(panel, ["o_custkey"], "m", "v", "1998-01-01", [1, 2, 13])
    return w.withColumn("yoy", scalar.ratio(F.col("lag_1"), F.col("lag_13")) - 1)


@query("""WITH o AS (SELECT o_orderpriority, o_orderstatus, o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, sum(s) OVER w - s AS rs, sum(n) OVER w - n AS rn FROM o WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus)) SELECT o_orderpriority, o_orderstatus, o_custkey, CASE WHEN rn > 0 THEN (rs + 5 * (SELECT avg(o_totalprice) FROM orders)) / (rn + 5) END AS encoded, rn::BIGINT AS n_rest FROM r""")
def leave_group_out(spark, d):
    return stats.leave_group_out(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_custkey", "o_totalprice", 5.0)


_METRICS = "avg(abs(y - p)) AS mae, avg(abs(y - p) / greatest(abs(y), 1e-9)) AS mape, median(abs(y - p) / greatest(abs(y), 1e-9)) AS median_ape"


@query(f"{_PRICED} SELECT avg(abs(y - p)) AS mae, avg(abs(y - p) / greatest(abs(y), 1e-9)) AS mape, median(abs(y - p) / greatest(abs(y), 1e-9)) AS median_ape, sqrt(avg(pow(y - p, 2))) AS rmse, median(abs(y - p)) AS median_ae, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2 FROM (SELECT y, p_a AS p FROM t)")
def regression_metrics(spark, d):
    return stats.metrics(priced(spark, d), "y", "p_a").select("mae", "mape", "median_ape", "rmse", "median_ae", "r2")


@query(f"{_PRICED}, l AS (SELECT 'o_orderstatus' AS segment, o_orderstatus AS value, y, p_a AS p FROM t UNION ALL SELECT 'o_orderpriority', o_orderpriority, y, p_a FROM t) SELECT segment, value, count(*) AS n, avg(y) AS mean_actual, avg(abs(y - p)) AS mae, avg(abs(y - p) / y) AS mape, median(abs(y - p) / y) AS median_ape, avg(p - y) AS bias, sum(abs(y - p)) / sum(sum(abs(y - p))) OVER (PARTITION BY segment) AS error_share FROM l GROUP BY segment, value")
def segment_errors(spark, d):
    return stats.segment_errors(priced(spark, d), "y", "p_a", ["o_orderstatus", "o_orderpriority"])


@query("WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice <= q[1] THEN 'q1' WHEN o_totalprice <= q[2] THEN 'q2' WHEN o_totalprice <= q[3] THEN 'q3' ELSE 'q4' END AS class FROM orders, e")
def quantile_bins(spark, d):
    return stats.quantile_class(table(spark, d, "orders"), "o_totalprice", ["q1", "q2", "q3", "q4"]).select("o_orderkey", "class")


@query("WITH t AS (SELECT p_partkey, nullif(p_size, 7)::DOUBLE AS s FROM part), f AS (SELECT p_partkey, coalesce(s, (SELECT median(s) FROM t)) AS s FROM t) SELECT p_partkey, least(greatest((s - avg(s) OVER ()) / stddev_pop(s) OVER (), -8), 8) AS s FROM f")
def impute_standardise(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).cast("double").alias("s"))
    return stats.standardised(t, ["s"])


@query(f"{_PRICED}, l AS (SELECT 'p_a' AS model, y, p_a AS p FROM t UNION ALL SELECT 'p_b', y, p_b FROM t) SELECT model, {_METRICS}, avg(p - y) AS bias FROM l GROUP BY model")
def model_compare(spark, d):
    return stats.compare_models(priced(spark, d), "y", ["p_a", "p_b"]).select("model", "mae", "mape", "median_ape", "bias")


@query("SELECT 'o_orderstatus' AS \"column\", count(*) AS n_rows, count(DISTINCT nullif(o_orderstatus, 'P')) AS n_distinct, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_null FROM orders UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), 0 FROM orders")
def table_profile(spark, d):
    return stats.profile(table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))), ["o_orderstatus", "o_custkey"])


@query("WITH t AS (SELECT o_orderkey, o_totalprice AS v, avg(o_totalprice) OVER w AS g_mean, stddev_samp(o_totalprice) OVER w AS g_std, min(o_totalprice) OVER w AS g_min, max(o_totalprice) OVER w AS g_max, median(o_totalprice) OVER w AS g_median FROM orders WINDOW w AS (PARTITION BY o_custkey)) SELECT o_orderkey, g_mean, g_std, g_min, g_max, g_median, coalesce(CASE WHEN g_std > 1e-9 THEN (v - g_mean) / g_std END, 0) AS z FROM t")
def within_group_z(spark, d):
    return stats.z_scores(table(spark, d, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", "g_mean", "g_std", "g_min", "g_max", "g_median", "z")


@query("WITH t AS (SELECT p_partkey, p_brand, nullif(p_size, 7) AS s FROM part) SELECT p_partkey, CASE WHEN s IS NULL THEN 0.5::DOUBLE ELSE (rank() OVER (PARTITION BY p_brand ORDER BY s NULLS LAST) + (count(*) OVER (PARTITION BY p_brand, s) - 1) / 2.0::DOUBLE) / count(s) OVER (PARTITION BY p_brand) END AS pct FROM t")
def percent_rank_avg(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_brand", F.nullif("p_size", F.lit(7)).alias("s"))
    return t.select("p_partkey", stats.average_rank(["p_brand"], "s").alias("pct"))


@query("WITH t AS (SELECT p_partkey, p_size::DOUBLE AS v, sum(p_size) OVER w AS s, max(p_size) OVER w AS hi, min(p_size) OVER w AS lo FROM part WINDOW w AS (PARTITION BY p_brand)) SELECT p_partkey, ln(1 + v) AS log_value, v / s AS share, v / hi AS of_max, (v >= hi)::INT AS is_max, (v <= lo)::INT AS is_min FROM t")
def dominant_share(spark, d):
    t = table(spark, d, "part").withColumn("v", F.col("p_size").cast("double"))
    return stats.dominance(t, "p_brand", "v").select("p_partkey", "log_value", "share", "of_max", "is_max", "is_min")


@query(f"{_PRICED} SELECT o_orderkey, y, p_a, abs(y - p_a) AS abs_err FROM t ORDER BY abs_err DESC, o_orderkey LIMIT 40")
def top_residuals(spark, d):
    return stats.worst(priced(spark, d), "y", "p_a", "o_orderkey", 40).select("o_orderkey", "y", "p_a", "abs_err")


@query("SELECT l_returnflag, l_linestatus, l_shipmode_ AS mode, min(l_orderkey) AS first_order, arg_min(l_quantity, l_orderkey * 100 + l_linenumber * 1.0 + l_quantity / 1000) AS quantity FROM (SELECT *, l_linenumber AS l_shipmode_ FROM lineitem) GROUP BY ALL")
def dedup_keep_first(spark, d):
    t = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("mode"), F.col("l_orderkey").alias("first_order"), F.col("l_quantity").alias("quantity"))
    order = F.col("first_order") * 100 + F.col("mode") * 1.0 + F.col("quantity") / 1000
    return stats.first_per_key(t.withColumn("o", order), ["l_returnflag", "l_linestatus", "mode"], "o").drop("o")


# --- I: folds, stacking --------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey, ((o_custkey * 2654435761) % 4294967296 // 65536 % 5)::INT AS fold FROM orders")
def group_folds(spark, d):
    return stats.group_folds(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5)


@query("WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL), i AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS i FROM s), f AS (SELECT o_custkey, n, CASE WHEN i % 10 < 5 THEN i % 10 ELSE 9 - i % 10 END AS fold FROM i) SELECT fold::INT AS fold, count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM f GROUP BY fold")
def balanced_fold_sizes(spark, d):
    o = stats.balanced_folds(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5)
    return o.groupBy("fold").agg(F.countDistinct("o_custkey").alias("n_groups"), F.count("*").alias("n_rows"))


@query("WITH o AS (SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS y, ((o_custkey * 2654435761) % 4294967296 // 65536 % 5)::INT AS fold FROM orders), f AS (SELECT fold, (SELECT sum(y) FROM o) - sum(y) AS s, (SELECT count(*) FROM o) - count(*) AS n FROM o GROUP BY fold), g AS (SELECT c, fold, sum(y) AS s, count(*) AS n FROM o GROUP BY ALL), r AS (SELECT c, fold, sum(s) OVER (PARTITION BY c) - s AS rs, sum(n) OVER (PARTITION BY c) - n AS rn FROM g) SELECT o_orderkey, o.fold, (rs + 10 * (f.s / f.n)) / (rn + 10) AS encoded FROM o JOIN r USING (c, fold) JOIN f ON f.fold = o.fold")
def leave_fold_out_encode(spark, d):
    o = stats.group_folds(table(spark, d, "orders"), "o_custkey", 5)
    return stats.leave_fold_out(o, "o_orderpriority", "o_totalprice", "fold", 10.0).select("o_orderkey", "fold", "encoded")


_FOLDED = _PLACES.replace(" FROM customer", ", ((c_custkey * 2654435761) % 4294967296 // 65536 % 4)::INT AS fold FROM customer")


@query(f"""WITH c AS ({_FOLDED}), f AS (SELECT a.fold, avg(value) AS prior FROM (SELECT DISTINCT fold FROM c) a JOIN c ON c.fold <> a.fold GROUP BY a.fold),
e AS (SELECT a.fold, attr, (sum(value) + 10 * any_value(prior)) / (count(*) + 10) AS encoded, median(value) AS median, count(*) AS n_rest FROM f a JOIN c ON c.fold <> a.fold GROUP BY a.fold, attr),
r AS (SELECT x.k, y.value, row_number() OVER (PARTITION BY x.k ORDER BY round({_KM.format(a='x.', b='y.')}, 6), y.k) AS i FROM c x JOIN c y ON x.fold <> y.fold), n AS (SELECT k, avg(value) AS near FROM r WHERE i <= 5 GROUP BY k)
SELECT k, c.fold, encoded, median, n_rest, near, encoded * nation AS encoded_by_nation, median * nation AS median_by_nation, near * nation AS near_by_nation FROM c JOIN e USING (fold, attr) JOIN n USING (k)""")
def fold_encodings(spark, d):
    """Mean, median and neighbours of each row over the other folds, and their products with an attribute."""
    rows = stats.group_folds(places(spark, d), "k", 4)
    names = ["encoded", "median", "near"]
    return encode.fold_encodings(rows, "k", "attr", "value", "nation", "fold", 10.0, 5).select("k", "fold", *names, "n_rest", *[f"{n}_by_nation" for n in names])


@query("WITH t AS (SELECT o_custkey, avg(o_totalprice) AS o_totalprice, arg_min(nullif(o_orderstatus, 'P'), CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END) AS o_orderstatus FROM orders GROUP BY o_custkey) SELECT * FROM t")
def entity_rows(spark, d):
    """One row per customer: mean price, and the status of the first order that has one."""
    o = table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return encode.one_per_entity(o, "o_custkey", ["o_totalprice"], ["o_orderstatus"], "o_orderkey")


@query("WITH t AS (SELECT o_custkey, nullif(o_orderstatus, 'P') AS a, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / (1 + o_orderkey % 3) END AS u FROM orders) SELECT o_custkey, a, count(u) AS n, arg_min(o_orderdate, o_orderkey) AS o_orderdate, median(u) AS u_median FROM t GROUP BY o_custkey, a")
def entity_attribute_pool(spark, d):
    """Median unit price and first date of each (customer, status), also where the status is null or no order has a price."""
    o = table(spark, d, "orders").select("o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("a"), "o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice") / (1 + F.col("o_orderkey") % 3)).alias("u"))
    return encode.attribute_pool(o, "o_custkey", "a", "u", ["o_orderdate"], "o_orderkey")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'O''Hare' WHEN 1 THEN 'None Such' WHEN 2 THEN 'True \"False\"' WHEN 3 THEN 'it''s \\ x' END AS name, (event_id % 5 = 1) AS flag FROM events")
def json_quotes(spark, d):
    """Apostrophes in either quotes, quotes in single quotes, backslashes, and names with None and True in them."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, """[{'name': "O'Hare", 'flag': False}]""").when(k == 1, "{'name': 'None Such', 'flag': True}").when(k == 2, """[{'name': 'True "False"', 'flag': False}]""")
    raw = raw.when(k == 3, r"[{'name': 'it\'s \\ x', 'flag': False}]").otherwise("{'name': None, 'flag': False}")
    item = clean.matching(clean.structs(raw, "name string, flag boolean"), "name", F.lit("none such"))
    return table(spark, d, "events").select("event_id", item["name"].alias("name"), item["flag"].alias("flag"))


@query("SELECT o_orderkey, CASE WHEN NOT (((o_orderkey + 3) * 2654435761 % 4294967296) // 65536 % 10000 < 3000) THEN o_totalprice END AS o_totalprice FROM orders")
def nullify_mask(spark, d):
    return stats.nullified(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "o_orderkey", 0.3, 3)


@query(f"{_PRICED} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN p_b ELSE p_a END AS routed FROM t")
def route_by_null(spark, d):
    t = priced(spark, d).withColumn("signal", F.when(F.col("o_orderkey") % 3 != 0, F.col("y")))
    return learn.routed(t, "signal", "p_a", "p_b").select("o_orderkey", "routed")


@query(f"{_PRICED}, r AS (SELECT rank() OVER (ORDER BY p_a - y) + (count(*) OVER (PARTITION BY p_a - y) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p_b - y) + (count(*) OVER (PARTITION BY p_b - y) - 1) / 2.0::DOUBLE AS b FROM t) SELECT corr(a, b) AS spearman, count(*) AS n FROM r")
def residual_correlation(spark, d):
    return stats.spearman(priced(spark, d).select((F.col("p_a") - F.col("y")).alias("a"), (F.col("p_b") - F.col("y")).alias("b")), "a", "b")


@query()
def stack_ridge(spark, d):
    """Two base learners over three group folds, their out-of-fold predictions, and a cross-fitted ridge on top."""
    o = table(spark, d, "orders")
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.count("*").alias("lines"))
    rows = stats.group_folds(o.join(items, "o_orderkey", "left").fillna(0.0, ["quantity", "price"]).fillna(0, ["lines"]), "o_custkey", 3)
    rows = rows.withColumn("label", scalar.log_target(F.col("o_totalprice")))
    data = learn.assembled(rows, ["quantity", "price", "lines"], ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", "fold", "label", "features")
    bases = {"forest": {"numTrees": 5, "maxDepth": 4}, "linear": {}}
    found = learn.wide(learn.out_of_fold(data, "label", "fold", 3, bases, "o_orderkey"), "o_orderkey", list(bases))
    stacked = learn.cross_fitted_ridge(data.select("o_orderkey", "fold", "label").join(found, "o_orderkey"), "label", ["pred_forest", "pred_linear"], "fold")
    return stacked.select("o_orderkey", "fold", "pred_forest", "pred_linear", "stacked")


# --- J: contracts --------------------------------------------------------------------------------
@query("SELECT 'bounds' AS kind, 'error' AS severity, 'o_totalprice' AS \"column\", count(*) AS n, 'outside [0, 200000]' AS message FROM orders WHERE o_totalprice < 0 OR o_totalprice > 200000 HAVING count(*) > 0 UNION ALL SELECT 'null', 'error', 'o_orderstatus', count(*), 'identity is null' FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0")
def contract_bounds(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return contract.value_issues(o, contract.Contract({}, {"o_totalprice": (0, 200000)}, identity=["o_orderstatus"]))


@query("SELECT coalesce(sum(n), 0)::BIGINT AS n_rows, count(*) AS n_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_keys(spark, d):
    return contract.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 0 OR o_totalprice > 200000 ORDER BY o_orderkey LIMIT 3")
def contract_offenders(spark, d):
    return contract.offenders(table(spark, d, "orders"), "o_totalprice", 0, 200000, "o_orderkey")


# --- A: sources and sinks ------------------------------------------------------------------------
@query("SELECT n_nationkey, n_name, NULL::DOUBLE AS feature FROM nation")
def source_fallback(spark, d):
    """The first path is absent, so the second is read; a feature table that is absent is empty and joins as nulls."""
    found = tables.first_readable(spark, [tables.new_path(spark, "absent"), f"{d}/nation.parquet"])
    features = tables.first_readable(spark, [tables.new_path(spark, "absent")], "n_nationkey int, feature double")
    return joins.lookup(found, features, ["n_nationkey"], ["feature"]).select("n_nationkey", "n_name", "feature")


@query("SELECT f AS format, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders, (VALUES ('csv'), ('json'), ('parquet')) v(f)")
def sink_round_trip(spark, d):
    """Orders through each sink and back with one schema."""
    o, parts = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), []
    for fmt in ("csv", "json", "parquet"):
        path = tables.new_path(spark, "sink") + f".{fmt}"
        tables.write(o, path, fmt)
        back = spark.read.schema(o.schema).json(path) if fmt == "json" else tables.read_batch(spark, path, o.schema)
        parts.append(back.select(F.lit(fmt).alias("format"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey, ((o_custkey * 2654435761) % 4294967296 // 65536 % 4)::INT AS fold, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS base FROM orders")
def resumed_parts(spark, d):
    """Half of the (fold, base) parts are written, the missing ones are found, written alone, and all are read back."""
    o = stats.group_folds(table(spark, d, "orders"), "o_custkey", 4).select("o_orderkey", "fold", F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("base"))
    path, schema = tables.new_path(spark, "parts"), "o_orderkey long, fold int, base string"
    tables.write_part(o.where("fold < 2"), path, "fold", "base")
    expected = o.select("fold", "base").distinct()
    lacking = tables.missing_parts(spark.read.schema(schema).parquet(path), expected)
    tables.write_part(o.join(F.broadcast(lacking), ["fold", "base"], "left_semi"), path, "fold", "base")
    return spark.read.schema(schema).parquet(path)


@query("SELECT s_suppkey, r_name AS name, r_regionkey::DOUBLE AS lat, r_regionkey * 2::DOUBLE AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def anchors_json(spark, d):
    """A JSON document of places, one for each region, written and joined to suppliers."""
    path = tables.new_path(spark, "anchors")
    place = F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").cast("double").alias("lat"), (F.col("r_regionkey") * F.lit(2.0)).alias("lon"))
    table(spark, d, "region").agg(F.to_json(F.collect_list(place)).alias("value")).write.text(path)
    anchors = tables.anchors_from_json(spark, path)
    nations = joins.lookup(table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region"), ["r_regionkey"], ["r_name"])
    s = joins.lookup(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), nations.withColumnRenamed("r_name", "name"), ["n_nationkey"], ["name"])
    return joins.lookup(s, anchors, ["name"], ["lat", "lon"]).select("s_suppkey", "name", "lat", "lon")


# --- B: projections ------------------------------------------------------------------------------
@query("SELECT p_partkey, p_size, p_retailprice, p_brand, NULL::DOUBLE AS p_area FROM part")
def feature_projection(spark, d):
    """Named groups of columns, each once, those that exist, without identifiers; an input that is absent becomes nulls."""
    p = clean.with_missing(table(spark, d, "part"), ["p_area"])
    groups = {"size": ["p_size", "p_partkey", "p_none"], "price": ["p_retailprice", "p_size"], "kind": ["p_brand"], "area": ["p_area"]}
    chosen = clean.feature_columns(groups, ["size", "price", "kind", "area"], p.columns, ["p_partkey"])
    numeric, other = clean.split_kinds(p, chosen)
    return clean.renamed(p.select("p_partkey", *numeric, *other, "p_type"), {}, drop=["p_type"])


@query("SELECT p_partkey, p_size * 2 AS a, p_size * 2 + 1 AS b FROM part")
def composed_steps(spark, d):
    """Two steps, the second using the first's column, and a guard that keeps a second run from doubling again."""
    def double(df):
        return clean.once(df, ["a"], lambda x: x.withColumn("a", F.col("p_size") * 2 if "a" not in x.columns else F.col("a") * 2))

    return clean.composed(table(spark, d, "part"), double, double, lambda x: x.withColumn("b", F.col("a") + 1)).select("p_partkey", "a", "b")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN NULL WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE NULL END::INTEGER AS n, CASE event_id % 6 WHEN 3 THEN (event_id % 7)::INTEGER WHEN 4 THEN (event_id % 7)::INTEGER END AS size FROM events")
def json_junk(spark, d):
    """Nested lists in their spellings: broken text, an empty list, a word, one quoted object, a list with a null name, null."""
    k, size = F.col("event_id") % 6, (F.col("event_id") % 7).cast("string")
    raw = F.when(k == 0, "{junk").when(k == 1, "[]").when(k == 2, "none").when(k == 3, F.concat(F.lit("{'name': None, 'size': "), size, F.lit("}"))).when(k == 4, F.concat(F.lit("[{'name': 'a', 'size': "), size, F.lit('}, null, {"name": "b"}]')))
    raw = F.when(k == 4, F.translate(raw, '"', "'")).otherwise(raw)
    items = clean.structs(raw, "name string, size int")
    return table(spark, d, "events").select("event_id", F.when(items.isNotNull(), F.size(items)).alias("n"), F.get(items, F.lit(0))["size"].alias("size"))


# --- D to G: lookups, nested means, reports ------------------------------------------------------
@query("WITH l AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS mean FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL) SELECT o_orderkey, coalesce(mean, -1) AS mean FROM orders LEFT JOIN l USING (o_custkey, o_orderstatus)")
def two_key_lookup(spark, d):
    o = table(spark, d, "orders")
    means = o.where("o_orderkey % 3 = 0").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("mean"))
    return joins.lookup(o, means, ["o_custkey", "o_orderstatus"], ["mean"], -1.0).select("o_orderkey", "mean")


@query(f"{_PRICED}, j AS (SELECT coalesce(c_mktsegment, 'missing') AS value, y, p_a AS p FROM t LEFT JOIN customer ON o_custkey = c_custkey) SELECT value, count(*) AS n, avg(abs(y - p)) AS mae, median(abs(y - p) / y) AS median_ape FROM j GROUP BY value ORDER BY mae DESC, value LIMIT 3")
def worst_segments(spark, d):
    """Predictions with their customers' attributes; the three segments of the greatest error."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = joins.lookup(priced(spark, d), c, ["o_custkey"], ["c_mktsegment"])
    return stats.top(stats.segment_errors(joined, "y", "p_a", ["c_mktsegment"]), "mae", "value", 3).select("value", "n", "mae", "median_ape")


@query("WITH s AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0), g AS (SELECT avg(o_totalprice) AS g FROM s), e AS (SELECT o_custkey, (sum(o_totalprice) + 10 * any_value(g)) / (count(*) + 10) AS encoded FROM s, g GROUP BY o_custkey) SELECT o_orderkey, coalesce(encoded, 0) AS encoded FROM orders LEFT JOIN e USING (o_custkey) WHERE o_orderkey % 5 = 0")
def frozen_lookup(spark, d):
    """An encoding fitted on some rows is stored, read again and joined to rows to score."""
    o, path = table(spark, d, "orders"), tables.new_path(spark, "frozen")
    tables.write(stats.smoothed_means(o.where("o_orderkey % 5 <> 0"), "o_custkey", "o_totalprice", 10.0), path)
    frozen = tables.read_batch(spark, path)
    return joins.lookup(o.where("o_orderkey % 5 = 0"), frozen, ["o_custkey"], ["encoded"], 0.0).select("o_orderkey", "encoded")


@query("""WITH t AS (SELECT o_orderkey, o_totalprice AS y, o_orderpriority AS a, o_orderstatus AS b, o_custkey % 50 AS c, o_custkey AS f, avg(o_totalprice) OVER () AS g FROM orders) SELECT o_orderkey, """ + ", ".join(f"(sum(y) OVER w{i} + 8 * g) / (count(*) OVER w{i} + 8) AS mean_{i}, count(*) OVER w{i} AS n_{i}" for i in range(1, 5)) + " FROM t WINDOW w1 AS (PARTITION BY a), w2 AS (PARTITION BY a, b), w3 AS (PARTITION BY a, b, c), w4 AS (PARTITION BY a, b, c, f)")
def nested_smoothed(spark, d):
    t = table(spark, d, "orders").withColumn("c", F.col("o_custkey") % 50)
    return stats.nested_means(t, ["o_orderpriority", "o_orderstatus", "c", "o_custkey"], "o_totalprice", 8.0).select("o_orderkey", *[f"{m}_{i}" for i in range(1, 5) for m in ("mean", "n")])


@query("WITH e AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY ALL), s AS (SELECT o_orderpriority, avg(v) AS m, stddev_samp(v) AS s FROM e GROUP BY ALL) SELECT o_orderkey, (o_totalprice - m) / s AS z FROM orders JOIN s USING (o_orderpriority)")
def level_deviation(spark, d):
    o = table(spark, d, "orders")
    levels = stats.level_stats(o, "o_custkey", "o_orderpriority", ["o_totalprice"])
    return stats.deviations(o, levels, "o_orderpriority", ["o_totalprice"]).select("o_orderkey", F.col("o_totalprice_z").alias("z"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_totalprice > 400000) AS n_null, avg(v) AS mean, median(v) AS median, min(v) AS least, max(v) AS greatest FROM (SELECT o_totalprice, CASE WHEN o_totalprice <= 400000 THEN o_totalprice END AS v FROM orders)")
def target_profile(spark, d):
    return stats.target_profile(table(spark, d, "orders").withColumn("v", F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice"))), "v")


@query("SELECT nullif(o_orderstatus, 'P') AS value, count(*) AS n, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS share FROM orders GROUP BY ALL")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P"))), "s")


# --- I: out-of-fold predictions with closed forms ------------------------------------------------
_ITEMS = "WITH t AS (SELECT o_orderkey, ((any_value(o_custkey) * 2654435761) % 4294967296 // 65536 % 3)::INT AS fold, sum(l_extendedprice) AS y, sum(l_quantity)::DOUBLE AS x1, count(*)::DOUBLE AS x2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey), f AS (SELECT a.fold, regr_slope(y, x1) AS s1, regr_intercept(y, x1) AS i1, regr_slope(y, x2) AS s2, regr_intercept(y, x2) AS i2 FROM (VALUES (0), (1), (2)) a(fold) JOIN t ON t.fold <> a.fold GROUP BY a.fold), p AS (SELECT o_orderkey, fold, y, i1 + s1 * x1 AS p1, i2 + s2 * x2 AS p2 FROM t JOIN f USING (fold))"
_BASES = {"p1": {"learner": "linear", "features": ["x1"], "regParam": 0.0}, "p2": {"learner": "linear", "features": ["x2"], "regParam": 0.0}}


def _items(spark, d):
    lines = table(spark, d, "lineitem")
    n = lines.count()
    sums = ranges.dealt(lines, n, "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("y"), F.sum("l_quantity").alias("x1"), F.count("*").alias("x2"))
    o = ranges.dealt(table(spark, d, "orders"), n, "o_orderkey").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    g = o.groupBy("o_orderkey", "o_custkey").agg(F.sum("y").alias("y"), F.sum("x1").cast("double").alias("x1"), F.sum("x2").cast("double").alias("x2"))
    return stats.group_folds(g, "o_custkey", 3)


def _base_predictions(spark, d):
    t = ranges.cut(_items(spark, d))
    return t, learn.out_of_fold(t, "y", "fold", 3, _BASES, "o_orderkey")


def _with_bases(spark, d):
    t, found = _base_predictions(spark, d)
    return ranges.dealt(t, found.count(), "o_orderkey").join(learn.wide(found, "o_orderkey", list(_BASES)).withColumnsRenamed({"pred_p1": "p1", "pred_p2": "p2"}), "o_orderkey")


@query(f"{_ITEMS} SELECT o_orderkey, fold, 'p1' AS base, p1 AS prediction FROM p UNION ALL SELECT o_orderkey, fold, 'p2', p2 FROM p")
def out_of_fold_linear(spark, d):
    return _base_predictions(spark, d)[1]


@query(f"{_ITEMS}, l AS (SELECT fold, 'p1' AS base, y, p1 AS p FROM p UNION ALL SELECT fold, 'p2', y, p2 FROM p) SELECT fold, base, count(*) AS n, {_METRICS}, sqrt(avg(pow(y - p, 2))) AS rmse FROM l GROUP BY ALL")
def fold_metrics(spark, d):
    t, found = _base_predictions(spark, d)
    return learn.fold_metrics(found, t, "y", "fold", "o_orderkey").select("fold", "base", "n", "mae", "mape", "median_ape", "rmse")


@query(f"{_ITEMS}, m AS (SELECT a.fold, avg(y) AS ym, avg(p1) AS m1, avg(p2) AS m2, count(*) * var_pop(p1) + 1 AS c11, count(*) * var_pop(p2) + 1 AS c22, count(*) * covar_pop(p1, p2) AS c12, count(*) * covar_pop(p1, y) AS b1, count(*) * covar_pop(p2, y) AS b2 FROM (VALUES (0), (1), (2)) a(fold) JOIN p ON p.fold <> a.fold GROUP BY a.fold), w AS (SELECT fold, ym, m1, m2, (c22 * b1 - c12 * b2) / (c11 * c22 - c12 * c12) AS w1, (c11 * b2 - c12 * b1) / (c11 * c22 - c12 * c12) AS w2 FROM m) SELECT o_orderkey, fold, ym + w1 * (p1 - m1) + w2 * (p2 - m2) AS stacked FROM p JOIN w USING (fold)")
def stack_closed_form(spark, d):
    return learn.cross_fitted_ridge(_with_bases(spark, d), "y", ["p1", "p2"], "fold", 1.0).select("o_orderkey", "fold", "stacked")


@query(f"{_ITEMS}, m AS (SELECT a.fold, sum(p1 * p1) AS a11, sum(p2 * p2) AS a22, sum(p1 * p2) AS a12, sum(p1 * y) AS b1, sum(p2 * y) AS b2 FROM (VALUES (0), (1), (2)) a(fold) JOIN p ON p.fold <> a.fold GROUP BY a.fold), u AS (SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS u1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS u2 FROM m), w AS (SELECT fold, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN u1 < 0 THEN 0 ELSE b1 / a11 END AS w1, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN u1 < 0 THEN b2 / a22 ELSE 0 END AS w2 FROM u) SELECT o_orderkey, fold, w1 * p1 + w2 * p2 AS stacked FROM p JOIN w USING (fold)")
def stack_nonnegative(spark, d):
    t = ranges.cut(_with_bases(spark, d))
    return learn.weighted(t, ["p1", "p2"], "fold", learn.cross_fitted(t, "y", ["p1", "p2"], "fold", nonnegative=True)).select("o_orderkey", "fold", "stacked")


@query(f"{_PRICED}, l AS (SELECT 'with' AS mode, y, p_a AS p FROM t UNION ALL SELECT 'without', y, p_b FROM t) SELECT mode, count(*) AS n, {_METRICS} FROM l GROUP BY mode")
def two_way_evaluation(spark, d):
    return learn.by_mode(priced(spark, d), "y", {"with": "p_a", "without": "p_b"}).select("mode", "n", "mae", "mape", "median_ape")


def _ridge_of(x):
    return f"SELECT a.fold, avg(y) - covar_pop({x}, y) * count(*) / (var_pop({x}) * count(*) + 1) * avg({x}) AS i, covar_pop({x}, y) * count(*) / (var_pop({x}) * count(*) + 1) AS s FROM (VALUES (0), (1), (2)) a(fold) JOIN t ON t.fold <> a.fold GROUP BY a.fold"


_BOTH = "SELECT a.fold, avg(y) AS ym, avg(x1) AS m1, avg(x2) AS m2, count(*) * var_pop(x1) + 1 AS c11, count(*) * var_pop(x2) + 1 AS c22, count(*) * covar_pop(x1, x2) AS c12, count(*) * covar_pop(x1, y) AS b1, count(*) * covar_pop(x2, y) AS b2 FROM (VALUES (0), (1), (2)) a(fold) JOIN t ON t.fold <> a.fold GROUP BY a.fold"


@query(f"{_ITEMS}, r0 AS ({_BOTH}), r1 AS ({_ridge_of('x1')}), r2 AS ({_ridge_of('x2')}), l AS (SELECT 'none' AS dropped, y, ym + (c22 * b1 - c12 * b2) / (c11 * c22 - c12 * c12) * (x1 - m1) + (c11 * b2 - c12 * b1) / (c11 * c22 - c12 * c12) * (x2 - m2) AS p FROM t JOIN r0 USING (fold) UNION ALL SELECT 'lines', y, i + s * x1 AS p FROM t JOIN r1 USING (fold) UNION ALL SELECT 'quantity', y, i + s * x2 FROM t JOIN r2 USING (fold)) SELECT dropped, count(*) AS n, {_METRICS} FROM l GROUP BY dropped")
def ablation(spark, d):
    """Errors of ridge with all inputs and without each."""
    return learn.ablation(_items(spark, d), "y", ["x1", "x2"], "fold", {"lines": ["x2"], "quantity": ["x1"]}).select("dropped", "n", "mae", "mape", "median_ape")


@query("""WITH a AS (SELECT p_partkey, p_partkey % 10 = 0 AS q, nullif(p_size, 7)::DOUBLE AS s, p_retailprice AS r, p_size + p_retailprice AS y FROM part), m AS (SELECT median(s) AS ms, median(r) AS mr FROM a WHERE NOT q), b AS (SELECT p_partkey, q, coalesce(s, ms) AS s, r, y FROM a, m), z AS (SELECT avg(s) AS sa, stddev_pop(s) AS sd, avg(r) AS ra, stddev_pop(r) AS rd FROM b WHERE NOT q), c AS (SELECT p_partkey, q, greatest(least((s - sa) / sd, 8), -8) AS s, greatest(least((r - ra) / rd, 8), -8) AS r, y FROM b, z), d AS (SELECT x.p_partkey, o.p_partkey AS pid, o.y, round(sqrt(pow(x.s - o.s, 2) + pow(x.r - o.r, 2)), 9) AS d FROM c x JOIN c o ON x.q AND NOT o.q), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, pid) AS i FROM d) SELECT p_partkey, coalesce(avg(y) FILTER (WHERE d = 0), sum(y / d) FILTER (WHERE d > 0) / sum(1 / d) FILTER (WHERE d > 0)) AS predicted FROM k WHERE i <= 5 GROUP BY p_partkey""")
def knn_base(spark, d):
    """Feature-space neighbours as a base learner: a stated tenth of the parts is predicted from all others."""
    p = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).cast("double").alias("s"), F.col("p_retailprice").alias("r"), (F.col("p_size") + F.col("p_retailprice")).alias("y"))
    return learn.knn_fold(p.where("p_partkey % 10 <> 0"), p.where("p_partkey % 10 = 0"), "p_partkey", ["s", "r"], "y", 5)


@query("WITH t AS (SELECT p_partkey, nullif(p_brand, 'Brand#11') AS b FROM part), c AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS code FROM (SELECT DISTINCT b FROM t WHERE b IS NOT NULL)) SELECT p_partkey, coalesce(code, (SELECT count(*) FROM c)) AS code FROM t LEFT JOIN c USING (b)")
def dictionary_codes(spark, d):
    p = table(spark, d, "part").withColumn("b", F.nullif("p_brand", F.lit("Brand#11")))
    return learn.encoded(p, "b", learn.dictionary(p, "b"), "code").select("p_partkey", "code")


@query("SELECT 'bounds' AS kind, 'error' AS severity, 'o_totalprice' AS \"column\", count(*) AS n, 'outside [0, 200000]' AS message FROM orders WHERE o_totalprice < 0 OR o_totalprice > 200000 HAVING count(*) > 0 UNION ALL SELECT 'null', 'error', 'o_orderstatus', count(*), 'identity is null' FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0 UNION ALL SELECT 'invariant', 'error', 'dear_or_open', count(*), 'rows break it' FROM orders WHERE NOT (o_totalprice > 1000 OR o_orderstatus = 'O') HAVING count(*) > 0 UNION ALL SELECT 'extra', 'warning', 'o_custkey', 1, 'column is not in the contract'")
def checked_write(spark, d):
    """Orders are written once; bounds, nulls and an invariant are counted by the same job, after a contract built from groups."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice")
    groups = {"price": ["o_totalprice", "o_orderkey"], "kind": ["o_orderstatus", "o_totalprice"]}
    spec = contract.from_groups(groups, {"price": "numeric", "kind": "string"}, bounds={"o_totalprice": (0, 200000)}, identity=["o_orderstatus"])
    return contract.write_checked(o, spec, tables.new_path(spark, "checked"), {"dear_or_open": (F.col("o_totalprice") > 1000) | F.coalesce(F.col("o_orderstatus") == "O", F.lit(False))})


@query()
def boosted_importance(spark, d):
    """Importances of boosted trees with early stopping, averaged over folds, greatest first."""
    t = _items(spark, d)
    names = ["x1", "x2"]
    data = learn.assembled(t, names).withColumn("__stop", F.col("o_orderkey") % 8 == 0)
    rows = [(f, n, g) for f in range(3) for n, g in learn.importances(learn.trainer("boosted", {"maxIter": 5, "labelCol": "y", "validationIndicatorCol": "__stop"}, fold=f).fit(data.where(F.col("fold") != f)), names)]
    return stats.importance(spark.createDataFrame(rows, "fold int, feature string, gain double"), 3).orderBy(F.desc("gain"), "feature")


@query("SELECT * FROM (VALUES ('missing', 'error', 'gone', 1::BIGINT), ('type', 'error', 'o_orderstatus', 1), ('extra', 'error', 'o_orderdate', 1)) v(kind, severity, \"column\", n) UNION ALL SELECT 'bounds', 'error', 'o_totalprice', count(*) FROM orders WHERE o_totalprice > 200000 HAVING count(*) > 0 UNION ALL SELECT 'null', 'error', 'o_orderpriority', count(*) FROM orders WHERE o_orderpriority LIKE '1%' HAVING count(*) > 0 UNION ALL SELECT 'duplicate', 'error', 'o_custkey,o_orderstatus', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1) HAVING count(*) > 0")
def contract_report(spark, d):
    """A strict contract that the table breaks in every way: a missing, an extra and a wrongly typed column, bounds, nulls, repeated keys."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("o_orderpriority"), "o_totalprice", "o_orderdate")
    spec = contract.Contract({"values": ("numeric", ["o_totalprice", "o_orderstatus", "gone"]), "names": ("string", ["o_orderpriority"])}, {"o_totalprice": (0, 200000)}, ["o_custkey", "o_orderstatus"], ["o_orderpriority"], strict=True)
    return contract.validate(o, spec).drop("message")
