"""Mixing sources to target weights (10): iterative proportional fitting, then sampling by calibrated rates, with repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import WORD_PATTERN, stored, unit_hash

DIMENSIONS = ("source", "lang", "topic")
REST, NONE = "(rest)", "(none)"
#: So many cells are raked on the driver and broadcast; where there are more, Spark rakes them. It bears on speed, not on results.
COLLECTED = 50_000


def form_topic(text):
    """A topic from the text's form, for tables without one: table, marked, shouted, listed, prose or empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.regexp_count(t, F.lit("\n")) + 1
    return (
        F.when(F.length(t) == 0, "empty")
        .when(t.contains(" | "), "table")
        .when(F.regexp_count(t, F.lit(r"[#*$%&<>]")) * 20 > F.length(t), "marked")
        .when((F.upper(t) == t) & (F.lower(t) != t), "shouted")
        .when(F.length(t) < 80 * lines, "listed")
        .otherwise("prose")
    )


def _rows(docs: DataFrame) -> DataFrame:
    topic = F.col("topic").cast("string") if "topic" in docs.columns else form_topic(F.col("text"))
    named = {"__source": F.col("source").cast("string"), "__lang": F.col("lang").cast("string"), "__topic": topic}
    named = {k: F.coalesce(v, F.lit(NONE)) for k, v in named.items()}
    return docs.withColumns({**named, "__tokens": F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")})


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], rounds: int = 500, tolerance: float = 1e-10) -> dict[tuple, float]:
    """Iterative proportional fitting: scales the cells' weights to each dimension's target shares in turn.

    Targets are taken relative to the values that the cells have; a value without a target keeps its
    share. It ends when no share is off by more than ``tolerance``, or after ``rounds``.
    """
    names = sorted(cells)
    w = np.array([cells[k] for k in names], float)
    if not len(w) or w.sum() <= 0:
        return dict.fromkeys(names, 0.0)
    w /= w.sum()
    sides = []
    for d, target in enumerate(targets):
        values = sorted({k[d] for k in names})
        place = {v: i for i, v in enumerate(values)}
        at = np.array([place[k[d]] for k in names])
        share = np.bincount(at, w, len(values))
        wanted = np.array([target.get(v, s) for v, s in zip(values, share, strict=True)]) * (share > 0)
        sides.append((at, wanted / wanted.sum() if wanted.sum() > 0 else share))
    for _ in range(rounds):
        for at, wanted in sides:
            share = np.bincount(at, w, len(wanted))
            w *= np.divide(wanted, share, out=np.zeros_like(share), where=share > 0)[at]
        if max(np.abs(np.bincount(at, w, len(wanted)) - wanted).max() for at, wanted in sides) <= tolerance:
            break
    return dict(zip(names, (w / w.sum()).tolist(), strict=True))


def probabilities(cells: dict[tuple, float], weights: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """How often a document of each cell is drawn in expectation: budget * weight / share. Above 1 it is drawn repeatedly.

    The expected tokens are ``budget`` times all of them, in shares that are the weights; nothing is clipped.
    """
    total = sum(cells.values())
    return {k: budget * (weights[k] * total / cells[k] if cells[k] else 1.0) for k in cells}


def _named(fine: DataFrame, targets: dict[str, dict[str, float]] | None, min_share: float) -> list[list[str]] | None:
    """The values of each dimension that aren't pooled; None where no value is."""
    if min_share <= 0:
        return None
    least, named = min_share * max(fine.agg(F.sum("tokens")).first()[0] or 0, 1), []
    for d in DIMENSIONS:
        sums = fine.groupBy(f"__{d}").agg(F.sum("tokens").alias("tokens"))
        kept = sums.where((F.col("tokens") >= least) | F.col(f"__{d}").isin(list((targets or {}).get(d, {}))))
        named.append([r[0] for r in kept.select(f"__{d}").collect()])  # at most 1 / min_share and the targets' own
    return named


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, alpha: float, rounds: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """``rake`` for any number of cells, a table (__source, __lang, __topic, tokens, ...); adds __weight.

    A weight is the cell's tokens times a factor for each of its values, so a step is a sum for each value
    of one dimension and the factors are all that is stored. It ends when no sum of a round was off by
    more than ``tolerance``, or after ``rounds``.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.withColumn("__weight", F.lit(0.0))
    wanted, factors = {}, {}
    for d in DIMENSIONS:
        sums = _wanted(cells.groupBy(F.col(f"__{d}").alias("value")).agg(F.sum("tokens").alias("n")), (targets or {}).get(d, {}), alpha)
        whole = sums.agg(F.sum("wanted")).first()[0]
        wanted[d] = stored(sums.select("value", (F.col("wanted") / whole if whole > 0 else F.col("n") / total).alias("wanted")), "mix-targets")
        factors[d] = wanted[d].select("value", F.lit(1.0).alias("factor"))

    def weighted():
        out = cells.withColumn("__weight", F.col("tokens") / total)
        for d, factor in factors.items():
            out = out.join(factor.withColumnsRenamed({"value": f"__{d}", "factor": "__factor"}), f"__{d}").withColumn("__weight", F.col("__weight") * F.col("__factor")).drop("__factor")
        return out

    for _ in range(rounds):
        worst = 0.0
        for d in DIMENSIONS:
            sums = weighted().groupBy(F.col(f"__{d}").alias("value")).agg(F.sum("__weight").alias("share"))
            step = F.when(F.col("share") > 0, F.col("wanted") / F.col("share")).otherwise(0.0)
            step = factors[d].join(sums, "value").join(wanted[d], "value").select("value", (F.col("factor") * step).alias("factor"), F.abs(F.col("share") - F.col("wanted")).alias("off"))
            step = stored(step, "mix-factors")
            worst = max(worst, step.agg(F.max("off")).first()[0])
            factors[d] = step.drop("off")
        if worst <= tolerance:
            break
    out = weighted()
    return out.withColumn("__weight", F.col("__weight") / out.agg(F.sum("__weight")).first()[0])


def _fitted(rows: DataFrame, cells: DataFrame, targets: dict[str, dict[str, float]] | None, alpha: float, budget: float, collected: int) -> DataFrame:
    """``rows`` with the __weight and __expected draws of their cell. No row is lost, whatever the number of cells."""
    spark = rows.sparkSession
    keys = [f"__{d}" for d in DIMENSIONS]
    if len(found := cells.select(*keys, "tokens").limit(collected + 1).collect()) <= collected:
        tokens = {tuple(r[:3]): float(r[3]) for r in found}
        shares = []
        for d, name in enumerate(DIMENSIONS):
            sums: dict[str, float] = {}
            for k, n in tokens.items():
                sums[k[d]] = sums.get(k[d], 0.0) + n
            shares.append((targets or {}).get(name) or {v: n**alpha for v, n in sums.items()})
        weights = rake(tokens, shares)
        expected = probabilities(tokens, weights, budget)
        columns = [*(pa.array([k[i] for k in tokens], pa.string()) for i in range(len(keys))), *(pa.array([of[k] for k in tokens], pa.float64()) for of in (weights, expected))]
        table = spark.createDataFrame(pa.Table.from_arrays(columns, [*keys, "__weight", "__expected"]))  # from Arrow: no Python worker
        return rows.join(F.broadcast(table), keys, "left")
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 0))
    often = F.when(F.col("tokens") > 0, F.col("__weight") * total / F.col("tokens")).otherwise(1.0) * budget
    table = stored(rake_table(cells, targets, alpha).withColumn("__expected", often), "mix-weights")
    # Cells with many rows are broadcast, so that none of them lands in one task; of the others each has few rows.
    hot = table.orderBy(F.desc("rows"), *keys).limit(collected).drop("tokens", "rows")
    hot = F.broadcast(stored(hot, "mix-hot"))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(table.drop("tokens", "rows"), keys))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = 0.7, min_share: float = 0.005, budget: float = 0.8, seed: int = 17, collected: int = COLLECTED) -> DataFrame:
    """``docs`` with __source, __lang, __topic, __tokens, __weight, __expected, __probability, __copies and __sampled.

    The weights of (source, language, topic) cells are raked to the targets: shares of tokens for each
    dimension, or where none are given the natural shares to the power ``alpha``. A document is drawn
    __expected = budget * weight / share of its cell times in expectation, repeatedly where that is above 1:
    the whole part for sure, the rest by a hash of the document, so the draw is repeatable. So the expected
    tokens are ``budget`` times all of them, and their shares meet the targets; ``marginals`` reports them.
    Values with less than ``min_share`` of the tokens and no target are pooled as (rest); with a ``min_share``
    of 0 none are, and every value has its own target, however many there are.

    Nulls of a dimension are the value (none); null and empty texts have no tokens and go with their cell, once
    at most (or by ``budget`` where a cell has no tokens); repeated rows are drawn alike; an empty table gives no rows.
    """
    rows, keys = _rows(docs), [f"__{d}" for d in DIMENSIONS]
    cells = stored(rows.groupBy(*keys).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("rows")), "mix-cells")
    if named := _named(cells, targets, min_share):
        pooled = {k: F.when(F.col(k).isin(values), F.col(k)).otherwise(REST) for k, values in zip(keys, named, strict=True)}
        rows, cells = rows.withColumns(pooled), cells.withColumns(pooled).groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
    return _drawn(_fitted(rows, cells, targets, alpha, budget, collected), seed)


def _drawn(found: DataFrame, seed: int) -> DataFrame:
    """Adds how often each row is drawn to rows that have their cell's __expected."""
    expected = F.coalesce(F.col("__expected"), F.lit(0.0))
    found = found.withColumn("__expected", F.when(F.col("__tokens") > 0, expected).otherwise(F.least(expected, F.lit(1.0))))
    whole = F.floor("__expected")
    copies = whole + (unit_hash(F.lit(seed), "doc_id", "text") < F.col("__expected") - whole).cast("long")
    return found.withColumn("__copies", copies).withColumns({"__probability": F.least("__expected", F.lit(1.0)), "__sampled": F.col("__copies") > 0})


def mixing(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled, expected, copies for every document."""
    columns = [c for c in ("doc_id", "text", *DIMENSIONS) if c in docs.columns]
    names = {"__source": "source", "__lang": "lang", "__topic": "topic", "__tokens": "n_tokens", "__weight": "weight", "__probability": "probability", "__sampled": "sampled", "__expected": "expected", "__copies": "copies"}
    return mixed(docs.select(*columns), **parameters).select("doc_id", *(F.col(k).alias(v) for k, v in names.items()))


def sample_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The drawn rows of ``docs``, each as often as it is drawn, all columns as they are, whatever their names.

    Nulls of source, language or topic are a value of their own; texts without tokens go with their cell; repeated
    rows are drawn alike; an empty table stays empty.
    """
    used = [docs[c] for c in ("doc_id", "text", *DIMENSIONS) if c in docs.columns]
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *used)
    drawn = mixed(rows, **parameters).where("__sampled").select("row", F.col("__copies").cast("int").alias("copies"))
    return drawn.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def marginals(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = 0.7, **parameters) -> DataFrame:
    """dimension, value and its shares of the tokens: natural, target, expected of the draw, drawn."""
    rows = mixed(docs, targets, alpha, **parameters)
    n = F.col("__tokens")
    cells = stored(rows.groupBy("__source", "__lang", "__topic").agg(F.sum(n).alias("n"), F.sum(n * F.col("__expected")).alias("e"), F.sum(n * F.col("__copies")).alias("d")), "mix-drawn")
    out = None
    for d in DIMENSIONS:
        own = (targets or {}).get(d, {})
        sums = cells.groupBy(F.col(f"__{d}").alias("value")).agg(*(F.sum(c).alias(c) for c in "ned"))
        part = _wanted(sums, own, alpha).crossJoin(F.broadcast(_wanted(sums, own, alpha).agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "wanted", "e", "d")))))
        shares = [(F.col(c) / F.nullif(F.col(f"all_{c}"), F.lit(0))).alias(name) for c, name in (("n", "natural"), ("wanted", "target"), ("e", "expected"), ("d", "drawn"))]
        part = part.select(F.lit(d).alias("dimension"), "value", *shares)
        out = part if out is None else out.union(part)
    return out


def _wanted(sums: DataFrame, own: dict[str, float], alpha: float) -> DataFrame:
    """Adds to (value, n) the tokens wanted of each value, up to a factor: as ``rake`` takes targets."""
    if not own:
        return sums.withColumn("wanted", F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(alpha))).otherwise(0.0))
    given = sums.sparkSession.createDataFrame(pa.table({"value": pa.array(list(own), pa.string()), "given": pa.array([float(v) for v in own.values()], pa.float64())}))
    everything = sums.agg(F.sum("n").alias("everything"))
    found = sums.join(F.broadcast(given), "value", "left").crossJoin(F.broadcast(everything))
    return found.withColumn("wanted", F.when(F.col("n") > 0, F.coalesce("given", F.col("n") / F.col("everything"))).otherwise(0.0)).drop("given", "everything")
