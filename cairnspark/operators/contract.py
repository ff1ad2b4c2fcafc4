"""Data contracts: schema rules on the driver, bounds and nulls in one aggregate, key uniqueness in another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUES = "kind string, severity string, column string, n long, message string"
_CLASSES = {"numeric": (T.NumericType,), "string": (T.StringType,), "flag": (T.BooleanType, T.IntegralType, T.FractionalType), "any": (T.DataType,)}


@dataclass(frozen=True)
class Contract:
    """Sections of columns with a type class, bounds, a composite key and columns that may not be null."""

    sections: Mapping[str, tuple[str, Sequence[str]]]
    bounds: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    key: Sequence[str] = ()
    identity: Sequence[str] = ()
    strict: bool = False
    version: str = "1"

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for _, columns in self.sections.values() for c in columns))


def schema_issues(df: DataFrame, contract: Contract) -> list[tuple]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = [("missing", "error", c, 1, f"{section} column is missing") for section, (_, columns) in contract.sections.items() for c in columns if c not in kinds]
    known = {*contract.columns(), *contract.identity, *contract.key}
    out += [("extra", "error" if contract.strict else "warning", c, 1, "column is not in the contract") for c in kinds if c not in known]
    out += [("type", "error", c, 1, f"{kinds[c].simpleString()} isn't {kind}") for kind, columns in contract.sections.values() for c in columns if c in kinds and not isinstance(kinds[c], _CLASSES[kind])]
    return out


def from_groups(groups: Mapping[str, Sequence[str]], kinds: Mapping[str, str], **rest) -> Contract:
    """A contract from feature groups: a group's columns are of the kind that ``kinds`` has for it, ``any`` where it has none; a column counts in its first group."""
    sections: dict[str, list[str]] = {}
    seen: set[str] = set()
    for group, columns in groups.items():
        for c in columns:
            if c not in seen:
                seen.add(c)
                sections.setdefault(kinds.get(group, "any"), []).append(c)
    return Contract({kind: (kind, columns) for kind, columns in sections.items()}, **rest)


def _checks(df: DataFrame, contract: Contract) -> list[tuple]:
    """(kind, column, count of offending rows, message) of each bound and identity."""
    checks = []
    for c, (low, high) in contract.bounds.items():
        if c in df.columns:
            bad = F.lit(False)
            bad = bad if low is None else bad | (F.col(c) < low)
            bad = bad if high is None else bad | (F.col(c) > high)
            checks.append(("bounds", c, F.count_if(bad), f"outside [{low}, {high}]"))
    checks += [("null", c, F.count_if(F.col(c).isNull()), "identity is null") for c in contract.identity if c in df.columns]
    return checks


def value_issues(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows out of bounds and null identities: one aggregate for all columns."""
    checks = _checks(df, contract)
    if not checks:
        return df.sparkSession.createDataFrame([], ISSUES)
    row = df.agg(*[n.alias(f"n{i}") for i, (_, _, n, _) in enumerate(checks)])
    items = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit("error").alias("severity"), F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.lit(m).alias("message")) for i, (kind, c, _, m) in enumerate(checks)])
    return row.select(F.explode(items).alias("i")).select("i.*").where("n > 0")


def write_checked(df: DataFrame, contract: Contract, path: str, invariants: Mapping[str, Column] | None = None) -> DataFrame:
    """Writes ``df`` and returns the issues of its schema and values, and each invariant (a condition of every row) that some rows break.

    Counts are observed by the tasks that write, so the checks cost no scan and no job of their own; repeated keys, which need a shuffle, are ``validate``'s.
    """
    spark, observed = df.sparkSession, Observation()
    checks = _checks(df, contract)
    checks += [("invariant", name, F.count_if(~F.coalesce(c, F.lit(False))), "rows break it") for name, c in (invariants or {}).items()]
    found = schema_issues(df, contract)
    marked = df.observe(observed, *[n.alias(f"n{i}") for i, (_, _, n, _) in enumerate(checks)]) if checks else df
    marked.write.parquet(path)
    if checks:
        row = observed.get
        found += [(kind, "error", c, row[f"n{i}"], message) for i, (kind, c, _, message) in enumerate(checks) if row[f"n{i}"]]
    return spark.createDataFrame(found, ISSUES)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: how many rows are in sets that share a key, and how many such sets; null keys are equal."""
    sets = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))


def offenders(df: DataFrame, column: str, low: float, high: float, key: str, n: int = 3) -> DataFrame:
    return df.where((F.col(column) < low) | (F.col(column) > high)).orderBy(key).limit(n).select(key, column)


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """All issues as a table; the data is valid if none has severity error."""
    spark = df.sparkSession
    found = spark.createDataFrame(schema_issues(df, contract), ISSUES).unionByName(value_issues(df, contract))
    key = [c for c in contract.key if c in df.columns]
    if len(key) > 1:
        twice = duplicate_keys(df, key).where("n_rows > 0")
        found = found.unionByName(twice.select(F.lit("duplicate").alias("kind"), F.lit("error").alias("severity"), F.lit(",".join(key)).alias("column"), F.col("n_rows").alias("n"), F.lit("rows share a key").alias("message")))
    return found


def is_valid(issues: DataFrame) -> bool:
    return not issues.where("severity = 'error'").limit(1).count()


def summary(issues: DataFrame, cap: int = 20) -> str:
    rows = issues.orderBy("severity", "kind", "column").limit(cap).collect()
    return "\n".join(f"{r.severity}: {r.kind} {r.column}: {r.message} ({r.n})" for r in rows) or "valid"
