"""Cleaning: tokens to flags, grades to ranks, nested JSON to columns, schema projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL = "__missing__"


def flag(c: Column, true: Sequence[str], false: Sequence[str]) -> Column:
    """1 or 0 for listed spellings or numbers (non-zero is 1); null for anything else."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    return F.when(text.isin(*true), 1).when(text.isin(*false), 0).when(number.isNotNull(), (number != 0).cast("int"))


def ordinal(c: Column, grades: Sequence[str]) -> Column:
    """Rank of a grade, the last one highest (1 for the first); null if unknown."""
    pairs = [x for i, g in enumerate(grades, 1) for x in (F.lit(g), F.lit(i))]
    return F.element_at(F.create_map(*pairs), F.upper(F.trim(c))) if pairs else F.lit(None)


def or_sentinel(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(SENTINEL))


#: Strings in either quotes, words, and what lies between.
_TOKENS = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[A-Za-z_]+|[^A-Za-z_"']++|.)"""
#: Words outside strings that JSON spells another way.
_WORDS = {"None": "null", "True": "true", "False": "false"}


def _json_token(token: Column) -> Column:
    """A single-quoted string in double quotes: ``\\'`` loses its backslash, a bare ``"`` gets one; words by _WORDS; the rest as it is."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    inner = F.regexp_replace(F.regexp_replace(inner, r"(\\\\)|\\(')", "$1$2"), r'\G((?:[^"\\]|\\.)*+)"', r'$1\\"')
    word = F.element_at(F.create_map(*[F.lit(x) for pair in _WORDS.items() for x in pair]), token)
    return F.when(token.startswith("'") & (F.length(token) > 1), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.coalesce(word, token))


def structs(c: Column, fields: str) -> Column:
    """A string with a JSON array or object, or its single-quoted spelling, as an array of structs; null for junk.

    Strings are told from words, so an apostrophe in double quotes, an escaped one, and words in names stay as they are.
    Text counts as JSON only if it parses as a whole; elements that are null are left out.
    """
    spelled = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(1)), _json_token), "")

    def parsed(text: Column) -> Column:
        listed = F.when(F.trim(text).startswith("["), F.trim(text)).when(F.trim(text).startswith("{"), F.concat(F.lit("["), F.trim(text), F.lit("]")))
        return F.when(F.try_parse_json(listed).isNotNull(), F.from_json(listed, f"array<struct<{fields}>>"))

    return F.filter(F.coalesce(parsed(c), parsed(spelled)), lambda x: x.isNotNull())


def matching(items: Column, field: str, value: Column) -> Column:
    """The first element whose field equals ``value``, else the first element."""
    return F.coalesce(F.get(F.filter(items, lambda x: x[field] == value), F.lit(0)), F.get(items, F.lit(0)))


def renamed(df: DataFrame, names: Mapping[str, str], aliases: Mapping[str, str] | None = None, constants: Mapping[str, object] | None = None, casts: Mapping[str, str] | None = None, drop: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """Rename, alias, add constants that are absent, cast, drop, and put leading columns first; a name to rename that is absent raises."""
    absent = set(names) - set(df.columns)
    if absent:
        raise KeyError(f"no columns {sorted(absent)}")
    df = df.withColumnsRenamed(dict(names)).drop(*drop)
    df = df.withColumns({a: F.col(b) for a, b in (aliases or {}).items()})
    df = df.withColumns({c: F.lit(v) for c, v in (constants or {}).items() if c not in df.columns})
    df = df.withColumns({c: F.col(c).try_cast(t) for c, t in (casts or {}).items() if c in df.columns})
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def no_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Raises if the tables share columns other than the keys."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")


def usable(df: DataFrame, target: str, *positive: str, present: Sequence[str] = ()) -> DataFrame:
    """Rows with a positive target, positive sizes and all of the needed values."""
    condition = F.col(target).isNotNull() & (F.col(target) > 0)
    for c in positive:
        condition &= F.col(c) > 0
    for c in present:
        condition &= F.col(c).isNotNull()
    return df.where(condition)


def feature_columns(groups: Mapping[str, Sequence[str]], wanted: Sequence[str], available: Sequence[str], excluded: Sequence[str] = ()) -> list[str]:
    """Columns of named groups that exist, each once, in order; an unknown group raises."""
    unknown = [g for g in wanted if g not in groups]
    if unknown:
        raise KeyError(f"unknown feature groups: {unknown}")
    names = dict.fromkeys(c for g in wanted for c in groups[g])
    return [c for c in names if c in available and c not in excluded]


def once(df: DataFrame, columns: Sequence[str], step) -> DataFrame:
    """Applies ``step`` unless all ``columns`` are there and each has a value in some row, so that a second run changes nothing."""
    if all(c in df.columns for c in columns):
        filled = df.agg(*[F.max(F.col(c).isNotNull()).alias(f"v{i}") for i, c in enumerate(columns)]).first()
        if all(filled):
            return df
    return step(df)


def composed(df: DataFrame, *steps) -> DataFrame:
    """Applies the steps in order as one lazy plan; later ones may use earlier ones' columns."""
    for step in steps:
        df = df.transform(step)
    return df


def split_kinds(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and other columns of a selection, each in order."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    return numeric, [c for c in columns if c not in numeric]


def with_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds null columns for inputs that are absent."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})
