"""Schema inspection and validation (SCH-01 to SCH-05). None of it runs a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.clock import parse_date

#: Name patterns by the kind of an integer column.
CATEGORY_ENDS = ("_id", "_code", "_type", "_category", "_num")
BOOLEAN_STARTS = ("is_", "has_", "was_", "requires_")


def column_types(df: DataFrame, exclude: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """SCH-01: columns by kind: numeric, text, boolean, date, other."""
    out: dict[str, list[str]] = {"numeric": [], "text": [], "boolean": [], "date": [], "other": []}
    for f in df.schema.fields:
        if f.name not in exclude:
            t = f.dataType
            kind = "numeric" if isinstance(t, T.NumericType) else "text" if isinstance(t, T.StringType) else "boolean" if isinstance(t, T.BooleanType) else "date" if isinstance(t, (T.DateType, T.TimestampType)) else "other"
            out[kind].append(f.name)
    return out


def _bare(name: str) -> str:
    return name.lower().removeprefix("feature_").removeprefix("label_")


def column_types_by_name(df: DataFrame, exclude: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """SCH-02: the same, integers named like ids moved to ``text``, like flags to ``boolean``."""
    out = column_types(df, exclude)
    integers = [c for c in out["numeric"] if isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))]
    for c in integers:
        to = "boolean" if _bare(c).startswith(BOOLEAN_STARTS) else "text" if _bare(c).endswith(CATEGORY_ENDS) else None
        if to:
            out["numeric"].remove(c)
            out[to].append(c)
    return out


def validate(df: DataFrame, strict: bool = False) -> list[str]:
    """SCH-03: what in the names doesn't fit the types; ``strict`` raises."""
    found = []
    for f in df.schema.fields:
        n, t = _bare(f.name), f.dataType
        if n.startswith(BOOLEAN_STARTS) and not isinstance(t, (T.BooleanType, T.IntegerType, T.LongType)):
            found.append(f"{f.name} is named like a flag but is {t.simpleString()}")
        if n.endswith(("_date", "_timestamp")) and not isinstance(t, (T.DateType, T.TimestampType, T.StringType)):
            found.append(f"{f.name} is named like a date but is {t.simpleString()}")
        if n.endswith(("_score", "_pct", "_rate", "_ratio")) and not isinstance(t, T.NumericType):
            found.append(f"{f.name} is named like a measure but is {t.simpleString()}")
    repeated = {c for c in df.columns if df.columns.count(c) > 1}
    found += [f"{c} occurs more than once" for c in sorted(repeated)]
    if strict and found:
        raise ValueError("; ".join(found))
    return found


def normalize(df: DataFrame, date_columns: list[str] | None = None) -> DataFrame:
    """SCH-04: booleans as 0/1, named text dates parsed."""
    names = date_columns if date_columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and _bare(f.name).endswith("date")]
    out = {c: F.col(c).cast("int") for c in column_types(df)["boolean"]} | {c: parse_date(c) for c in names}
    return df.withColumns(out) if out else df


def require(df: DataFrame, columns: dict[str, str] | list[str]) -> DataFrame:
    """SRC-05, SCH-05: the frame itself if it has the columns (with these types); else an error that names
    what is missing."""
    have, wanted = dict(df.dtypes), columns if isinstance(columns, dict) else dict.fromkeys(columns)
    found = [f"{c} is missing" if c not in have else f"{c} is {have[c]}, not {t}" for c, t in wanted.items() if c not in have or (t and have[c] != t)]
    if found:
        raise ValueError("; ".join(found))
    return df
