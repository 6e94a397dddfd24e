"""Types of text columns from their names and all of their data."""

import json as _json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
_DAY = r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_TIME = r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?"
NAIVE = rf"^{_DAY}([ T]{_TIME})?$"
OFFSET = rf"^{_DAY}[ T]{_TIME} ?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)$"

#: What a column's name suggests (fixed patterns): only such columns are tested.
HINTS = {
    "boolean": r"^(is|has|can|should|was)_|_(flag|enabled|active|ok)$|^(bool|flag|enabled|active|deleted)",
    "timestamp": r"(^|_)(at|ts|time|date|timestamp|created|updated|modified|deleted)($|_)|^(ts|created|updated)",
    "json": r"(^|_)(json|meta|metadata|payload|props|properties|attributes|data|doc|settings|config)($|_)|^js",
    "uuid": r"(^|_)(uuid|guid)($|_)|_id$|^uuid",
}


def hint(name: str, kind: str) -> bool:
    return re.search(HINTS[kind], name.lower()) is not None


@F.pandas_udf(T.BooleanType())
def _sound_json(texts: pd.Series) -> pd.Series:
    """Whether each text is a JSON object or array without a repeated key at any depth."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError
        return dict(items)

    def good(t):
        if t is None:
            return None
        try:
            return isinstance(_json.loads(t, object_pairs_hook=pairs, parse_constant=_fail), (dict, list))
        except (ValueError, RecursionError):
            return False

    return texts.map(good)


@F.pandas_udf(T.BooleanType())
def _repeats_key(texts: pd.Series) -> pd.Series:
    def repeats(t):
        if t is None:
            return None
        seen = []
        try:
            _json.loads(t, object_pairs_hook=lambda items: seen.append(len({k for k, _ in items}) != len(items)))
        except (ValueError, RecursionError):
            return False
        return any(seen)

    return texts.map(repeats)


def _fail(_):
    raise ValueError


def duplicate_keys(c: Column) -> Column:
    """Whether JSON text that is otherwise sound repeats a key within one object, at any depth."""
    return F.coalesce(_repeats_key(c), F.lit(False))


def is_kind(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.lower(c).isin("0", "1", "true", "false", "t", "f")
    if kind == "uuid":
        return c.rlike(UUID)
    if kind == "timestamp":
        return c.rlike(NAIVE) & F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" "))).isNotNull()
    if kind == "timestamptz":
        return c.rlike(OFFSET)
    if kind == "json":
        return _sound_json(c)
    raise ValueError(kind)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: per check the rows whose value is there and not valid; all checks in one pass."""
    return df.agg(*[F.count_if(~ok).cast("bigint").alias(name) for name, ok in checks.items()])


def infer(df: DataFrame, names_only: bool = True) -> dict[str, str]:
    """The type of each text column: boolean, timestamp, timestamptz, json, uuid or text.

    A column is promoted only if its name suggests it (or names_only is off), it has a value, and every value fits; one scan tests
    them all.  Naive and zoned timestamps do not mix.
    """
    wanted: dict[str, tuple[str, str]] = {}
    for f in df.schema.fields:
        if f.dataType.simpleString() != "string":
            continue
        for kind in ("boolean", "timestamp", "json", "uuid"):
            if not names_only or hint(f.name, kind):
                for one in (kind, "timestamptz") if kind == "timestamp" else (kind,):
                    wanted[f"c{len(wanted)}"] = (f.name, one)
    out = {f.name: "text" for f in df.schema.fields if f.dataType.simpleString() == "string"}
    if not wanted:
        return out
    cells = []
    for k, (name, kind) in wanted.items():
        c = F.col(f"`{name}`")
        cells += [F.count_if(c.isNotNull() & ~F.coalesce(is_kind(c, kind), F.lit(False))).alias(k), F.count(c).alias(f"{k}_n")]
    row = df.agg(*cells).first()
    for k, (name, kind) in wanted.items():
        if out[name] == "text" and row[f"{k}_n"] and not row[k]:
            out[name] = kind
    return out


def promote(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with the columns cast to what infer() found; JSON stays text, as it must stay byte for byte."""
    casts = {
        "boolean": lambda c: F.lower(c).isin("1", "true", "t"),
        "timestamp": lambda c: F.replace(c, F.lit("T"), F.lit(" ")).cast("timestamp_ntz"),
        "timestamptz": lambda c: F.replace(c, F.lit("T"), F.lit(" ")).cast("timestamp"),
        "uuid": F.lower,
    }
    return df.select(*[casts[types[n]](F.col(f"`{n}`")).alias(n) if types.get(n) in casts else F.col(f"`{n}`") for n in df.columns])


def affinity(declared: str) -> str:
    """The storage class of a loosely declared type: by the first of these words in it."""
    up = declared.upper()
    for words, kind in ((("INT",), "integer"), (("CHAR", "CLOB", "TEXT"), "text"), (("BLOB",), "blob"), (("REAL", "FLOA", "DOUB"), "real")):
        if any(w in up for w in words):
            return kind
    return "numeric" if up.strip() else "blob"
