"""Metrics in text form as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+-?\d+)?\s*$"
_LABEL = r'([A-Za-z_]\w*)="((?:[^"\\]|\\.)*)"'


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, labels, value) of each sample line; comments and blank lines are left out, anything else that is no sample is an error."""
    c = F.trim(F.col(column))
    kept = lines.filter((c != "") & ~c.startswith("#"))
    inside = F.regexp_extract(c, _LINE, 2)
    labels = F.map_from_arrays(F.regexp_extract_all(inside, F.lit(_LABEL), 1), F.regexp_extract_all(inside, F.lit(_LABEL), 2))
    text = F.regexp_extract(c, _LINE, 3)
    number = F.when(text == "+Inf", float("inf")).when(text == "-Inf", float("-inf")).otherwise(text.try_cast("double"))
    value = F.when(c.rlike(_LINE) & number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("no sample: "), c)))
    return kept.select(F.regexp_extract(c, _LINE, 1).alias("name"), labels.alias("labels"), value.alias("value"))
