"""Output shape shared by a query and its check SQL: names, types, rounding.

A shape is a string of `name[:type]`; types: s text (default), l integer, dN double
rounded half up to N places (d = 4; no number = NULL), t time stamp text, D date text, b boolean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import floored


def _fields(shape: str) -> list[tuple[str, str, int]]:
    out = []
    for token in shape.split():
        name, _, kind = token.partition(":")
        kind = kind or "s"
        out.append((name, kind[0], int(kind[1:] or 4)))
    return out


def shaped(df: DataFrame, shape: str) -> DataFrame:
    cols = []
    for name, kind, digits in _fields(shape):
        c = F.col(name)
        if kind == "l":
            c = c.cast("long")
        elif kind == "d":
            unit = F.lit(float(10**digits))
            c = c.cast("double")
            c = F.when(~F.isnan(c), floored(c * unit + F.lit(0.5)) / unit)
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "D":
            c = F.date_format(F.to_date(c), "yyyy-MM-dd")
        elif kind == "b":
            c = c.cast("boolean")
        cols.append(c.alias(name))
    return df.select(*cols)


def shaped_sql(sql: str, shape: str) -> str:
    cols = []
    for name, kind, digits in _fields(shape):
        c = name
        if kind == "l":
            c = f"CAST({name} AS BIGINT)"
        elif kind == "d":
            c = f"CASE WHEN NOT isnan(CAST({name} AS DOUBLE)) THEN floor(CAST({name} AS DOUBLE) * 1e{digits} + 0.5e0) / 1e{digits} END"
        elif kind == "t":
            c = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
        elif kind == "D":
            c = f"strftime(CAST({name} AS DATE), '%Y-%m-%d')"
        elif kind == "b":
            c = f"CAST({name} AS BOOLEAN)"
        cols.append(f"{c} AS {name}")
    return f"SELECT {', '.join(cols)} FROM (\n{sql}\n) shaped"
