"""Named SQL expressions that build on each other.

A formula is a list of stages; a stage is a dict of new columns, which later stages may use. Spark
gets one projection per stage (Catalyst merges them as far as that repeats no work), so a value used
several times is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

Stages = list[dict[str, str]]


def apply(df: DataFrame, stages: Stages, drop: str = "t_") -> DataFrame:
    """df with the columns of all stages, but without those whose names begin with `drop`."""
    for stage in stages:
        df = df.selectExpr("*", *(f"{e} AS {c}" for c, e in stage.items()))
    return df.drop(*(c for s in stages for c in s if c.startswith(drop)))


def as_sql(source: str, stages: Stages) -> str:
    """The same as nested SELECTs over a FROM item."""
    sql = source
    for i, stage in enumerate(stages):
        sql = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in stage.items())} FROM {sql}) AS s{i}"
    return sql
