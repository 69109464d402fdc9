"""Mixed timestamp formats and zones of several tables, normalised to one instant each (problem 2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.instants import instant_us, is_canonical, noncanonical_us, with_agent

#: Row key and timestamp fields of each table.
FIELDS = {
    "edges": ("id", ["created_at", "valid_from"]),
    "nodes": ("node_no", ["updated_at"]),
    "aliases": ("alias_no", ["created_at"]),
}


def stacked(df: DataFrame, source_table: str, row_key: str, fields: list[str]) -> DataFrame:
    """One row per (row, field) with a value that is present and not in canonical form; one scan of the table."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return (
        df.select(F.col(row_key).cast("long").alias("row_key"), "agent", F.inline(values))
        .where(F.col("value").isNotNull() & ~is_canonical(F.col("value")))
        .select(F.lit(source_table).alias("source_table"), "row_key", "field", "value", "agent")
    )


def normalised_values(tables: dict[str, DataFrame], agents: DataFrame) -> DataFrame:
    """``(source_table, row_key, field, epoch_us)`` of every value that has an instant and is not yet canonical.

    ``tables`` maps a name of ``FIELDS`` to its DataFrame.  Null, blank, junk and impossible values give no row;
    repeated rows give repeated rows; an empty table gives none.
    """
    parts = [stacked(df, name, *FIELDS[name]) for name, df in tables.items()]
    values = reduce(DataFrame.unionByName, parts)
    us = noncanonical_us(F.col("value"), F.col("_zone"), F.col("_order"))
    return (
        with_agent(values, agents)
        .select("source_table", "row_key", "field", us.alias("epoch_us"))
        .where(F.col("epoch_us").isNotNull())
    )


def shape_report(tables: dict[str, DataFrame], agents: DataFrame) -> DataFrame:
    """Per table of ``FIELDS``, field and shape (digits ``9``, ASCII letters ``a``): values and how many have an instant.

    Null values are counted under the shape null.
    """
    parts = []
    for name, df in tables.items():
        values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS[name][1]])
        parts.append(df.select(F.lit(name).alias("source_table"), "agent", F.inline(values)))
    rows = with_agent(reduce(DataFrame.unionByName, parts), agents)
    us = instant_us(F.col("value"), F.col("_zone"), F.col("_order"))
    shape = F.regexp_replace(F.regexp_replace(F.trim("value"), "[0-9]", "9"), "[A-Za-z]", "a")
    return (
        rows.select("source_table", "field", shape.alias("shape"), us.alias("us"))
        .groupBy("source_table", "field", "shape")
        .agg(F.count(F.lit(1)).alias("n_values"), F.count("us").alias("n_instants"))
    )


def edge_instant(field: str) -> Column:
    """Microseconds of a field of rows that went through ``with_agent``."""
    return instant_us(F.col(field), F.col("_zone"), F.col("_order"))
