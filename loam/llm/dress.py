"""Duplicates hidden by formatting differences (problem 3).

Records are hashed through the skip-and-fold table and grouped by hash; counts and first records are combined before
the shuffle, so a hot group is one row per task.  Groups in more than one dress are joined back (one row per group
on one side, so adaptive execution can split a hot one) and each row is compared with the group's first record.
Rows that collide without being equal fall back to their canonical string.  Only groups whose records have one unfolded
64-bit hash as well are taken as equal without a comparison.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.fold import not_blank
from loam.llm.folding import PRIMES, canonical, fold_hash, same_folded
from loam.session import cut

#: Relations in which the order of the two ids does not count.
SYMMETRIC = ["knows", "partner_of", "collaborates_with", "sibling_of", "related_to", "similar_to"]


def _hash(value: Column, primes: tuple[int, int]) -> Column:
    @F.arrow_udf(T.LongType())
    def poly(column: pa.Array) -> pa.Array:
        return fold_hash(column, primes)

    return poly(value)


@F.arrow_udf(T.BooleanType())
def _agrees(xs: pa.Array, ys: pa.Array, symmetric: pa.Array) -> pa.Array:
    """Whether two records (arrays of fields) agree; with ``symmetric`` the first and last field may swap."""

    def same(x: list, y: list, swap: bool) -> bool:
        if all(map(same_folded, x, y)):
            return True
        return swap and all(map(same_folded, [x[2], x[1], x[0]], y))

    return pa.array(list(map(same, xs.to_pylist(), ys.to_pylist(), symmetric.to_pylist())), pa.bool_())


@F.arrow_udf(T.StringType())
def _canonical(xs: pa.Array, symmetric: pa.Array) -> pa.Array:
    def text(x: list, swap: bool) -> str:
        fields = [canonical(f) for f in x]
        if swap and fields[0] > fields[2]:
            fields = fields[::-1]
        return "\x00".join(fields)

    return pa.array(list(map(text, xs.to_pylist(), symmetric.to_pylist())), pa.string())


def copies(records: DataFrame, hashes: list[str]) -> DataFrame:
    """``(first_key, copies)`` of groups of two rows or more.

    ``records`` has ``row_key``, ``fields`` (array of strings without nulls), ``symmetric`` and the columns of
    ``hashes`` (never null).
    """
    records = records.withColumn("raw", F.xxhash64("fields"))
    head = F.min(F.struct(F.col("row_key").alias("first"), "fields")).alias("head")
    groups = records.groupBy(*hashes).agg(F.count(F.lit(1)).alias("copies"), head, F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    groups = cut(groups.where("copies > 1"))  # read twice, and small beside the records
    plain = groups.where("lo = hi").select(F.col("head.first").alias("first_key"), "copies")
    several = groups.where("lo != hi").select(*hashes, F.col("head.fields").alias("head"))
    told = records.select(*hashes, "fields", "symmetric", "row_key").join(several, hashes)
    told = told.withColumn("same", _agrees("fields", "head", "symmetric"))
    apart = F.when(~F.col("same"), _canonical(F.when(~F.col("same"), F.col("fields")).otherwise(F.array(F.lit(""), F.lit(""), F.lit(""))), F.col("symmetric")))
    verified = (
        told.withColumn("apart", apart)
        .groupBy(*hashes, "apart")
        .agg(F.min("row_key").alias("first_key"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("first_key", "copies")
    )
    return plain.unionByName(verified)


def node_records(nodes: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Labels as records; null labels are none, a label without letters and digits folds to the empty text."""
    rows = nodes.select(F.col("node_no").cast("long").alias("row_key"), "label").where(F.col("label").isNotNull())
    empty = F.lit("")
    return rows.select("row_key", F.array("label", empty, empty).alias("fields"), F.lit(False).alias("symmetric"), _hash(F.col("label"), primes).alias("h0"))


def edge_records(edges: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Edges that are not temporal and have both ids; a null graph_type is ``entity``, a null relation is empty."""
    kind = F.coalesce(F.col("graph_type"), F.lit("entity"))
    rows = edges.where((kind != "temporal") & not_blank(F.col("from_id")) & not_blank(F.col("to_id"))).select(
        F.col("id").cast("long").alias("row_key"), kind.alias("kind"), "from_id", F.coalesce("relation", F.lit("")).alias("relation"), "to_id"
    )
    hashed = rows.select(
        "*", _hash(F.col("from_id"), primes).alias("a"), _hash(F.col("relation"), primes).alias("h1"), _hash(F.col("to_id"), primes).alias("b")
    )
    symmetric = F.col("h1").isin(fold_hash(pa.array(SYMMETRIC), primes).to_pylist())
    return hashed.select(
        "row_key",
        F.array("from_id", "relation", "to_id").alias("fields"),
        symmetric.alias("symmetric"),
        F.col("kind").alias("h0"),
        "h1",
        F.when(symmetric, F.least("a", "b")).otherwise(F.col("a")).alias("h2"),
        F.when(symmetric, F.greatest("a", "b")).otherwise(F.col("b")).alias("h3"),
    )


def dressed_copies(nodes: DataFrame, edges: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``(source_table, first_key, copies)`` of node labels and edges stored at least twice in different dress.

    Rows repeated as they are count as copies.  Nulls in other columns don't matter; empty tables give no rows.
    ``primes`` is for tests: small ones force collisions, and the result stays the same.
    """
    of = lambda name, df: df.select(F.lit(name).alias("source_table"), "first_key", "copies")
    return of("nodes", copies(node_records(nodes, primes), ["h0"])).unionByName(of("edges", copies(edge_records(edges, primes), ["h0", "h1", "h2", "h3"])))


def copy_histogram(found: DataFrame) -> DataFrame:
    """Per table and number of copies: groups and rows that would go."""
    return found.groupBy("source_table", "copies").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("copies") - 1).alias("n_surplus"))
