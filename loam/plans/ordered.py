"""Ordered computations per key (running totals, lag, lead) that survive a hot key.

A plain window puts all rows of a key into one task.  Here keys with more than ``target_rows`` rows are cut into
*buckets*: consecutive ranges of the order column, made by Spark's own range partitioning, so their bounds are
sampled quantiles and no bucket depends on how the order column is spread.  Windows then run per (key, bucket) and
what crosses a bucket's edge is added from one summary row per bucket.  The summaries are as many as there are
range partitions plus hot keys; they are broadcast up to ``BROADCAST_ROWS`` and joined by shuffling beyond.  Without a hot key no extra work is done.

The order column must be unique per key (aggregate ties first); rows are never dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.session import cut

TARGET_ROWS = 1_000_000
#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 100_000


@dataclass
class Bucketed:
    """Rows with ``_bucket`` (0 for keys that aren't hot), and whether any key is hot."""

    df: DataFrame
    keys: list[str]
    order: str
    hot: bool
    summaries: int = 0

    def _window(self):
        return Window.partitionBy(*self.keys, "_bucket").orderBy(self.order)

    def _with(self, df: DataFrame) -> Bucketed:
        return Bucketed(df, self.keys, self.order, self.hot, self.summaries)

    def _join_summary(self, df: DataFrame, summary: DataFrame, names: list[str]) -> DataFrame:
        on = [df[k].eqNullSafe(summary[k]) for k in [*self.keys, "_bucket"]]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        side = F.broadcast(summary) if self.summaries <= BROADCAST_ROWS else summary
        return df.join(side, condition, "left").select(*[df[c] for c in df.columns], *[summary[n] for n in names])

    def running_total(self, value: str, out: str, total: str) -> Bucketed:
        """Add ``out``: the sum of ``value`` up to and with this row; ``total``: the key's sum."""
        whole = Window.partitionBy(*self.keys, "_bucket")
        df = self.df.withColumn(out, F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0))).withColumn(
            total, F.sum(value).over(whole)
        )
        if not self.hot:
            return self._with(df)
        sums = self.df.where("_bucket > 0").groupBy(*self.keys, "_bucket").agg(F.sum(value).alias("_bucket_sum"))
        by_key = Window.partitionBy(*self.keys)
        before = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        summary = sums.withColumn("_sum_before", F.sum("_bucket_sum").over(before)).withColumn("_sum_all", F.sum("_bucket_sum").over(by_key))
        df = self._join_summary(df, summary, ["_sum_before", "_sum_all"])
        df = df.withColumn(out, F.col(out) + F.coalesce("_sum_before", F.lit(0))).withColumn(total, F.coalesce("_sum_all", total))
        return self._with(df.drop("_sum_before", "_sum_all"))

    def neighbours(self, lag: dict[str, str], lead: dict[str, str]) -> Bucketed:
        """Add columns of the row before (``lag``: new name to column) and after (``lead``) within the key."""
        w = self._window()
        df = self.df
        for new, c in lag.items():
            df = df.withColumn(new, F.lag(c).over(w))
        for new, c in lead.items():
            df = df.withColumn(new, F.lead(c).over(w))
        if not self.hot:
            return self._with(df)
        rows = self.df.where("_bucket > 0").groupBy(*self.keys, "_bucket").agg(
            F.max_by(F.struct(F.lit(1).alias("_one"), *lag.values()), self.order).alias("_edge_last"),
            F.min_by(F.struct(F.lit(1).alias("_one"), *lead.values()), self.order).alias("_edge_first"),
            F.min(self.order).alias("_edge_lo"),
            F.max(self.order).alias("_edge_hi"),
        )
        by_key = Window.partitionBy(*self.keys).orderBy("_bucket")
        summary = rows.withColumn("_edge_last", F.lag("_edge_last").over(by_key)).withColumn("_edge_first", F.lead("_edge_first").over(by_key))
        df = self._join_summary(df, summary, ["_edge_last", "_edge_first", "_edge_lo", "_edge_hi"])
        for new, c in lag.items():
            df = df.withColumn(new, F.when(F.col(self.order) == F.col("_edge_lo"), F.col("_edge_last")[c]).otherwise(F.col(new)))
        for new, c in lead.items():
            df = df.withColumn(new, F.when(F.col(self.order) == F.col("_edge_hi"), F.col("_edge_first")[c]).otherwise(F.col(new)))
        return self._with(df.drop("_edge_last", "_edge_first", "_edge_lo", "_edge_hi"))

    def carried(self, value: str, out: str) -> Bucketed:
        """Add ``out``: the last ``value`` that isn't null, up to and with this row."""
        df = self.df.withColumn(out, F.last(value, ignorenulls=True).over(self._window().rowsBetween(Window.unboundedPreceding, 0)))
        if not self.hot:
            return self._with(df)
        last = F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(self.order)))
        rows = self.df.where("_bucket > 0").groupBy(*self.keys, "_bucket").agg(last.alias("_bucket_last"))
        before = Window.partitionBy(*self.keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        summary = rows.withColumn("_carry_in", F.last("_bucket_last", ignorenulls=True).over(before))
        df = self._join_summary(df, summary, ["_carry_in"])
        return self._with(df.withColumn(out, F.coalesce(out, "_carry_in")).drop("_carry_in"))

    def column(self, name: str, value: Column) -> Bucketed:
        return self._with(self.df.withColumn(name, value))


def bucketed(df: DataFrame, keys: list[str], order: str, target_rows: int = TARGET_ROWS) -> Bucketed:
    """Cut hot keys into buckets.  ``df`` is read several times: pass a table or a checkpoint."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows)
    found = hot.agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows")).first()
    if not found["keys"]:
        return Bucketed(df.withColumn("_bucket", F.lit(0)), keys, order, False)
    side = hot.select(*[F.col(k).alias(f"_{k}") for k in keys])
    if found["keys"] <= BROADCAST_ROWS:
        side = F.broadcast(side)
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(side[f"_{k}"])
    cold = df.join(side, condition, "left_anti").withColumn("_bucket", F.lit(0))
    parts = 1 + -(-int(found["rows"]) // target_rows)
    ranged = df.join(side, condition, "left_semi").repartitionByRange(parts, *keys, order)
    return Bucketed(cold.unionByName(cut(ranged.withColumn("_bucket", F.spark_partition_id() + 1))), keys, order, True, parts + found["keys"])
