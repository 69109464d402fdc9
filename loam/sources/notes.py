"""Notes as files: reading a tree of Markdown notes, and writing tables, JSON lines and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a note store, and files of it that are no notes.
FOLDERS = ["entities", "live-notes", "decisions", "originals", "inbox", "tasks", "meetings", "debug"]
SYSTEM_FILES = ["RESOLVER.md", "TEMPLATES.md", "open-loops.md", "fact-registry.md"]


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """``path, dir, stem, content, mtime, size, hash`` of every note below ``root``; notes at the top have dir ``base``.

    Files that are not UTF-8 keep replacement characters; system files are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    rows = files.where(~name.isin(SYSTEM_FILES))
    return rows.select(
        "path", F.when(folder.isin(FOLDERS), folder).otherwise("base").alias("dir"), F.regexp_replace(name, r"\.md$", "").alias("stem"),
        F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.substring(F.sha2("content", 256), 1, 12).alias("hash"),
    )


def read_events_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of session events; broken lines are skipped, absent fields are null."""
    schema = "ts string, event string, tags array<string>, importance string, entity string, task string, decision string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_events_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, one folder per day."""
    events.withColumn("day", F.substring("ts", 1, 10)).write.mode("append").partitionBy("day").json(path)


def write_report(report: DataFrame, path: str, form: str = "csv") -> None:
    """Write a report as ``csv`` (with header), ``json`` or ``parquet``."""
    writer = report.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)


def timeline_line(day: Column, text: Column, source: Column) -> Column:
    """A timeline bullet; the inverse of ``loam.operators.lifecycle.timeline``."""
    return F.concat(F.lit("- **"), day, F.lit("** | "), text, F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit(" [Source: "), source, F.lit("]"))).otherwise(""))


def fact_line(key: Column, value: Column, vf: Column, vt: Column, recorded: Column) -> Column:
    """A fact line with its interval; the inverse of ``loam.operators.lifecycle.fact_lines``."""
    end = F.when(vt.isNull(), F.lit(")")).otherwise(F.concat(vt, F.lit("]")))
    return F.concat(F.lit("- "), key, F.lit(": "), value, F.lit(" <!-- valid:["), F.coalesce(vf, F.lit("")), F.lit(".."), end, F.lit(" recorded:"), recorded, F.lit(" -->"))


def track(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes with those of ``new`` whose stem is not there yet (an append behind an anti-join)."""
    return notes.unionByName(new.dropDuplicates(["stem"]).join(notes.select("stem"), "stem", "left_anti").select(*notes.columns))
