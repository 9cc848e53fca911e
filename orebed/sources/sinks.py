"""Sinks: JSON lines, result tables, run tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One JSON object for each row, as the column value, beside the columns to keep."""
    return results.select(*(keep or []), F.to_json(F.struct(*results.columns)).alias("value"))


def write_json_lines(results: DataFrame, path: str) -> None:
    json_lines(results).write.mode("overwrite").text(path)


def pretty_json(row: Column) -> Column:
    return F.to_json(row, {"pretty": "true"})


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def track_run(run_id: Column, params: Column, ablation: DataFrame, papers: Column | None = None, scored: Column | None = None) -> DataFrame:
    """A long table of a run: run_id, params (a map), name, value: the numbers of papers and of scored ones if given, and
    precision, recall and f1 of each extractor and level as extractor.level.measure."""
    measures = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in ("precision", "recall", "f1")])
    rows = ablation.select("extractor", "level", F.explode(measures).alias("x")).select(F.concat_ws(".", "extractor", "level", "x.m").alias("name"), F.col("x.v").alias("value"))
    counts = [F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in (("paper_count", papers), ("scored_paper_count", scored)) if c is not None]
    if counts:
        rows = rows.unionByName(ablation.sparkSession.range(1).select(F.inline(F.array(*counts))))
    return rows.select(run_id.alias("run_id"), params.alias("params"), "name", "value")


def report_lines(reports: DataFrame) -> DataFrame:
    """The reports of each paper as JSON, one object a row: paper_id, extractor, report (levels with their counts)."""
    levels = F.array_sort(F.collect_list(F.struct("level", "tp", "fp", "fn")))
    return reports.groupBy("paper_id", "extractor").agg(F.to_json(levels).alias("report"))
