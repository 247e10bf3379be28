"""Reports as files: CSV and JSON lines by Spark's writers, Markdown as ordered lines.

All three write from the executors, so a report may be as large as its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.units import format_bytes


def cell(value: Column) -> Column:
    """Text of a Markdown cell: no line breaks, bars escaped, null empty."""
    return F.coalesce(F.replace(F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|")), F.lit(""))


def markdown_lines(report: DataFrame, title: str, sizes: tuple[str, ...] = ("size_bytes",)) -> DataFrame:
    """(section, value): the heading and column names in section 0, then a line a row in the report's order; byte columns are shown with units."""
    spark, columns = report.sparkSession, report.columns
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---:" if c in sizes else "---" for c in columns) + " |"]
    cells = [cell(format_bytes(F.col(c)) if c in sizes else F.col(f"`{c}`")) for c in columns]
    body = report.select(F.lit(1).alias("section"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    top = spark.createDataFrame([(0, "\n".join(head))], "section int, value string")
    return top.unionAll(body)


def export(report: DataFrame, kind: str, path: str, title: str = "Inventory") -> None:
    """Writes a report to a folder of part files whose names follow its order; kind is csv, json or markdown."""
    if kind == "csv":
        report.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        report.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif kind == "markdown":
        markdown_lines(report, title).select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {kind!r}; known: csv, json, markdown")


#: Columns of a CSV export, in order. Fixed values.
CSV_COLUMNS = (
    "name", "section", "category", "task", "domain", "family", "subcategory", "framework", "architecture", "format", "storage_format", "parameters", "parameters_exact", "quantization", "precision", "context_length", "dataset_type", "modalities",
    "size_bytes", "size_human", "file_count", "images", "videos", "annotations", "classes", "splits", "health_score", "health_status", "health_findings", "drive", "root_folder", "path", "last_modified", "repo_id", "license", "tags",
)


def csv_rows(items: DataFrame) -> DataFrame:
    """items as the text columns of a CSV export; lists are joined by semicolons, columns that items lack are null."""
    kinds = {f.name: f.dataType.typeName() for f in items.schema}

    def of(column: str) -> Column:
        if column == "size_human" and column not in kinds and "size_bytes" in kinds:
            return format_bytes(F.col("size_bytes"))
        if column not in kinds:
            return F.lit(None).cast("string")
        return F.array_join(F.col(column).cast("array<string>"), ";") if kinds[column] == "array" else F.col(column).cast("string")

    return items.select(*[of(c).alias(c) for c in CSV_COLUMNS])
