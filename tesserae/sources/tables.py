"""Question files, result files and configuration tables as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION_COLUMNS = ("question_id", "repo_name", "source", "taxonomy", "difficulty", "question_text", "expected_files", "expected_symbols", "expected_relationships", "expected_concepts")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Ten tab-separated columns without header, the last four lists separated by ``|``; lines that begin with ``#`` are comments."""
    ddl = ", ".join(f"{c} string" for c in QUESTION_COLUMNS)
    rows = spark.read.csv(path, sep="\t", comment="#", schema=ddl, quote="")
    return split_lists(rows)


def split_lists(rows: DataFrame) -> DataFrame:
    lists = [F.coalesce(F.filter(F.split(c, "[|]"), lambda x: x != ""), F.array().cast("array<string>")).alias(c) for c in QUESTION_COLUMNS[6:]]
    return rows.select(*QUESTION_COLUMNS[:6], *lists)


def questions_from_records(records: DataFrame) -> DataFrame:
    """Raw records ``c0 .. c9`` as questions, without cleaning their lists; repeated rows count once."""
    return records.dropDuplicates(["row_id"]).select("row_id", *[F.col(f"c{i}").alias(c) for i, c in enumerate(QUESTION_COLUMNS)])


def write_results(metrics: DataFrame, path: str, form: str = "json") -> None:
    """Metric rows with four decimals, as JSON lines or as CSV with a header."""
    rounded = metrics.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])
    writer = rounded.write.mode("overwrite")
    writer.json(path) if form == "json" else writer.csv(path, header=True)
