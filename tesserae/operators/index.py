"""Inverted index over elements: set postings, lengths and statistics, all as tables.

An element has ``element_id, name, parent_context, detail, file_path`` and any other
columns. A posting is one (term, element); the length of an element is the sum of the
token counts of its fields, each field counting a token once.

Defined results: null fields have no tokens; an element without tokens has length 0; rows
repeated with the same id count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import identifier_tokens, path_tokens

FIELDS = ("name", "context", "detail", "path")


def field_tokens() -> dict[str, Column]:
    return {"name": identifier_tokens(F.col("name")), "context": identifier_tokens(F.col("parent_context")), "detail": identifier_tokens(F.col("detail")), "path": path_tokens(F.col("file_path"))}


def file_elements(files: DataFrame) -> DataFrame:
    """One element per file: its name is that of the file, its context the repository, its detail the ending."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        F.col("file_id").alias("element_id"),
        F.regexp_replace(base, r"\.[^.]*$", "").alias("name"),
        F.col("repo_name").alias("parent_context"),
        F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1)).alias("detail"),
        F.col("path").alias("file_path"),
    ).distinct()


SQL_ELEMENTS = r"""elements AS (
  SELECT DISTINCT file_id AS element_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS name, repo_name AS parent_context,
         lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\.([^.]*)$', 1)) AS detail, path AS file_path
  FROM file_info)"""


def occurrences(elements: DataFrame) -> DataFrame:
    """``element_id, field, term``: each token of each field once."""
    fields = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("terms")) for k, v in field_tokens().items()]))
    return elements.select("element_id", fields.alias("f")).select("element_id", "f.field", F.explode("f.terms").alias("term"))


def postings(elements: DataFrame) -> DataFrame:
    """``term, element_id, tf, fields``: tf is the number of fields that hold the term."""
    return occurrences(elements).groupBy("term", "element_id").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_set("field")).alias("fields"))


def lengths(elements: DataFrame) -> DataFrame:
    """``element_id, length``, without a shuffle."""
    total = sum((F.size(v) for v in field_tokens().values()), F.lit(0))
    return elements.select("element_id", total.alias("length"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def lookup(posted: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given terms."""
    return posted.join(terms.select("term").distinct(), "term", "left_semi")


def statistics(elements: DataFrame, posted: DataFrame) -> DataFrame:
    """One row: ``n_elements, n_terms, n_postings, avg_length``."""
    size = lengths(elements).agg(F.count("*").alias("n_elements"), F.round(F.avg("length"), 6).alias("avg_length"))
    per = document_frequency(posted).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return size.crossJoin(per)
