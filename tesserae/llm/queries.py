"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, packing, pairs, provenance, ranking, repetition, splitting, syntax
from tesserae.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL where there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# Oversized items: the same rows in SQL, from lengths alone.
@query(
    "p2_found",
    """SELECT DISTINCT item_kind, item_id FROM (
         SELECT 'excerpt' AS item_kind, excerpt_id AS item_id, length(text) AS n FROM source_excerpts
         UNION ALL SELECT 'window', slice_id, length(text) FROM window_slices) JOIN size_limits USING (item_kind)
       WHERE n > max_size""",
)
def p2_found(spark, d):
    return splitting.oversized(table(spark, d, "source_excerpts"), table(spark, d, "window_slices"), table(spark, d, "size_limits"))


@query("p2_pieces")
def p2_pieces(spark, d):
    return splitting.pieces(table(spark, d, "source_excerpts"), table(spark, d, "window_slices"), table(spark, d, "size_limits"))


_RANKED = """
WITH main AS (
  SELECT query_id, element_id,
         max(CASE WHEN lexical_score IS NULL OR isnan(lexical_score) THEN 0 ELSE lexical_score END) AS lexical,
         max(CASE WHEN semantic_score IS NULL OR isnan(semantic_score) THEN 0 ELSE semantic_score END) AS semantic
  FROM primary_search_results GROUP BY ALL),
side AS (SELECT query_id, element_id, max(CASE WHEN rrf_score IS NULL OR isnan(rrf_score) THEN 0 ELSE rrf_score END) AS rrf FROM scored_candidates GROUP BY ALL),
scored AS (SELECT main.*, coalesce(rrf, 0) AS rrf FROM main LEFT JOIN side USING (query_id, element_id)),
opt AS (SELECT query_id, max(alpha) AS alpha FROM hybrid_search_options GROUP BY 1),
long AS (
  SELECT query_id, element_id, 'lexical' AS s, lexical AS v FROM scored
  UNION ALL SELECT query_id, element_id, 'semantic', semantic FROM scored
  UNION ALL SELECT query_id, element_id, 'rrf', rrf FROM scored),
placed AS (
  SELECT query_id, element_id, s,
         rank() OVER (PARTITION BY query_id, s ORDER BY v DESC) + (count(*) OVER (PARTITION BY query_id, s, v) - 1) / 2.0 AS place,
         CASE WHEN s = 'lexical' THEN a ELSE (1 - a) / 2 END AS w
  FROM long LEFT JOIN (SELECT query_id, greatest(0, least(1, coalesce(alpha, 0.5))) AS a FROM opt) USING (query_id)),
stepped AS (
  SELECT *, sum(w) OVER o - w / 2 AS mid FROM placed WINDOW o AS (PARTITION BY query_id, element_id ORDER BY place, w ROWS UNBOUNDED PRECEDING)),
pairs AS (
  SELECT *, lag(mid) OVER o AS mid0, lag(place) OVER o AS place0 FROM stepped WINDOW o AS (PARTITION BY query_id, element_id ORDER BY place, w)),
final AS (
  SELECT query_id, element_id,
         round(coalesce(min(CASE WHEN mid >= 0.5 AND (mid0 IS NULL OR mid0 < 0.5) THEN CASE WHEN mid0 IS NULL THEN place ELSE place0 + (place - place0) * (0.5 - mid0) / (mid - mid0) END END), max(place)), 6) AS median_place,
         round(sum(place * w), 6) AS mean_place
  FROM pairs GROUP BY ALL)
"""


_FIRST = "f AS (SELECT query_id, element_id, row_number() OVER (PARTITION BY query_id ORDER BY median_place, mean_place, element_id) AS r FROM final)"


@query("p6_found", _RANKED + ", " + _FIRST + " SELECT query_id, element_id FROM f WHERE r = 1 AND query_id IN (SELECT query_id FROM hybrid_search_options)")
def p6_found(spark, d):
    return ranking.first_candidates(table(spark, d, "primary_search_results"), table(spark, d, "scored_candidates"), table(spark, d, "hybrid_search_options"))


@query("p6_ranking", _RANKED + " SELECT query_id, element_id, round(median_place, 4) AS median_place, round(mean_place, 4) AS mean_place FROM final")
def p6_ranking(spark, d):
    ranked = ranking.median_rank(table(spark, d, "primary_search_results"), table(spark, d, "scored_candidates"), table(spark, d, "hybrid_search_options"))
    return ranked.select("query_id", "element_id", *[F.round(c, 4).alias(c) for c in ("median_place", "mean_place")])


@query("p7_ids")
def p7_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"))


@query("p7_round_trip", "SELECT 0::BIGINT AS n_changed, count(*) AS n_documents FROM documents")
def p7_round_trip(spark, d):
    documents = table(spark, d, "documents")
    back = bpe.decode(bpe.encode(documents.select("doc_id", "text"))).withColumnRenamed("text", "back")
    pairs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id")
    return pairs.agg(F.coalesce(F.sum((F.col("text") != F.col("back")).cast("bigint")), F.lit(0).cast("bigint")).alias("n_changed"), F.count("*").alias("n_documents"))


@query("p8_assigned")
def p8_assigned(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "size_limits"))


@query("p8_fill")
def p8_fill(spark, d):
    packed = p8_assigned(spark, d)
    capacity = packing.capacity_of(table(spark, d, "size_limits"), "container")
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_items"))
    return per.agg(
        F.count("*").alias("n_containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"), F.sum((F.col("used") < capacity).cast("bigint")).alias("n_not_full"),
    )


@query("p9_found")
def p9_found(spark, d):
    return repetition.repetitive(table(spark, d, "documents"))


@query("p9_shares")
def p9_shares(spark, d):
    return repetition.repetition(table(spark, d, "documents")).withColumn("repeated_share", F.round("repeated_share", 6)).withColumn("longest_share", F.round("longest_share", 6))


@query("p1_found")
def p1_found(spark, d):
    return pairs.defects(table(spark, d, "grounded_answers"))


@query("p1_counts")
def p1_counts(spark, d):
    return pairs.defects(table(spark, d, "grounded_answers")).groupBy("defect").agg(F.count("*").alias("n"))


@query("p4_found")
def p4_found(spark, d):
    return syntax.invalid_files(table(spark, d, "file_info"))


@query("p4_failures")
def p4_failures(spark, d):
    return syntax.failures(table(spark, d, "file_info"))


@query("p4_rates")
def p4_rates(spark, d):
    return syntax.rates(table(spark, d, "file_info"), table(spark, d, "parsed_files"))


@query("p5_found")
def p5_found(spark, d):
    return p5_origins(spark, d).select("file_id")


@query("p5_origins")
def p5_origins(spark, d):
    return provenance.origins(table(spark, d, "file_info"), table(spark, d, "library_files"))
