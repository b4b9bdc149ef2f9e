"""Evaluation of ranked lists: precision, recall, reciprocal rank, NDCG, hit rates, outcomes.

A run has ``query_id, item, rank``; judgements have ``query_id, item, grade`` (0 or less is
not relevant). Queries without relevant items have zeros. By default an item counts once per
query, at its first rank; ``count_duplicates`` counts each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def graded(run: DataFrame, judged: DataFrame, count_duplicates: bool = False) -> DataFrame:
    rows = run if count_duplicates else run.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    grades = judged.groupBy("query_id", "item").agg(F.max("grade").alias("grade"))
    return rows.select("query_id", "item", "rank").join(grades, ["query_id", "item"], "left").fillna(0, ["grade"])


def ranking_metrics(run: DataFrame, judged: DataFrame, count_duplicates: bool = False) -> DataFrame:
    """``query_id, p1, p3, p5, p10, r5, r10, mrr, ndcg5, ndcg10`` for every judged query."""
    good = F.col("grade") > 0
    hit = lambda k: F.sum((good & (F.col("rank") <= k)).cast("int"))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    dcg = lambda k: F.sum(F.when(good & (F.col("rank") <= k), gain).otherwise(0.0))
    rows = graded(run, judged, count_duplicates)
    own = rows.groupBy("query_id").agg(*[hit(k).alias(f"h{k}") for k in (1, 3, 5, 10)], F.min(F.when(good, F.col("rank"))).alias("first"), dcg(5).alias("d5"), dcg(10).alias("d10"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    ideal = judged.groupBy("query_id", "item").agg(F.max("grade").alias("grade")).where("grade > 0").withColumn("rank", F.row_number().over(order))
    best = ideal.groupBy("query_id").agg(F.count("*").alias("n"), dcg(5).alias("i5"), dcg(10).alias("i10"))
    joined = judged.select("query_id").distinct().join(own, "query_id", "left").join(best, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "query_id",
        *[F.round(z(F.col(f"h{k}") / k), 6).alias(f"p{k}") for k in (1, 3, 5, 10)],
        *[F.round(z(F.col(f"h{k}") / F.col("n")), 6).alias(f"r{k}") for k in (5, 10)],
        F.round(z(1 / F.col("first")), 6).alias("mrr"),
        *[F.round(z(F.when(F.col(f"i{k}") > 0, F.col(f"d{k}") / F.col(f"i{k}"))), 6).alias(f"ndcg{k}") for k in (5, 10)],
    )


def averages(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c != "query_id"])


def hit_rates(first_ranks: DataFrame) -> DataFrame:
    """One row of Hit@{1,5,10,20,50} and MRR from ``rank`` (0 a miss, -1 a negative query that is left out)."""
    real = first_ranks.where("rank >= 0")
    hits = [F.round(F.avg(((F.col("rank") > 0) & (F.col("rank") <= k)).cast("int")), 6).alias(f"hit{k}") for k in (1, 5, 10, 20, 50)]
    return real.agg(F.count("*").alias("n_queries"), *hits, F.round(F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"))


def path_matches(found: Column, expected: Column) -> Column:
    """Same path, one a suffix of the other, one inside the other, or the same file name."""
    a, b = F.lower(F.regexp_replace(found, r"\\", "/")), F.lower(F.regexp_replace(expected, r"\\", "/"))
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    return (F.length(b) > 0) & ((a == b) | a.endswith(b) | b.endswith(a) | a.contains(b) | (name(a) == name(b)))


def symbol_matches(found: Column, expected: Column) -> Column:
    a, b = F.lower(found), F.lower(expected)
    return (F.length(b) > 0) & ((a == b) | a.contains(b) | b.contains(a))


def outcome(error: Column, retrieved: Column, sufficient: Column) -> Column:
    """Kind of failure of a question, or ``none``."""
    return F.when(error, "reasoning_failure").when(~retrieved & ~sufficient, "retrieval_failure").when(~retrieved, "groundedness_failure").when(~sufficient, "sufficiency_failure").otherwise("none")


def channel_overlap(results: DataFrame, k: int = 10) -> DataFrame:
    """Per query how many of the first ``k`` of each channel the other has as well."""
    one = results.groupBy("query_id", "element_id").agg(F.max("lexical_rank").alias("lr"), F.max("semantic_rank").alias("sr"))
    lex, sem = (F.col("lr") > 0) & (F.col("lr") <= k), (F.col("sr") > 0) & (F.col("sr") <= k)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return one.groupBy("query_id").agg(n(lex & sem).alias("n_both"), n(lex & ~F.coalesce(sem, F.lit(False))).alias("n_lexical_only"), n(sem & ~F.coalesce(lex, F.lit(False))).alias("n_semantic_only"))


def diversity(results: DataFrame) -> DataFrame:
    """Per query the number of files among its candidates and the most candidates of one file."""
    per = results.select("query_id", "element_id", "file_path").distinct().groupBy("query_id", "file_path").agg(F.count("*").alias("n"))
    return per.groupBy("query_id").agg(F.count("*").alias("n_files"), F.max("n").alias("most_of_one_file"), F.sum("n").alias("n_candidates"))
