"""Normalising and fusing the lexical and the semantic channel of a batch of queries.

Candidates have ``query_id, element_id`` and per channel a score and a rank (null or 0
where the channel missed the element).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _scaled(value: Column, low: Column, high: Column) -> Column:
    span = high - low
    return F.when(value.isNull(), 0.0).when(span < 1e-9, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / span)))


def min_max(df: DataFrame, scores: dict[str, tuple[str, Column | None]], group: str = "query_id") -> DataFrame:
    """Adds for each ``out: (score, present)`` the score scaled to [0, 1] within its group.

    All 1 where the range is below 1e-9, so also for a single value; values that are not
    finite, or not present, are left out of the range and give 0. Least and greatest of all
    scores are aggregated in one pass and joined back, so a hot group needs no window over
    all its rows.
    """
    values = {out: finite(F.col(c)) if present is None else F.when(present, finite(F.col(c))) for out, (c, present) in scores.items()}
    ends = df.groupBy(group).agg(*[f(v).alias(f"_{n}_{out}") for out, v in values.items() for n, f in (("low", F.min), ("high", F.max))])
    joined = df.join(ends, group)
    for out, v in values.items():
        joined = joined.withColumn(out, _scaled(v, F.col(f"_low_{out}"), F.col(f"_high_{out}")))
    return joined.drop(*[f"_{n}_{out}" for out in values for n in ("low", "high")])


def weighted(lexical: Column, semantic: Column, alpha: Column) -> Column:
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha))
    return a * F.coalesce(lexical, F.lit(0.0)) + (1 - a) * F.coalesce(semantic, F.lit(0.0))


def reciprocal(rank: Column, k: Column) -> Column:
    """1 / (k + rank); 0 where the channel missed; k of 0 or less means 60."""
    kk = F.when(k.isNull() | (k <= 0), 60.0).otherwise(k)
    return F.when(rank.isNotNull() & (rank > 0), 1 / (kk + rank)).otherwise(0.0)


def candidates(results: DataFrame) -> DataFrame:
    """One row per candidate with normalised scores; repeated rows count once."""
    one = results.groupBy("query_id", "element_id").agg(
        F.max(finite(F.col("lexical_score"))).alias("lexical_score"), F.max(finite(F.col("semantic_score"))).alias("semantic_score"),
        F.max("lexical_rank").alias("lexical_rank"), F.max("semantic_rank").alias("semantic_rank"),
    )
    return min_max(one, {"norm_lexical": ("lexical_score", F.col("lexical_rank") > 0), "norm_semantic": ("semantic_score", F.col("semantic_rank") > 0)})


def ranked(df: DataFrame, score: Column, k: int | None = None, extra: list[str] | None = None) -> DataFrame:
    """Adds ``hybrid_score`` and ``rank`` by score, presence in the lexical channel and id."""
    keys = ["query_id", *(extra or [])]
    out = df.withColumn("hybrid_score", F.round(score, 9))
    order = Window.partitionBy(*keys).orderBy(F.desc("hybrid_score"), F.desc(F.coalesce(F.col("lexical_rank"), F.lit(0)) > 0), F.asc("element_id"))
    out = out.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def fuse_weighted(results: DataFrame, alpha: Column, k: int | None = None) -> DataFrame:
    return ranked(candidates(results), weighted(F.col("norm_lexical"), F.col("norm_semantic"), alpha), k)


def fuse_reciprocal(results: DataFrame, kk: Column, k: int | None = None) -> DataFrame:
    return ranked(candidates(results), reciprocal(F.col("lexical_rank"), kk) + reciprocal(F.col("semantic_rank"), kk), k)


def fuse_by_options(results: DataFrame, options: DataFrame) -> DataFrame:
    """Each query by its own method, alpha, k and number of results."""
    method = F.lower(F.regexp_replace(F.coalesce("fusion_method", F.lit("weighted")), "[^A-Za-z]", ""))
    chosen = options.groupBy("query_id").agg(
        F.max(method).alias("method"), F.max(F.coalesce("alpha", F.lit(0.5))).alias("alpha"), F.max("rrf_k").alias("rrf_k"), F.max(F.coalesce("max_results", F.lit(20))).alias("max_results")
    )
    rows = candidates(results).join(chosen, "query_id")
    score = F.when(F.col("method").startswith("recip") | (F.col("method") == "rrf"), reciprocal(F.col("lexical_rank"), F.col("rrf_k")) + reciprocal(F.col("semantic_rank"), F.col("rrf_k"))).otherwise(
        weighted(F.col("norm_lexical"), F.col("norm_semantic"), F.col("alpha"))
    )
    return ranked(rows, score).where(F.col("rank") <= F.col("max_results"))


def strategies() -> list[tuple[str, float | None, float | None]]:
    """Name, alpha and k of each strategy of the sweep."""
    return [(f"alpha_{a / 10:.1f}", a / 10, None) for a in range(11)] + [(f"rrf_{k}", None, float(k)) for k in (10, 20, 60)]


def sweep(results: DataFrame, k: int) -> DataFrame:
    """All strategies in one job: ``strategy, query_id, element_id, rank`` of the first ``k``."""
    listed = F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(a).cast("double").alias("alpha"), F.lit(r).cast("double").alias("rrf_k")) for n, a, r in strategies()])
    rows = candidates(results).select("*", F.explode(listed).alias("s")).select("*", "s.*").drop("s")
    score = F.when(F.col("alpha").isNotNull(), weighted(F.col("norm_lexical"), F.col("norm_semantic"), F.col("alpha"))).otherwise(
        reciprocal(F.col("lexical_rank"), F.col("rrf_k")) + reciprocal(F.col("semantic_rank"), F.col("rrf_k"))
    )
    return ranked(rows, score, k, ["strategy"]).select("strategy", "query_id", "element_id", "rank")


def merge_lists(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (1.0, 0.5), k: float = 60.0) -> DataFrame:
    """Two ranked lists of the same queries: ``query_id, element_id, score, provenance, rank``."""
    both = first.select("query_id", "element_id", F.lit(1).alias("list"), (F.lit(weights[0]) / (F.lit(k) + F.col("rank"))).alias("s")).unionByName(
        second.select("query_id", "element_id", F.lit(2).alias("list"), (F.lit(weights[1]) / (F.lit(k) + F.col("rank"))).alias("s"))
    )
    merged = both.groupBy("query_id", "element_id").agg(F.round(F.sum("s"), 9).alias("score"), F.min("list").alias("a"), F.max("list").alias("b"))
    kind = F.when(F.col("a") != F.col("b"), "both_queries").when(F.col("a") == 1, "original_query").otherwise("expanded_query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("element_id"))
    return merged.select("query_id", "element_id", "score", kind.alias("provenance")).withColumn("rank", F.row_number().over(order))


def dual_channel(first: DataFrame, second: DataFrame, how: str = "rrf", weight: float = 0.5, k: float = 60.0) -> DataFrame:
    """Two vector channels ``query_id, vec_id, similarity, rank`` as one ranking, by reciprocal ranks or by scaled similarities: ``query_id, vec_id, score, rank``."""
    if how not in ("rrf", "linear"):
        raise ValueError(f"no fusion {how}")
    a, b = first, second
    if how == "linear":
        a, b = (min_max(x, {"scaled": ("similarity", None)}) for x in (first, second))
        part = lambda w: F.lit(w) * F.col("scaled")
    else:
        part = lambda w: F.lit(w) / (F.lit(k) + F.col("rank"))
    both = a.select("query_id", "vec_id", part(weight).alias("s")).unionByName(b.select("query_id", "vec_id", part(1 - weight).alias("s")))
    merged = both.groupBy("query_id", "vec_id").agg(F.round(F.sum("s"), 9).alias("score"))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))))


#: Channels a routing policy sends an intent to: the weight of the lexical channel.
POLICIES = {"always_both": {}, "symbols_lexical": {"ExactSymbol": 1.0, "FileOrDirectory": 1.0}, "concepts_semantic": {"Conceptual": 0.0, "Behavioral": 0.0}}


def route(intent: Column, policy: str, default: float = 0.5) -> Column:
    """Weight of the lexical channel of an intent under a policy."""
    chosen = POLICIES[policy]
    out = F.lit(default)
    for name, weight in chosen.items():
        out = F.when(intent == name, F.lit(weight)).otherwise(out)
    return out
