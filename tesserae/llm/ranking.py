"""One ranking from several differently-scaled scores: weighted median rank aggregation.

Every candidate gets its place in each score among the candidates of its query (higher
scores first, equal scores share the mean of their places), which frees the scores of
their scales. The lexical score weighs ``alpha``, the others share the rest. Candidates are
ordered by the weighted median of their places, then by the weighted mean place, then by
identifier. A weighted median that only picks one of three places obeys the lexical score
alone as soon as ``alpha`` reaches one half; so the median is interpolated, as medians of
grouped data are: each place stands at the middle of its weight, and the median is read
where one half of the weight is reached.

A query may hold a third of all rows. Queries of at least ``hot_rows`` rows and of at least
a thousandth of all rows, which are a thousand at most, go another way with the same
result: their distinct scores are parted by range over the tasks, counted within a part,
and the parts' counts give the offset; scores that many rows share are broadcast to them.

Defined results: a null, NaN or absent score counts as 0; ``alpha`` null means 0.5 and is
clamped to [0, 1]; repeated candidates count once with their greatest scores; a query
without candidates gives no row, candidates of a query without options are ranked by 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import bounded_rows, cut

SCORES = ("lexical", "semantic", "rrf")
IDS = ("query_id", "element_id")
#: Rows from which a query, and a score within a query, is treated as hot where that is also a thousandth of all rows.
HOT_ROWS = 1_000_000


def _number(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)


def window_places(scored: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """Adds ``place_s`` for each score ``s``: all windows share the one shuffle by query."""
    for s in scores:
        own = Window.partitionBy("query_id").orderBy(F.desc(s))
        last = F.round(F.cume_dist().over(own) * F.count(F.lit(1)).over(Window.partitionBy("query_id")))
        scored = scored.withColumn(f"place_{s}", (F.rank().over(own) + last) / 2)
    return scored


def ranged_places(scored: DataFrame, least: int, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """As ``window_places`` for queries of any size: no task sees all rows of a query or of a score.

    ``least`` is the number of rows from which a score is broadcast with its place; at most
    ``len(scores)`` times the rows over ``least`` scores can have so many.
    """
    keys = ["query_id", "score_name", "score"]
    listed = F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).alias("score")) for s in scores]))
    long = scored.select(*IDS, listed.alias("s")).select(*IDS, "s.*")
    values = long.groupBy(*keys).agg(F.count("*").alias("n"))
    parted = cut(values.repartitionByRange("query_id", "score_name", F.desc("score")).withColumn("part", F.spark_partition_id()))
    per = parted.groupBy("query_id", "score_name", "part").agg(F.sum("n").alias("part_n"))
    before = F.sum("part_n").over(Window.partitionBy("query_id", "score_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a query and score for each of the hot queries, and one more for each task: never many
    offsets = F.broadcast(per.select("query_id", "score_name", "part", F.coalesce(before, F.lit(0)).alias("before")))
    inside = F.sum("n").over(Window.partitionBy("query_id", "score_name", "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    placed = cut(
        parted.withColumn("own", F.coalesce(inside, F.lit(0))).join(offsets, ["query_id", "score_name", "part"])
        .select(*keys, "n", (F.col("before") + F.col("own") + (F.col("n") + 1) / 2).alias("place"))
    )
    frequent = F.broadcast(placed.where(F.col("n") >= least).drop("n"))
    rest = long.join(frequent, keys, "left_anti").join(placed.where(F.col("n") < least).drop("n"), keys)
    both = long.join(frequent, keys).unionByName(rest)
    return both.groupBy(*IDS).agg(*[F.max(F.when(F.col("score_name") == s, F.col("place"))).alias(f"place_{s}") for s in scores])


def _median(places: list[Column], weights: list[Column]) -> Column:
    """The weighted median of a few places, interpolated between the middles of their weights."""
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    return F.aggregate(
        F.array_sort(F.array(*[F.struct(p.alias("place"), w.alias("weight")) for p, w in zip(places, weights, strict=True)])),
        F.struct(zero.alias("w"), none.alias("mid"), zero.alias("at"), none.alias("m")),
        lambda s, x: F.struct(
            (s["w"] + x["weight"]).alias("w"),
            (s["w"] + x["weight"] / 2).alias("mid"),
            x["place"].alias("at"),
            F.when(s["m"].isNotNull() | (s["w"] + x["weight"] / 2 < 0.5), s["m"])
            .when(s["mid"].isNull(), x["place"])
            .otherwise(s["at"] + (x["place"] - s["at"]) * (0.5 - s["mid"]) / (s["w"] + x["weight"] / 2 - s["mid"]))
            .alias("m"),
        ),
        lambda s: F.coalesce(s["m"], s["at"]),
    )


def median_rank(candidates: DataFrame, others: DataFrame, options: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``query_id, element_id, median_place, mean_place`` of every candidate."""
    main = candidates.select(*IDS, _number("lexical_score").alias("lexical"), _number("semantic_score").alias("semantic"))
    main = main.groupBy(*IDS).agg(F.max("lexical").alias("lexical"), F.max("semantic").alias("semantic"))
    side = others.select(*IDS, _number("rrf_score").alias("rrf")).groupBy(*IDS).agg(F.max("rrf").alias("rrf"))
    scored = main.join(side, list(IDS), "left").fillna(0.0, ["rrf"])
    alpha = options.groupBy("query_id").agg(F.max("alpha").alias("alpha"))
    least = max(hot_rows, candidates.count() // 1000)
    hot = [r[0] for r in bounded_rows(candidates.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id"), 1_000_000)]
    cold = scored.where(~F.col("query_id").isin(hot)) if hot else scored
    placed = window_places(cold).select(*IDS, *[f"place_{s}" for s in SCORES]).join(alpha, "query_id", "left")
    if hot:
        own = F.col("query_id").isin(hot)
        placed = placed.unionByName(ranged_places(cut(scored.where(own)), least).join(F.broadcast(alpha.where(own)), "query_id", "left"))
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("alpha").isNull() | F.isnan("alpha"), 0.5).otherwise(F.col("alpha"))))
    places, weights = [F.col(f"place_{s}") for s in SCORES], [a, (1 - a) / 2, (1 - a) / 2]
    mean = sum((p * w for p, w in zip(places, weights, strict=True)), F.lit(0.0))
    return placed.select(*IDS, F.round(_median(places, weights), 6).alias("median_place"), F.round(mean, 6).alias("mean_place"))


def first_candidates(candidates: DataFrame, others: DataFrame, options: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first candidate of each query with options: ``query_id, element_id``."""
    ranked = median_rank(candidates, others, options, hot_rows)
    best = ranked.groupBy("query_id").agg(F.min_by("element_id", F.struct("median_place", "mean_place", "element_id")).alias("element_id"))
    return best.join(options.select("query_id").distinct(), "query_id", "left_semi")
