"""Relationship graph: edges ``source, target, kind`` with set semantics.

Traversal joins a frontier with the edges and drops what was visited, one job per level;
lineage is cut after each level. Neighbourhoods of hot nodes are never collected.

Defined results: an unknown start gives nothing; a self loop is one edge in both
directions; repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import cut

# Kinds in their order.
KINDS = ("Contains", "Imports", "Includes", "Calls", "References", "InheritsFrom", "Implements")
# Weights of kinds in expansion.
KIND_WEIGHT = {"Calls": 1.0, "Contains": 0.9, "InheritsFrom": 0.75, "Implements": 0.75, "References": 0.4, "Imports": 0.3, "Includes": 0.3}
# How a relationship reads in each direction.
PHRASES = {
    ("Contains", "out"): "Contains", ("Contains", "in"): "Contained In", ("Imports", "out"): "Imports", ("Imports", "in"): "Imported By", ("Includes", "out"): "Includes", ("Includes", "in"): "Included By",
    ("Calls", "out"): "Calls", ("Calls", "in"): "Called By", ("References", "out"): "References", ("References", "in"): "Referenced By", ("InheritsFrom", "out"): "Inherits From", ("InheritsFrom", "in"): "Inherited By",
    ("Implements", "out"): "Implements", ("Implements", "in"): "Implemented By",
}


def edge_set(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "kind").distinct()


def insert(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edge_set(edges.unionByName(more.select("source", "target", "kind")))


def remove(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti")


def remove_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of ``node``."""
    n = nodes.select("node")
    return edges.join(n, F.col("source") == F.col("node"), "left_anti").join(n, F.col("target") == F.col("node"), "left_anti")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


def counts_by_kind(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, n_out, n_in``."""
    out = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    inn = edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.union(inn).groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def neighbors(edges: DataFrame, starts: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """``node, neighbor`` distinct, of each ``node`` of ``starts``."""
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    a, b = ("source", "target") if direction == "out" else ("target", "source")
    return starts.select("node").distinct().join(edges.select(F.col(a).alias("node"), F.col(b).alias("neighbor")), "node").distinct()


#: Nodes of a frontier that are broadcast; beyond, a level is a shuffled join.
FRONTIER = 1_000_000
#: Parts a class of starts is joined in, so that a large one is no single task.
PARTS = 16


def _small(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a hint to broadcast them where they are few."""
    return F.broadcast(nodes) if nodes.limit(FRONTIER + 1).count() <= FRONTIER else nodes


def _classes(steps: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Starts with the same neighbours share all their ways: ``rep, root`` of each, and ``rep, node`` of the first step."""
    first = cut(steps.where("a <> b").join(_small(roots), F.col("a") == F.col("root")).select("root", F.col("b").alias("node")).distinct())
    alike = first.groupBy("root").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"h{seed}") for seed in (1, 2)])
    reps = alike.groupBy("n", "h1", "h2").agg(F.min("root").alias("rep"))
    member = cut(alike.join(reps, ["n", "h1", "h2"]).select("rep", "root"))
    return member, first.join(member.where("rep = root").select("root", "rep"), "root").select("rep", "node")


def bfs(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """``root, node, depth`` of everything within ``depth`` steps of each ``node`` of ``starts``, the start at depth 0.

    Starts are walked from once for all that have the same neighbours, and get what was
    reached at the end. Edges are read at each level and met by a broadcast frontier where
    it is small, so they are neither stored nor shuffled; they may hold rows repeated.
    """
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    steps = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    if direction == "in":
        steps = steps.select(F.col("b").alias("a"), F.col("a").alias("b"))
    elif direction == "both":
        steps = steps.union(steps.select("b", "a"))
    asked = _small(cut(starts.select("node").distinct()))
    roots = cut(steps.select(F.col("a").alias("node")).union(steps.select("b")).join(asked, "node").distinct()).withColumnRenamed("node", "root")
    begun = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    if depth < 1:
        return begun
    member, frontier = _classes(steps, roots)
    frontier = visited = cut(frontier.withColumn("depth", F.lit(1)))
    for level in range(2, depth + 1):
        at = cut(frontier.select(F.col("node").alias("a")).distinct())
        ways = cut(steps.join(_small(at), "a").distinct())  # of the frontier alone, each once
        fresh = frontier.join(ways, F.col("node") == F.col("a")).select("rep", F.col("b").alias("node")).distinct().join(visited, ["rep", "node"], "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    n = max(24, 2 * edges.sparkSession.sparkContext.defaultParallelism)
    rows = visited.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS))).repartition(n, "rep", "part")
    owners = member.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint")))).repartition(n, "rep", "part")
    return begun.union(owners.hint("merge").join(rows, ["rep", "part"]).where("root <> node").select("root", "node", "depth"))


def reachable(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """Nodes reached from each start, the start itself left out."""
    return bfs(edges, starts, depth, direction).where("depth > 0")


def callers(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbors(edges, starts, "in", ["Calls"])


def callees(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbors(edges, starts, "out", ["Calls"])


def parents(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbors(edges, starts, "in", ["Contains"])


def children(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbors(edges, starts, "out", ["Contains"])


def base_types(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbors(edges, starts, "out", ["InheritsFrom", "Implements"])


def derived_types(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbors(edges, starts, "in", ["InheritsFrom", "Implements"])


def dependencies(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    return reachable(edges.where(F.col("kind").isin("Imports", "Includes", "Calls", "References")), starts, depth)


def dependents(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    return reachable(edges.where(F.col("kind").isin("Imports", "Includes", "Calls", "References")), starts, depth, "in")


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``node``."""
    n = chosen.select("node").distinct()
    return edges.join(n, F.col("source") == F.col("node"), "left_semi").join(n, F.col("target") == F.col("node"), "left_semi")


def neighborhood(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Edges among the nodes within ``depth`` steps of any start."""
    return edge_set(induced(edges, bfs(edges, starts, depth, "both").select("node")))


def call_graph(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    calls = edges.where("kind = 'Calls'")
    return edge_set(induced(calls, bfs(calls, starts, depth, "both").select("node")))


def type_hierarchy(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    types = edges.where("kind IN ('InheritsFrom', 'Implements')")
    return edge_set(induced(types, bfs(types, starts, depth, "both").select("node")))


def phrase(kind: Column, direction: Column) -> Column:
    """How a relationship reads: "Calls →", "Called By ←"."""
    pairs = [x for (k, d), text in PHRASES.items() for x in (F.lit(f"{k}/{d}"), F.lit(f"{text} {'→' if d == 'out' else '←'}"))]
    return F.create_map(*pairs)[F.concat_ws("/", kind, direction)]


def top_relationships(edges: DataFrame, starts: DataFrame, elements: DataFrame, n: int = 5) -> DataFrame:
    """Per start, direction and kind the first ``n`` neighbours by path, name and id: ``node, direction, kind, neighbor, pos``."""
    out = edges.select(F.col("source").alias("node"), F.lit("out").alias("direction"), "kind", F.col("target").alias("neighbor"))
    inn = edges.select(F.col("target").alias("node"), F.lit("in").alias("direction"), "kind", F.col("source").alias("neighbor"))
    both = out.union(inn).distinct().join(starts.select("node").distinct(), "node", "left_semi")
    named = both.join(elements.select(F.col("element_id").alias("neighbor"), "file_path", "name"), "neighbor", "left")
    order = Window.partitionBy("node", "direction", "kind").orderBy(F.asc_nulls_last("file_path"), F.asc_nulls_last("name"), F.asc("neighbor"))
    return named.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n).select("node", "direction", "kind", "neighbor", "pos")


def expansion_scores(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``seed, node, depth, score``: the best path score of each node within ``depth`` undirected steps of a seed.

    Each step weighs its kind, incoming ones 0.95 of it; the last step's weight is divided
    by the square of the depth, and a tenth of the seed's score is added.
    """
    weight = F.create_map(*[F.lit(x) for kv in KIND_WEIGHT.items() for x in kv])[F.col("kind")]
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), weight.alias("w"))
    inn = edges.select(F.col("target").alias("a"), F.col("source").alias("b"), (weight * 0.95).alias("w"))
    steps = cut(out.union(inn).groupBy("a", "b").agg(F.max("w").alias("w")))  # planned once, not at each level
    frontier = seeds.select(F.col("node").alias("seed"), "node", F.col("score").alias("seed_score")).distinct()
    visited = frontier.select("seed", "node")
    found = None
    for level in range(1, depth + 1):
        step = frontier.join(steps, F.col("node") == F.col("a")).groupBy("seed", "seed_score", F.col("b").alias("n")).agg(F.max("w").alias("w"))
        fresh = cut(step.select("seed", F.col("n").alias("node"), "seed_score", "w").join(visited, ["seed", "node"], "left_anti"))
        scored = fresh.select("seed", "node", F.lit(level).alias("depth"), F.round(F.col("w") / (level * level) + 0.1 * F.col("seed_score"), 6).alias("score"))
        found = scored if found is None else found.union(scored)
        frontier = fresh.select("seed", "node", "seed_score")
        visited = visited.union(fresh.select("seed", "node"))
    return found


def greedy_budget(items: DataFrame, group: str, order: list[Column], size: str, budget: int, most: int) -> DataFrame:
    """Items of each group that a greedy pass takes: in order, at most ``most``, the sizes within ``budget``.

    The first item is always taken; an item that does not fit is skipped, later ones may
    still fit. Which items are taken depends on those before, so the pass is a fold over
    each group's items in order. Groups are result lists of bounded length.
    """
    listed = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(size).cast("bigint").alias("size"), F.struct("*").alias("row")))).alias("l"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))
    fold = F.aggregate(
        "l",
        start,
        lambda s, x: F.struct(
            (s["used"] + F.when((F.size(s["kept"]) < most) & ((F.size(s["kept"]) == 0) | (s["used"] + x["size"] <= budget)), x["size"]).otherwise(F.lit(0).cast("bigint"))).alias("used"),
            F.when((F.size(s["kept"]) < most) & ((F.size(s["kept"]) == 0) | (s["used"] + x["size"] <= budget)), F.concat(s["kept"], F.array(s["i"]))).otherwise(s["kept"]).alias("kept"),
            (s["i"] + 1).alias("i"),
        ),
        lambda s: s["kept"],
    )
    taken = listed.withColumn("kept", fold).select("l", F.posexplode("kept").alias("pos", "i"))
    return taken.select((F.col("pos") + 1).alias("pos"), F.col("l")[F.col("i")]["row"].alias("r")).select("r.*", "pos")


def memory_estimate(edges: DataFrame) -> DataFrame:
    """One row ``n_nodes, n_edges, bytes``: 340 bytes a node and 170 an edge."""
    n = nodes(edges).agg(F.count("*").alias("n_nodes"))
    return n.crossJoin(edge_set(edges).agg(F.count("*").alias("n_edges"))).withColumn("bytes", F.col("n_nodes") * 340 + F.col("n_edges") * 170)
