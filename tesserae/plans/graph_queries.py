"""Queries of vectors and of the relationship graph, with their SQL.

The graph of the test tables: nations inherit from regions and contain customers, orders
reference customers and call parts, suppliers include nations and parts import suppliers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import expansion as X
from tesserae.operators import fusion as H
from tesserae.operators import graph as J
from tesserae.operators import tools as L
from tesserae.operators import vectors as G
from tesserae.plans.registry import query
from tesserae.session import table

# Vectors

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
_PAIRS = f"pairs AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS ql, v.label AS vl, {_COS} AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"
_RANK = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM pairs)"


def _vectors(spark, d):
    return table(spark, d, "embeddings")


@query("cosine_to_first", "SELECT v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id = 0")
def cosine_to_first(spark, d):
    first = _vectors(spark, d).where("vec_id = 0").select(F.col("embedding").alias("q"))
    return _vectors(spark, d).crossJoin(F.broadcast(first.limit(1))).select("vec_id", F.round(G.cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))


@query("knn_exact", f"WITH {_PAIRS}, {_RANK} SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10")
def knn_exact(spark, d):
    return G.knn_exact(_vectors(spark, d), G.query_set(_vectors(spark, d)), 10)


@query("knn_min_similarity", f"WITH {_PAIRS}, {_RANK} SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10 AND similarity >= 0.3")
def knn_min_similarity(spark, d):
    return G.knn_exact(_vectors(spark, d), G.query_set(_vectors(spark, d)), 10, 0.3)


@query("knn_label_precision", f"WITH {_PAIRS}, {_RANK} SELECT ql AS label, round(avg((ql = vl)::INT), 6) AS precision FROM r WHERE rank <= 10 GROUP BY 1")
def knn_label_precision(spark, d):
    v = _vectors(spark, d).select("vec_id", "label")
    near = G.knn_exact(_vectors(spark, d), G.query_set(_vectors(spark, d)), 10)
    both = near.join(v.withColumnRenamed("label", "vl"), "vec_id").join(v.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return both.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("vl")).cast("int")), 6).alias("precision"))


_HALVES = """v AS (SELECT vec_id, any_value(embedding)::DOUBLE[] AS e FROM embeddings GROUP BY 1),
sims AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_cosine_similarity(q.e[1:32], x.e[1:32]), 6) AS a, round(list_cosine_similarity(q.e[33:64], x.e[33:64]), 6) AS b FROM v q, v x WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, vec_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, vec_id) AS rb FROM sims),
both_ AS (SELECT query_id, vec_id, CASE WHEN ra <= 50 THEN 0.5 / (60 + ra) ELSE 0 END + CASE WHEN rb <= 50 THEN 0.5 / (60 + rb) ELSE 0 END AS s FROM ranks WHERE ra <= 50 OR rb <= 50),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id)::INT AS rank FROM both_)"""


# Halves of the vectors stand for two models.
@query("dual_channel", f"WITH {_HALVES} SELECT query_id, vec_id, rank FROM r WHERE rank <= 10")
def dual_channel(spark, d):
    half = lambda at: _vectors(spark, d).select("vec_id", F.slice("embedding", at, 32).alias("embedding"))
    one, two = (G.knn_exact(x, G.query_set(x), 50) for x in (half(1), half(33)))
    return H.dual_channel(one, two).where("rank <= 10").select("query_id", "vec_id", "rank")


@query("index_lifecycle", "SELECT 'built' AS step, count(*) AS n_vectors FROM embeddings UNION ALL SELECT 'replaced', count(*) FROM embeddings UNION ALL SELECT 'removed', count(*) FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT 'valid', count(*) FROM embeddings WHERE len(embedding) = 64")
def index_lifecycle(spark, d):
    index = _vectors(spark, d).select("vec_id", "embedding")
    steps = {"built": index, "replaced": G.upsert(index, index.where("vec_id % 7 = 0")), "removed": G.remove(index, index.where("vec_id % 5 = 0")), "valid": G.valid(index, 64)}
    counted = [f.agg(F.count("*").alias("n_vectors")).select(F.lit(k).alias("step"), "n_vectors") for k, f in steps.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query("ann_search")
def ann_search(spark, d):
    return G.knn_approximate(_vectors(spark, d), G.query_set(_vectors(spark, d)), 10)


@query("ann_recall")
def ann_recall(spark, d):
    queries = G.query_set(_vectors(spark, d))
    return G.recall(G.knn_exact(_vectors(spark, d), queries, 10), G.knn_approximate(_vectors(spark, d), queries, 10))


@query("hash_embedding")
def hash_embedding(spark, d):
    return G.hash_embed(table(spark, d, "hybrid_search_options").select("query_id", F.col("query_text").alias("text")), "query_id")


@query("hash_embedding_norms", "SELECT query_id, round(CASE WHEN len(regexp_extract_all(lower(coalesce(query_text, '')), '[a-z0-9_]+')) > 0 THEN 1.0 ELSE 0.0 END, 3) AS norm FROM hybrid_search_options")
def hash_embedding_norms(spark, d):
    return hash_embedding(spark, d).select("query_id", F.round(F.sqrt(G.dot(F.col("embedding"), F.col("embedding"))), 3).alias("norm"))


@query("vector_memory", "SELECT count(*) AS n_vectors, sum(len(embedding) * 4 + 48)::BIGINT AS bytes FROM embeddings")
def vector_memory(spark, d):
    return G.memory_estimate(_vectors(spark, d))


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000000, -1 FROM embeddings WHERE vec_id % 7 = 0")
def vector_upsert(spark, d):
    index = _vectors(spark, d).select("vec_id", "label")
    changed = index.where("vec_id % 7 = 0").withColumn("label", F.lit(-1))
    return G.upsert(index, changed.union(changed.select(F.col("vec_id") + 1000000000, "label")))


# Graph

_EDGES = """edges AS (
  SELECT DISTINCT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'InheritsFrom' AS kind FROM nation
  UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'Contains' FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'Includes' FROM supplier
  UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'References' FROM orders
  UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'Calls' FROM lineitem
  UNION SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'Imports' FROM lineitem)"""


def _edge_rows(spark, d):
    """The edges as their tables give them, repeated ones included."""

    def part(name, a, ca, b, cb, kind):
        return table(spark, d, name).select(F.concat(F.lit(a + ":"), F.col(ca)).alias("source"), F.concat(F.lit(b + ":"), F.col(cb)).alias("target"), F.lit(kind).alias("kind"))

    parts = [
        part("nation", "nation", "n_nationkey", "region", "n_regionkey", "InheritsFrom"), part("customer", "nation", "c_nationkey", "customer", "c_custkey", "Contains"),
        part("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "Includes"), part("orders", "order", "o_orderkey", "customer", "o_custkey", "References"),
        part("lineitem", "order", "l_orderkey", "part", "l_partkey", "Calls"), part("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "Imports"),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return edges


def _edges(spark, d):
    return J.edge_set(_edge_rows(spark, d))


def _regions(spark, d):
    return table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("node"))


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node"))


@query("edge_counts_by_kind", f"WITH {_EDGES} SELECT kind, count(*) AS n_edges FROM edges GROUP BY 1")
def edge_counts_by_kind(spark, d):
    return J.counts_by_kind(_edges(spark, d))


@query("node_degrees", f"WITH {_EDGES}, u AS (SELECT source AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM u GROUP BY 1")
def node_degrees(spark, d):
    return J.degrees(_edges(spark, d))


@query("neighbors_out", f"WITH {_EDGES} SELECT DISTINCT source AS node, target AS neighbor FROM edges WHERE source LIKE 'supplier:%'")
def neighbors_out(spark, d):
    return J.neighbors(_edges(spark, d), _suppliers(spark, d))


@query("neighbors_in", f"WITH {_EDGES} SELECT DISTINCT target AS node, source AS neighbor FROM edges WHERE target LIKE 'supplier:%'")
def neighbors_in(spark, d):
    return J.neighbors(_edges(spark, d), _suppliers(spark, d), "in")


@query("callees", f"WITH {_EDGES} SELECT source AS node, target AS neighbor FROM edges WHERE kind = 'Calls'")
def callees(spark, d):
    return J.callees(_edges(spark, d), J.nodes(_edges(spark, d)))


@query("callers", f"WITH {_EDGES} SELECT target AS node, source AS neighbor FROM edges WHERE kind = 'Calls'")
def callers(spark, d):
    return J.callers(_edges(spark, d), J.nodes(_edges(spark, d)))


@query("contained_children", f"WITH {_EDGES} SELECT source AS node, target AS neighbor FROM edges WHERE kind = 'Contains'")
def contained_children(spark, d):
    return J.children(_edges(spark, d), J.nodes(_edges(spark, d)))


@query("containing_parents", f"WITH {_EDGES} SELECT target AS node, source AS neighbor FROM edges WHERE kind = 'Contains'")
def containing_parents(spark, d):
    return J.parents(_edges(spark, d), J.nodes(_edges(spark, d)))


@query("base_types", f"WITH {_EDGES} SELECT DISTINCT source AS node, target AS neighbor FROM edges WHERE kind IN ('InheritsFrom', 'Implements')")
def base_types(spark, d):
    return J.base_types(_edges(spark, d), J.nodes(_edges(spark, d)))


@query("derived_types", f"WITH {_EDGES} SELECT DISTINCT target AS node, source AS neighbor FROM edges WHERE kind IN ('InheritsFrom', 'Implements')")
def derived_types(spark, d):
    return J.derived_types(_edges(spark, d), J.nodes(_edges(spark, d)))


def _bfs_sql(steps: str, start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_EDGES}, steps AS ({steps}), walk AS (
      SELECT DISTINCT node AS root, node, 0 AS depth FROM ({start}) UNION SELECT root, b, depth + 1 FROM walk JOIN steps ON node = a WHERE depth < {depth})"""


_IN = "SELECT DISTINCT target AS a, source AS b FROM edges"


@query("bfs_depth", _bfs_sql(_IN, "SELECT 'region:' || r_regionkey AS node FROM region WHERE 'region:' || r_regionkey IN (SELECT target FROM edges)", 2) + " SELECT root, node, min(depth)::INT AS depth FROM walk GROUP BY ALL")
def bfs_depth(spark, d):
    return J.bfs(_edge_rows(spark, d), _regions(spark, d), 2, "in")


@query("reachable", _bfs_sql("SELECT DISTINCT source AS a, target AS b FROM edges", "SELECT 'supplier:' || s_suppkey AS node FROM supplier", 3) + " SELECT root, node, min(depth)::INT AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0")
def reachable(spark, d):
    return J.reachable(_edge_rows(spark, d), _suppliers(spark, d), 3)


_HOME = "SELECT 'nation:' || n_nationkey AS node FROM nation UNION SELECT 'supplier:' || s_suppkey FROM supplier"


@query("induced_subgraph", f"WITH {_EDGES}, c AS ({_HOME}) SELECT source, target, kind FROM edges WHERE source IN (SELECT node FROM c) AND target IN (SELECT node FROM c)")
def induced_subgraph(spark, d):
    nations = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"))
    return J.induced(_edges(spark, d), nations.union(_suppliers(spark, d)))


@query(
    "neighborhood_subgraph",
    f"WITH {_EDGES}, n AS (SELECT target AS node FROM edges WHERE target LIKE 'region:%' UNION SELECT source FROM edges WHERE target LIKE 'region:%') SELECT source, target, kind FROM edges WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)",
)
def neighborhood_subgraph(spark, d):
    return J.neighborhood(_edge_rows(spark, d), _regions(spark, d), 1)


@query("type_hierarchy", f"WITH {_EDGES} SELECT source, target, kind FROM edges WHERE kind = 'InheritsFrom'")
def type_hierarchy(spark, d):
    return J.type_hierarchy(_edge_rows(spark, d), _regions(spark, d), 2)


@query("dependents", _bfs_sql("SELECT DISTINCT target AS a, source AS b FROM edges WHERE kind IN ('Imports', 'Includes', 'Calls', 'References')", "SELECT 'nation:' || n_nationkey AS node FROM nation WHERE 'nation:' || n_nationkey IN (SELECT target FROM edges WHERE kind = 'Includes')", 2) + " SELECT root, node, min(depth)::INT AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0")
def dependents(spark, d):
    nations = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"))
    return J.dependents(_edge_rows(spark, d), nations, 2)


_NAMED = "SELECT 'nation:' || n_nationkey AS element_id, n_name AS name, 'nation' AS file_path FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM customer"


def _elements(spark, d):
    def part(name, key, label):
        return table(spark, d, name).select(F.concat(F.lit(name + ":"), key).alias("element_id"), F.col(label).alias("name"), F.lit(name).alias("file_path"))

    return part("nation", "n_nationkey", "n_name").union(part("supplier", "s_suppkey", "s_name")).union(part("customer", "c_custkey", "c_name"))


@query(
    "evidence_topn_per_kind",
    f"""WITH {_EDGES}, el AS ({_NAMED}), b AS (SELECT source AS node, 'out' AS direction, kind, target AS neighbor FROM edges UNION SELECT target, 'in', kind, source FROM edges),
    r AS (SELECT node, direction, kind, neighbor, row_number() OVER (PARTITION BY node, direction, kind ORDER BY file_path NULLS LAST, name NULLS LAST, neighbor)::INT AS pos
          FROM b LEFT JOIN el ON neighbor = element_id WHERE node IN (SELECT 'nation:' || n_nationkey FROM nation)) SELECT * FROM r WHERE pos <= 5""",
)
def evidence_topn_per_kind(spark, d):
    nations = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"))
    return J.top_relationships(_edges(spark, d), nations, _elements(spark, d))


_WEIGHTS = " ".join(f"WHEN '{k}' THEN {w}" for k, w in J.KIND_WEIGHT.items())


@query(
    "expansion_scores",
    f"""WITH {_EDGES}, st AS (SELECT a, b, max(w) AS w FROM (SELECT source AS a, target AS b, CASE kind {_WEIGHTS} END AS w FROM edges UNION ALL SELECT target, source, CASE kind {_WEIGHTS} END * 0.95 FROM edges) GROUP BY ALL),
    seeds AS (SELECT 'region:' || r_regionkey AS seed, r_regionkey / 10.0 AS s FROM region),
    one AS (SELECT seed, b AS node, s, max(w) AS w FROM seeds JOIN st ON seed = a WHERE b <> seed GROUP BY ALL),
    two AS (SELECT seed, st.b AS node, s, max(st.w) AS w FROM one JOIN st ON node = a WHERE st.b <> seed AND NOT EXISTS (SELECT 1 FROM one o WHERE o.seed = one.seed AND o.node = st.b) GROUP BY ALL)
    SELECT seed, node, 1 AS depth, round(w + 0.1 * s, 6) AS score FROM one UNION ALL SELECT seed, node, 2, round(w / 4 + 0.1 * s, 6) FROM two""",
)
def expansion_scores(spark, d):
    seeds = table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("node"), (F.col("r_regionkey") / 10.0).alias("score"))
    return J.expansion_scores(_edges(spark, d), seeds)


@query("call_graph", f"WITH {_EDGES} SELECT source, target, kind FROM edges WHERE kind = 'Calls'")
def call_graph(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("node"))
    return J.call_graph(_edge_rows(spark, d), parts, 1)


@query("expansion_by_depth", _bfs_sql(_IN, "SELECT 'region:' || r_regionkey AS node FROM region WHERE 'region:' || r_regionkey IN (SELECT target FROM edges)", 2) + ", d AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY ALL), l AS (SELECT DISTINCT depth AS within FROM d) SELECT within::INT AS depth, count(DISTINCT root) AS n_roots, count(*) AS n_nodes FROM d JOIN l ON depth <= within GROUP BY 1")
def expansion_by_depth(spark, d):
    return X.depth_study(J.bfs(_edge_rows(spark, d), _regions(spark, d), 2, "in"))


@query(
    "tool_get_relationships",
    f"""WITH {_EDGES}, el AS ({_NAMED}), n AS (SELECT element_id AS node FROM el WHERE lower(name) = (SELECT lower(min(n_name)) FROM nation) ORDER BY file_path, element_id LIMIT 1),
    b AS (SELECT 'out' AS direction, kind, target AS neighbor FROM edges JOIN n ON source = node UNION SELECT 'in', kind, source FROM edges JOIN n ON target = node),
    p AS (SELECT direction, kind, neighbor, name, file_path, row_number() OVER (PARTITION BY direction, kind ORDER BY file_path NULLS LAST, name NULLS LAST, neighbor) AS pos FROM b LEFT JOIN el ON neighbor = element_id)
    SELECT direction, kind, neighbor, name, file_path FROM p WHERE pos <= 10 ORDER BY direction DESC, kind, pos, neighbor LIMIT 10""",
)
def tool_get_relationships(spark, d):
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return L.get_relationships(_edges(spark, d), _elements(spark, d), first or "").drop("phrase")


@query("graph_memory", f"WITH {_EDGES}, n AS (SELECT source AS x FROM edges UNION SELECT target FROM edges) SELECT a.n_nodes, b.n_edges, a.n_nodes * 340 + b.n_edges * 170 AS bytes FROM (SELECT count(*) AS n_nodes FROM n) a, (SELECT count(*) AS n_edges FROM edges) b")
def graph_memory(spark, d):
    return J.memory_estimate(_edges(spark, d))


@query("relationship_phrases", "SELECT DISTINCT kind, direction, phrase FROM (VALUES ('InheritsFrom', 'out', 'Inherits From →'), ('InheritsFrom', 'in', 'Inherited By ←'), ('Contains', 'out', 'Contains →'), ('Contains', 'in', 'Contained In ←'), ('Includes', 'out', 'Includes →'), ('Includes', 'in', 'Included By ←'), ('References', 'out', 'References →'), ('References', 'in', 'Referenced By ←'), ('Calls', 'out', 'Calls →'), ('Calls', 'in', 'Called By ←'), ('Imports', 'out', 'Imports →'), ('Imports', 'in', 'Imported By ←')) t(kind, direction, phrase)")
def relationship_phrases(spark, d):
    kinds = _edges(spark, d).select("kind").distinct().select("kind", F.explode(F.array(F.lit("out"), F.lit("in"))).alias("direction"))
    return kinds.select("kind", "direction", J.phrase(F.col("kind"), F.col("direction")).alias("phrase"))


@query(
    "budget_greedy",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice::DECIMAL(38, 6)::DOUBLE AS p, trunc(o_totalprice)::BIGINT AS cost FROM orders), r AS (SELECT o_custkey, o_orderkey, cost, row_number() OVER (PARTITION BY o_custkey ORDER BY cost DESC, o_orderkey) AS i FROM o),
    w AS (SELECT o_custkey, o_orderkey, cost, i, cost AS used, 1 AS kept, TRUE AS taken FROM r WHERE i = 1
      UNION ALL SELECT r.o_custkey, r.o_orderkey, r.cost, r.i, used + CASE WHEN kept < 3 AND used + r.cost <= 400000 THEN r.cost ELSE 0 END, kept + (kept < 3 AND used + r.cost <= 400000)::INT, kept < 3 AND used + r.cost <= 400000
      FROM w JOIN r ON r.o_custkey = w.o_custkey AND r.i = w.i + 1)
    SELECT o_custkey, o_orderkey, cost, kept::INT AS pos FROM w WHERE taken""",
)
def budget_greedy(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("bigint").alias("cost"))
    return J.greedy_budget(orders, "o_custkey", [-F.col("cost"), F.col("o_orderkey")], "cost", 400_000, 3)
