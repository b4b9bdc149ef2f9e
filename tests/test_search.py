"""Goldens of tokenising, ranking, fusion, vectors, graph and evaluation."""

import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import evaluation as M
from tesserae.operators import evidence as K
from tesserae.operators import fusion as H
from tesserae.operators import graph as J
from tesserae.operators import index as I
from tesserae.operators import lexical as D
from tesserae.operators import resolve as R
from tesserae.operators import tools as L
from tesserae.operators import vectors as G


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.v for r in df.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


def test_identifier_tokens(spark):
    got = values(spark, ["getUserById", "HTTPHeaderTable", "Row42Cursor", "MAX_BUFFER_SIZE", "~Storage()", None, ""], T.identifier_tokens)
    assert got == [["getuserbyid", "get", "user", "by", "id"], ["httpheadertable", "http", "header", "table"], ["row42cursor", "row", "42", "cursor"], ["max_buffer_size", "max", "buffer", "size"], ["storage()"], [], []]


def test_path_and_query_tokens(spark):
    assert values(spark, ["src/auth/user_service.cpp"], T.path_tokens)[0][:4] == ["src/auth/user_service.cpp", "src", "auth", "user_service"]
    assert values(spark, ["find userId userId", " "], T.query_tokens) == [["find", "userid", "user", "id"], []]


def test_stems(spark):
    words = ["months", "classes", "categories", "navigating", "managed", "rendered", "author", "authority", "string", "running", "is"]
    assert values(spark, words, T.stem) == ["month", "class", "category", "navigate", "manage", "render", "author", "authority", "string", "run", "is"]


def test_intents(spark):
    asked = ["Where is LedgerPrinter implemented?", "Why does the loader crash on empty rows?", "Who calls sealBatch?", "lib/io/row_reader.cpp", "How are results ordered?", "sort these results again later today please"]
    assert values(spark, asked, T.intent) == ["ExactSymbol", "Behavioral", "CallerCallee", "FileOrDirectory", "Conceptual", "General"]


def test_compounds_headline_prefix(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r.c for r in df.select(T.compounds(F.col("t")).alias("c")).collect()] == [["abc", "ab", "bc"], [], []]
    assert values(spark, ["First line\nrest", "One. Is it two? Three."], T.headline) == ["First line", "Is it two?"]
    assert values(spark, ["aé中", "abc"], lambda c: T.byte_prefix(c, 4)) == ["aé", "abc"]


def test_idf(spark):
    row = spark.range(1).select(D.idf(F.lit(100), F.lit(10)).alias("a"), D.idf(F.lit(100), F.lit(1)).alias("b"), D.idf(F.lit(0), F.lit(0)).alias("c")).first()
    assert row.a == pytest.approx(2.26374, abs=1e-3) and row.b > row.a and row.c == 0


@pytest.fixture(scope="module")
def elements(spark):
    rows = [(1, "UserService", "auth", "java", "src/auth/UserService.java"), (2, "user_store", "store", "py", "src/store/user_store.py"), (3, "parseToken", "auth", "go", "src/auth/token.go"), (4, None, None, None, None)]
    return spark.createDataFrame(rows, "element_id bigint, name string, parent_context string, detail string, file_path string")


def test_index_and_search(spark, elements):
    posted = I.postings(elements)
    assert {(r.element_id, r.tf) for r in posted.where("term = 'user'").collect()} == {(1, 2), (2, 2)}
    assert {r.element_id: r.length for r in I.lengths(elements).collect()}[4] == 0
    queries = spark.createDataFrame([(1, "Where is `UserService` used?"), (2, "zzz"), (3, None)], "query_id bigint, query_text string")
    for ranker in ("baseline", "bm25", "structure_aware"):
        first = D.search(queries, elements, ranker).where("rank = 1").collect()
        assert [(r.query_id, r.element_id) for r in first] == [(1, 1)]
    assert D.search(queries.limit(0), elements).count() == 0
    with pytest.raises(ValueError):
        D.search(queries, elements, "other")


def test_min_max(spark):
    for got, want in (([10.0, 20.0, 30.0, 40.0, 50.0], [0, 0.25, 0.5, 0.75, 1]), ([42.5], [1]), ([7.0, 7.0], [1, 1]), ([10.0, float("nan"), 20.0, float("inf"), 30.0], [0, 0, 0.5, 0, 1])):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(got)], "query_id int, i int, s double")
        assert [r.o for r in H.min_max(df, {"o": ("s", None)}).orderBy("i").collect()] == want


def fusion_rows(spark, ranks):
    rows = [(1, i, 0.0 if not a else 1.0 / a, a or 0, 0.0 if not b else 1.0 / b, b or 0) for i, a, b in ranks]
    return spark.createDataFrame(rows, "query_id int, element_id int, lexical_score double, lexical_rank int, semantic_score double, semantic_rank int")


def test_reciprocal_rank_fusion(spark):
    got = H.fuse_reciprocal(fusion_rows(spark, [(1, 1, 3), (2, 2, 1), (3, None, 2)]), F.lit(60.0)).orderBy("rank").collect()
    assert [r.element_id for r in got] == [2, 1, 3]
    a, b = H.fuse_reciprocal(fusion_rows(spark, [(1, 2, 5), (2, 1, None)]), F.lit(10.0)).orderBy("rank").collect()
    assert (a.element_id, b.element_id) == (1, 2) and a.hybrid_score == pytest.approx(1 / 12 + 1 / 15)


def test_alpha_one_is_the_lexical_order_and_rows_may_be_permuted(spark):
    rows = fusion_rows(spark, [(i, 10 - i, i) for i in range(1, 9)])
    order = [r.element_id for r in H.fuse_weighted(rows, F.lit(1.0)).orderBy("rank").collect()]
    assert order == list(range(8, 0, -1))
    assert order == [r.element_id for r in H.fuse_weighted(rows.orderBy(F.desc("element_id")).union(rows), F.lit(1.0)).orderBy("rank").collect()]


def test_cosine(spark):
    pairs = [([1.0, 0.0], [2.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([0.0, 0.0], [1.0, 0.0], 0), ([], [], 0), ([1.0], [1.0, 0.0], 0), (None, [1.0], 0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a array<float>, b array<float>")
    assert [r.c for r in df.select("i", G.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()] == [c for *_, c in pairs]


def test_approximate_search_has_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = G.query_set(v)
    assert G.recall(G.knn_exact(v, q, 10), G.knn_approximate(v, q, 10)).first().recall >= 0.9


def test_exact_search_by_blocks_agrees_with_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(4), 1)]) for i in range(120)] + [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0]), (204, [1.0, None, 0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows[:-1], "vec_id bigint, embedding array<float>")
    queries = df.where("vec_id % 20 = 0 OR vec_id >= 200")

    def cos(a, b):
        a, b = ([0.0 if v is None else float(np.float32(v)) for v in x or []] for x in (a, b))
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return 0.0 if len(a) != len(b) or na < 1e-6 or nb < 1e-6 else round(sum(x * y for x, y in zip(a, b)) / na / nb, 6) + 0.0

    vectors = dict(rows[:-1])
    want = {q: sorted(((-cos(vectors[q], v), i) for i, v in vectors.items() if i != q))[:7] for q in vectors if q % 20 == 0 or q >= 200}
    for size in (50_000, 13):
        monkeypatch.setattr(G, "VECTOR_BLOCK", size)
        monkeypatch.setattr(G, "QUERY_BLOCK", size)
        got = {}
        for r in G.knn_exact(df.union(df), queries, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.similarity, r.vec_id))
        assert {q: [(round(s, 5), i) for s, i in v] for q, v in got.items()} == {q: [(round(s, 5), i) for s, i in v] for q, v in want.items()}
    assert G.knn_exact(df.limit(0), queries, 3).count() == 0 and G.knn_exact(df, queries.limit(0), 3).count() == 0


def test_codebooks_round_trip(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    books = G.Codebooks.fit(v, 64, parts=8, codes=16)
    G.save(G.quantised(v, books, 64), str(tmp_path / "q"), books)
    assert (G.load_books(spark, str(tmp_path / "q")).centroids == books.centroids).all()
    assert G.quantised(v, books, 64).where("length(codes) = 8").count() == v.select("vec_id").distinct().count()


def test_embedders(spark):
    df = spark.createDataFrame([(1, "parse the file"), (2, None), (3, ""), (4, "the file parse"), (4, "the file parse"), (5, "...")], "k bigint, text string")
    plain = {r.k: list(r.embedding) for r in G.hash_embed(df, "k").collect()}
    assert plain[1] == pytest.approx(plain[4]) and sum(x * x for x in plain[1]) == pytest.approx(1) and set(plain[2] + plain[3] + plain[5]) == {0.0} and len(plain) == 5
    placed = {r.k: list(r.embedding) for r in G.lexicon_embed(df, "k", {"parse": 3}).collect()}
    assert placed[1] != pytest.approx(placed[4]) and sum(x * x for x in placed[1]) == pytest.approx(1) and len(placed[1]) == 384
    near = G.retrieve_text(G.hash_embed(df, "k").withColumnRenamed("k", "vec_id"), spark.createDataFrame([(-1, "parse file"), (-2, " ")], "vec_id bigint, text string"), 2)
    assert {r.vec_id for r in near.collect()} == {1, 4}


def test_index_maintenance(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0])], "vec_id bigint, embedding array<float>")
    good = G.valid(v, 2)
    assert [r.vec_id for r in good.collect()] == [1]
    G.save(good, str(tmp_path / "v"))
    assert G.load(spark, str(tmp_path / "v"), 2).count() == 1
    with pytest.raises(ValueError):
        G.load(spark, str(tmp_path / "v"), 3)
    assert G.hash_embed(spark.createDataFrame([(1, "a b"), (2, None)], "k int, text string"), "k").count() == 2
    one = G.lexicon_embed(spark.createDataFrame([(1, "parse tokens"), (2, None)], "k int, text string"), "k", {"parse": 3}).collect()
    assert math.isclose(sum(x * x for x in one[0].embedding), 1, abs_tol=1e-4) and not any(one[1].embedding)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, 2, "Calls"), (2, 3, "Calls"), (3, 1, "Calls"), (4, 4, "Contains"), (1, 2, "Calls"), (5, 1, "InheritsFrom")]
    return J.edge_set(spark.createDataFrame(rows, "source bigint, target bigint, kind string"))


def test_graph(spark, edges):
    at = lambda *n: spark.createDataFrame([(x,) for x in n], "node bigint")
    assert edges.count() == 5 and J.nodes(edges).count() == 5
    assert {(r.node, r.depth) for r in J.bfs(edges, at(1, 99), 5).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {r.node for r in J.reachable(edges, at(1), 1).collect()} == {2}
    assert [r.neighbor for r in J.callers(edges, at(1)).collect()] == [3]
    assert {r.n_out + r.n_in for r in J.degrees(edges).where("node = 4").collect()} == {2}
    assert J.induced(edges, at(1, 2)).count() == 1
    assert J.remove_nodes(edges, at(1)).count() == 2
    assert J.remove(J.insert(edges, spark.createDataFrame([(8, 9, "Calls")], "source bigint, target bigint, kind string")), edges).count() == 1
    assert {(r.node, r.depth, r.score) for r in J.expansion_scores(edges, spark.createDataFrame([(5, 1.0)], "node bigint, score double")).collect()} == {(1, 1, 0.85), (2, 2, 0.35), (3, 2, 0.3375)}


def test_greedy_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, 90), (1, 2, 50), (1, 3, 10), (2, 1, 500), (2, 2, 1)], "g int, o int, size int")
    taken = {(r.g, r.o) for r in J.greedy_budget(df, "g", [F.col("o")], "size", 100, 3).collect()}
    assert taken == {(1, 1), (1, 3), (2, 1)}


def test_imports_and_calls(spark):
    texts = ['#include "a/b.h"', "from x.y import z", "import { q } from './m/n'", "use crate::a::b", "require('k')", "import java.util.List"]
    assert values(spark, texts, R.normalize_import) == ["a/b.h", "x.y", "./m/n", "crate/a/b", "k", "java.util.List"]
    imports = spark.createDataFrame([(1, "r", "src/a.ts", "import { q } from './m/n'"), (2, "r", "src/a.c", '#include "util.h"'), (3, "r", "src/a.c", "#include <stdio.h>")], "id bigint, repo_name string, file_path string, import_text string")
    files = spark.createDataFrame([("r", "src/m/n.ts"), ("r", "lib/util.h"), ("s", "lib/stdio.h")], "repo_name string, path string")
    got = {r.id: (r.layer, r.target, r.status) for r in R.resolve_imports(imports, files).collect()}
    assert got == {1: ("relative", "src/m/n.ts", "resolved"), 2: ("filename", "lib/util.h", "resolved"), 3: (None, None, "unresolved")}
    calls = spark.createDataFrame([(1, 1, "A", "this.f"), (2, 1, "", "helper"), (3, 2, "", "only")], "id bigint, file_id bigint, scope string, callee string")
    functions = spark.createDataFrame([(10, 1, "f", "A"), (11, 3, "helper", "B"), (12, 4, "helper", "C"), (13, 5, "only", "")], "element_id bigint, file_id bigint, name string, parent_context string")
    none = spark.createDataFrame([], "file_id bigint, target_file bigint")
    assert {r.id: (r.target, r.status) for r in R.resolve_calls(calls, functions, none).collect()} == {1: (10, "resolved"), 2: (None, "ambiguous"), 3: (13, "resolved")}


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1), (2, "a", 2), (2, "a", 3)], "query_id int, item string, rank int")
    judged = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (1, "c", 2), (2, "a", 3), (3, "q", 0)], "query_id int, item string, grade int")
    got = {r.query_id: r for r in M.ranking_metrics(run, judged).collect()}
    assert (got[1].p1, got[1].p3, got[1].mrr, got[1].ndcg5) == (1, 1, 1, 1) and got[2].mrr == 0.5 and got[2].r5 == 1 and got[3].mrr == 0
    assert {r.query_id: r.r5 for r in M.ranking_metrics(run, judged, count_duplicates=True).collect()}[2] == 2
    assert M.hit_rates(spark.createDataFrame([(1,), (0,), (-1,), (7,)], "rank int")).first().n_queries == 3


def test_context_and_gate(spark):
    items = spark.createDataFrame([(1, 1, "a", "x" * 500), (1, 2, "b", "y"), (2, 1, "a", "x" * 40), (2, 2, "b", "y" * 60), (2, 3, "c", "z" * 500)], "query_id int, pos int, title string, body string")
    got = {r.query_id: r for r in K.build_context(items, 100).collect()}
    assert got[1].used <= 100 and "[cut]" in got[1].rendered and got[2].n_full == 1 and got[2].n_items == 3
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    cov = spark.createDataFrame([(1, "a", True, False), (1, "b", False, False), (2, "a", False, True)], "query_id int, subject string, primary_hit boolean, expanded_hit boolean")
    scores = spark.createDataFrame([(1, 0.9), (2, 0.9)], "query_id int, score double")
    assert {r.query_id: r.reason for r in K.sufficiency(queries, cov, scores).collect()} == {1: "sufficient", 2: "no primary subject", 3: "no evidence"}


def test_snippets(spark):
    df = spark.createDataFrame([("a\nb\nc\r\nd\n", 2, 3), ("a", 5, 6), ("a", 0, 1)], "t string, s int, e int")
    assert [r.x for r in df.select(K.read_range(F.col("t"), F.col("s"), F.col("e")).alias("x")).collect()] == ["b\nc", None, None]


def test_tools(spark):
    df = spark.createDataFrame([("a/b.py",), ("../x",), ("/etc/x",), ("a/.env",), ("k/x.pem",), (".git/config",), (None,)], "p string")
    assert [r.d for r in df.select(L.access(F.col("p")).alias("d")).collect()] == ["allowed", "denied_traversal", "denied_absolute", "denied_name", "denied_extension", "denied_folder", "denied_empty"]
    tools = L.ToolRegistry()
    tools.add("x", lambda: df)
    assert tools.names() == ["x"] and tools.execute("y").status == "not_found" and tools.execute("x").status == "success" and tools.execute("x", z=1).status == "invalid_arguments"
    with pytest.raises(ValueError):
        tools.add("x", lambda: df)
    gated = spark.createDataFrame([(1, "q", True, "no", "c"), (2, "q", False, "no", None)], "query_id int, question string, sufficient boolean, refusal string, context string")
    assert {tuple(r) for r in L.grounded_answers(gated).collect()} == {(1, "GROUNDED", "See the evidence."), (2, "INSUFFICIENT_EVIDENCE", "no")}
    assert {r.status for r in L.grounded_answers(gated, L.FakeRuntime(error="down")).collect()} == {"ERROR", "INSUFFICIENT_EVIDENCE"}
    assert L.parse_endpoint("http://[::1]/x") == ("::1", 11434, "/x")
    assert L.BufferingSink().consume(L.FakeRuntime("abc", 2)("p")) == "abc"
    files = spark.createDataFrame([("a/b.py", "1\n2\n3")], "path string, content string")
    assert L.read_file(files, "a/b.py", 2).first().text == "2\n3"


def test_call_resolution_by_imports_and_repository(spark, tmp_path):
    from tesserae.plans import evidence_queries

    load = "def load(x):\n    return x\n"
    rows = [(1, "a", "main.py", "from util import load\n\ndef run():\n    load(1)\n"), (2, "a", "util.py", load), (3, "a", "other.py", load), (4, "b", "only.py", "def fetch(x):\n    return x\n"), (5, "b", "use.py", "def go():\n    fetch(2)\n"), (6, "c", "else.py", "def fetch(x):\n    return x\n")]
    spark.createDataFrame(rows, "file_id bigint, repo_name string, path string, content string").write.parquet(str(tmp_path / "file_info.parquet"))
    got = {(r.layer, r.status): r.n for r in evidence_queries.call_resolution(spark, str(tmp_path)).collect()}
    assert got == {("imported", "resolved"): 1, ("repository", "resolved"): 1}


def test_calls_by_caller_namespace(spark):
    calls = spark.createDataFrame([(1, 7, "a", "ns", "f()")], "id int, file_id int, repo_name string, scope string, callee string")
    functions = spark.createDataFrame([(10, 8, "a", "f", "ns"), (11, 9, "a", "f", "other"), (12, 5, "b", "f", "ns")], "element_id int, file_id int, repo_name string, name string, parent_context string")
    none = calls.select("file_id", "file_id").toDF("file_id", "target_file").limit(0)
    assert [tuple(r) for r in R.resolve_calls(calls, functions, none).collect()] == [(1, "namespace", 10, "resolved")]
