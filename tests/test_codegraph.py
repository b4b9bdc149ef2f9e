"""Parsed code as units and as one graph, search over it, tools and evidence."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tesserae.operators import codegraph, lexical
from tesserae.operators import evidence as K
from tesserae.operators import fusion as H
from tesserae.operators import tools as L
from tesserae.operators import units as U
from tesserae.plans import pipeline
from tesserae.sources import parse, scan

FILES = [
    (1, "r", "pkg/base.py", "class Shape:\n    def area(self):\n        return 0\n\n\ndef scale(x):\n    return x\n"),
    (2, "r", "pkg/round.py", "from pkg.base import Shape, scale\n\n\nclass Circle(Shape):\n    def area(self):\n        return scale(3)\n\n    def twice(self):\n        return self.area()\n"),
    (3, "s", "other.py", "def scale(y):\n    return y\n\n\ndef scale2():\n    return scale(1)\n"),
    (4, "r", "notes.md", "nothing to parse"),
    (5, "r", "ui/card.tsx", "interface Shown {\n}\nclass Base {\n}\nclass Card extends Base implements Shown {\n}\nfunction Title(p) {\n  return (<b className=\"x y\">t</b>);\n}\nfunction Panel(p) {\n  return (<Title a=\"1\" />);\n}\n"),
    (6, None, None, "x = 1\n"), (7, "r", "empty.py", None), (7, "r", "empty.py", None),
]


@pytest.fixture(scope="module")
def code(spark):
    files = spark.createDataFrame(FILES, "file_id bigint, repo_name string, path string, content string")
    elements = U.searchable(parse.elements(files), files).persist()
    edges = codegraph.build(elements, files.dropDuplicates(["file_id"])).persist()
    return files, elements, edges


def names(elements):
    return {r.element_id: (r.file_id, r.kind, r.name) for r in elements.collect()}


def test_graph_of_code(code):
    files, elements, edges = code
    own = names(elements)
    label = lambda n: own[n][2] if n >= 0 else f"file{-n - 1}"
    got = {(r.kind, label(r.source), label(r.target)) for r in edges.collect()}
    assert {("InheritsFrom", "Circle", "Shape"), ("InheritsFrom", "Card", "Base"), ("Implements", "Card", "Shown"), ("Imports", "file2", "file1")} <= got
    assert {("Calls", "area", "scale"), ("Calls", "twice", "area"), ("Calls", "scale2", "scale"), ("References", "Panel", "Title"), ("Contains", "Shape", "area"), ("Contains", "file1", "Shape")} <= got
    calls = {(own[r.source][0], own[r.target][0]) for r in edges.where("kind = 'Calls'").collect()}
    assert calls == {(2, 1), (2, 2), (3, 3)}  # never across repositories
    counts = codegraph.counts(edges).first()
    assert counts.n_edges == edges.count() == counts.n_file_edges + counts.n_symbol_edges and counts.implements == 1
    assert codegraph.counts(codegraph.build(elements.limit(0), files.limit(0))).first().n_edges == 0


def test_many_equal_names_meet_one_row(spark, code):
    _, elements, _ = code
    crowd = spark.range(3000).select((F.col("id") + 10_000).alias("element_id"), F.lit(50).cast("bigint").alias("file_id"), F.lit("get").alias("name"), F.lit("").alias("parent_context"), F.lit("r").alias("repo_name"))
    calls = spark.range(3000).select("id", F.lit(51).cast("bigint").alias("file_id"), F.lit("").alias("scope"), F.lit("get").alias("callee"), F.lit("r").alias("repo_name"))
    none = spark.createDataFrame([], "file_id bigint, target_file bigint")
    from tesserae.operators import resolve

    assert [tuple(r) for r in resolve.resolve_calls(calls, crowd, none).groupBy("layer", "status").count().collect()] == [("repository", "ambiguous", 3000)]


def test_search_finds_units_by_what_they_hold(spark, code):
    files, elements, _ = code
    queries = spark.createDataFrame([(1, "where is Circle defined"), (2, "notes"), (3, "scale2"), (4, None)], "query_id bigint, query_text string")
    found = pipeline.code_search(queries, files, elements).collect()
    first = {r.query_id: r.name for r in found if r.rank == 1}
    assert first == {1: "Circle", 2: "notes", 3: "scale2"}
    assert len({(r.query_id, r.unit_id) for r in found}) == len(found)
    assert {r.n_results for r in pipeline.search_metrics(spark.createDataFrame(found)).collect()} == {sum(r.query_id == q for r in found) for q in (1, 2, 3)}
    some = lexical.search(queries, elements, kinds=("Class",)).collect()
    assert {names(elements)[r.element_id][1] for r in some} == {"Class"}
    more = spark.createDataFrame([(4, "Panel")], "query_id bigint, term string")
    assert any(r.query_id == 4 for r in lexical.search(queries, elements, more_terms=more).collect())


def test_collapsed_names_match(spark):
    elements = spark.createDataFrame([(1, "user_store", "", "", "a.py", "Class"), (2, "beta", "", "", "b.py", "Call")], "element_id bigint, name string, parent_context string, detail string, file_path string, kind string")
    queries = spark.createDataFrame([(1, "UserStore beta"), (2, "user store")], "query_id bigint, query_text string")
    rows = {(r.query_id, r.element_id): r for r in lexical.search(queries, elements).collect()}
    assert rows[1, 1].normalised and rows[2, 1].normalised and not rows[1, 1].exact and rows[1, 2].exact


def test_investigation_keeps_its_way(spark):
    seeds = spark.createDataFrame([(1, 10, 1, 1.0), (2, 10, 1, 1.0)], "query_id bigint, item_id bigint, seed_rank int, seed_score double")
    edges = spark.createDataFrame([(10, 11, "Calls"), (12, 10, "Contains"), (11, 13, "Calls"), (13, 14, "Calls")], "source bigint, target bigint, kind string")
    rest = spark.createDataFrame([(1, 99, 2)], "query_id bigint, item_id bigint, rank int")
    pool = K.investigate(seeds, edges, rest, hops=1)
    got = [tuple(r) for r in pool.where("query_id = 1").orderBy("pos").select("item_id", "stage", "seed_id", "direction", "kind").collect()]
    assert got == [(10, 0, None, None, None), (11, 1, 10, "out", "Calls"), (12, 1, 10, "in", "Contains"), (99, 3, None, None, None)]
    gate = spark.createDataFrame([(1, False), (2, True)], "query_id bigint, sufficient boolean")
    assert [tuple(r) for r in K.second_hop(gate, pool, edges).collect()] == [(1, 13, 11, "out", "Calls", 5)]
    assert {(r.query_id, r.stage, r.n_items) for r in K.steps(pool).collect()} == {(1, 0, 1), (1, 1, 2), (1, 3, 1), (2, 0, 1), (2, 1, 2)}
    elements = spark.createDataFrame([(11, 1, "f", "Function", "a.py", 2, 2)], "element_id bigint, file_id bigint, name string, kind string, file_path string, start_line int, end_line int")
    contents = spark.createDataFrame([(1, "a\nb\nc\n")], "file_id bigint, content string")
    row = K.bundle(pool.where("query_id = 1"), elements, contents, 1).first()
    assert (row.item_id, row.excerpt, row.depth, row.seed_id, row.direction, row.edge_kind) == (11, "a\nb\nc", 1, 10, "out", "Calls")
    evidence = L.to_evidence(pool, spark.createDataFrame([(7,), (11,)], "element_id bigint"), "find_symbol", 1)
    assert [(r.item_id, r.pos, r.tool) for r in evidence.where("stage = 4").collect()] == [(7, 5, "find_symbol")]
    with pytest.raises(ValueError):
        L.to_evidence(pool, contents, "read_file", 1)


def test_tools(code):
    _, elements, edges = code
    assert L.search_code(elements, "Circle", limit=1).first().name == "Circle"
    assert {(r.direction, r.kind, r.name) for r in L.get_relationships(edges, elements, "circle", "out").collect()} == {("out", "InheritsFrom", "Shape"), ("out", "Contains", "area"), ("out", "Contains", "twice")}
    assert L.get_relationships(edges, elements, "nowhere").count() == 0
    for bad in (lambda: L.search_code(elements, " "), lambda: L.get_relationships(edges, elements, "x", "up")):
        with pytest.raises(ValueError):
            bad()


def test_concepts_and_actions(spark):
    support = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True)], "query_id int, concept int, supported boolean")
    assert {tuple(r) for r in K.all_concepts(support).collect()} == {(1, 2, 1, False), (2, 1, 1, True)}
    actions = spark.createDataFrame([(1, "parse"), (2, "run")], "query_id int, action string")
    items = spark.createDataFrame([(1, "parse_row", None, None)], "query_id int, name string, file_path string, excerpt string")
    assert {tuple(r) for r in K.action_coverage(actions, items).collect()} == {(1, "parse", True), (2, "run", False)}


def test_two_channels_and_routes(spark):
    one = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.1, 2)], "query_id int, vec_id int, similarity double, rank int")
    two = spark.createDataFrame([(1, 6, 0.8, 1), (1, 7, 0.7, 2)], "query_id int, vec_id int, similarity double, rank int")
    assert [r.vec_id for r in H.dual_channel(one, two).orderBy("rank").collect()] == [6, 5, 7]
    assert [r.vec_id for r in H.dual_channel(one, two, "linear", 0.9).orderBy("rank").collect()] == [5, 6, 7]
    df = spark.createDataFrame([("ExactSymbol",), ("Conceptual",)], "i string")
    assert [r.w for r in df.select(H.route(F.col("i"), "symbols_lexical").alias("w")).collect()] == [1.0, 0.5]


def test_nested_ignore_files_and_tracked_paths(spark):
    files = spark.createDataFrame([(".gitignore", b"*.log\n"), ("a/.gitignore", b"!keep.log\nb/\n"), ("a/keep.log", b""), ("x.log", b""), ("a/b/c.py", b"x"), ("a/d.py", b"\x00"), ("a/e.py", b"x"), ("t/x.py", b"x"), (None, None)], "path string, content binary")
    rules = scan.nested_rules(files)
    state = {r.path: r.ignored for r in scan.ignored(files.where("path IS NOT NULL"), rules).collect()}
    assert state == {".gitignore": False, "a/.gitignore": False, "a/keep.log": False, "x.log": True, "a/b/c.py": True, "a/d.py": False, "a/e.py": False, "t/x.py": False}
    tracked = spark.createDataFrame([("a/b/c.py",)], "path string")
    got = {r.path: r.skip_reason for r in scan.scan(files.withColumn("size", F.lit(1)), vcs_rules=[*rules, (99, "^t/.*$", False)], tracked=tracked).collect()}
    assert got["a/b/c.py"] is None and got["t/x.py"] == "vcs_ignored" and got["a/d.py"] == "binary" and got[None] == "unreadable"


class _Model(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(200)
        self.end_headers()
        pieces = [{"response": "a "}, {"response": asked["prompt"]}, {"done": True}] if asked["prompt"] != "bad" else [{"error": {"message": "no model"}}]
        for p in pieces:
            self.wfile.write(json.dumps(p).encode() + b"\n")

    def log_message(self, *_):
        pass


def test_http_runtime():
    server = HTTPServer(("127.0.0.1", 0), _Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    run = L.HttpRuntime(f"http://127.0.0.1:{server.server_port}/api/generate", timeout=5)
    assert "".join(run("q")) == "a q"
    with pytest.raises(RuntimeError, match="no model"):
        list(run("bad"))
    server.shutdown()
    server.server_close()
    with pytest.raises(ConnectionError):
        list(run("q"))
    with pytest.raises(ValueError):
        list(L.stream_pieces(iter([b"x" * 50]), 10))
    with pytest.raises(RuntimeError):
        list(L.stream_pieces(iter([b'{"response": "x"}\n'])))
