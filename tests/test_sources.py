import datetime

from tesserae.operators import units as U
from tesserae.sources import parse, scan, tables
from tesserae.streaming.incremental import follow, late_counts, really_changed, upsert_files


def test_globs_and_rules(spark):
    rules = scan.ignore_rules("*.log\nbuild/\n!build/keep.log\n/top.txt\na/**/z\n")
    df = spark.createDataFrame([("x.log",), ("d/x.log",), ("build/a.c",), ("top.txt",), ("d/top.txt",), ("a/b/c/z",), ("ok.c",), ("build/keep.log",)], "path string")
    assert [r.path for r in scan.ignored(df, rules).where("ignored").collect()] == ["x.log", "d/x.log", "build/a.c", "top.txt", "a/b/c/z"]


def test_scan_tree(spark, tmp_path):
    for name, content in {"main.cpp": b"int main() {}", "src/app.py": b"x = 1", "node_modules/a.js": b"1", ".github/w.py": b"1", ".git/c.py": b"1", "bin.py": b"a\x00b", "README.md": b"#", "big.js": b"x" * (2 * 1024 * 1024 + 1)}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = {r.path: r.skip_reason for r in scan.scan(scan.read_tree(spark, str(tmp_path))).collect()}
    assert found == {"main.cpp": None, "src/app.py": None, "node_modules/a.js": "default_exclusion", ".github/w.py": None, ".git/c.py": "internal_safety", "bin.py": "binary", "README.md": "unsupported_extension", "big.js": "deferred_large_file"}
    assert scan.counters(scan.scan(scan.read_tree(spark, str(tmp_path)))).first().n_kept == 3


SOURCES = {
    "a.py": ("class A(B):\n    '''Doc of A.'''\n    def f(self):\n        return g(1)\n", {("Class", "A"), ("Method", "f"), ("Call", "g")}),
    "a.cpp": ("#include \"x.h\"\nclass A : public B {\npublic:\n  int f(int a) { return g(a); }\n};\n", {("Include", '#include "x.h"'), ("Class", "A"), ("Method", "f"), ("Call", "g")}),
    "A.java": ("import a.B;\npublic class A extends B {\n  public int f(int x) { return g(x); }\n}\n", {("Include", "import a.B"), ("Class", "A"), ("Method", "f"), ("Call", "g")}),
    "a.go": ("package a\n\nimport \"b\"\n\ntype T struct {\n}\n\nfunc (t *T) F() int {\n\treturn g(1)\n}\n", {("Include", '"b"'), ("Struct", "T"), ("Method", "F"), ("Call", "g")}),
    "a.rs": ("use a::b;\npub struct S {\n}\nimpl S {\n    pub fn f(&self) -> u8 { g(1) }\n}\n", {("Include", "use a::b"), ("Struct", "S"), ("Method", "f"), ("Call", "g")}),
    "a.tsx": ("import { q } from './m';\nexport function App(p: P) {\n  const s = useState(1);\n  return q(s);\n}\n", {("Include", "import { q } from './m'"), ("Component", "App"), ("Hook", "useState"), ("Call", "q")}),
    "a.html": ("<div class=\"x y\"><a href='z'>t</a></div>", {("JSXElement", "div"), ("Attribute", "class"), ("UtilityClass", "x"), ("UtilityClass", "y"), ("JSXElement", "a"), ("Attribute", "href")}),
    "a.css": ("@import 'b.css';\n.x { color: red; }\n", {("Include", "@import 'b.css';"), ("Selector", ".x"), ("Property", "color")}),
}


def test_elements(spark):
    rows = [(i, name, text, "x") for i, (name, (text, _)) in enumerate(SOURCES.items())] + [(90, "e.py", None, "x"), (91, "e.py", "", "x"), (92, "e.txt", "x", "x"), (93, "bad.py", "def f(:", "x"), (0, "a.py", SOURCES["a.py"][0], "x")]
    found = parse.elements(spark.createDataFrame(rows, "file_id bigint, path string, content string, name string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.file_path, set()).add((r.kind, r.name))
    assert got == {name: want for name, (_, want) in SOURCES.items()}
    units = {r.name: r.n_supporting for r in U.units(found.where("file_path = 'a.py'")).collect()}
    assert units == {"A": 0, "f": 1}
    assert found.where("name = 'A' AND file_path = 'a.py'").first().documentation == "Doc of A."
    assert U.unit_texts(found).where("text LIKE '%Uses: g%'").count() >= 4


def test_routes_and_comments():
    assert parse.route("app/[id]/page.tsx") == "page:dynamic" and parse.route("pages/api/x.ts") == "api" and parse.route("src/x.ts") is None
    assert parse.clean_documentation("/** A\n * b */") == "A b" and len(parse.clean_documentation("x" * 400)) == 303


def test_questions(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("# comment\nq1\tr\ts\tt\te\ttext\ta.py|b.py\tf||g\t\tc\n")
    row = tables.read_questions(spark, str(tmp_path / "q.tsv")).first()
    assert row.expected_files == ["a.py", "b.py"] and row.expected_symbols == ["f", "g"] and row.expected_relationships == []
    tables.write_results(spark.createDataFrame([("a", 0.123456)], "m string, v double"), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().v == "0.1235"


def test_upsert_and_stream(spark, tmp_path):
    t = lambda h: datetime.datetime(2025, 1, 1, h)
    ddl = "path string, content string, scanned_at timestamp, ingested_at timestamp"
    current = spark.createDataFrame([("a", "1", t(1), t(1)), ("b", "2", t(1), t(1))], ddl)
    changed = spark.createDataFrame([("a", "old", t(2), t(2)), ("a", "new", t(3), t(3)), ("c", "3", t(2), t(9))], ddl)
    out = upsert_files(current, changed, spark.createDataFrame([("b",)], "path string"))
    assert {(r.path, r.content) for r in out.collect()} == {("a", "new"), ("c", "3")}
    assert really_changed(current, current).count() == 0
    changed.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    q = follow(stream, lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(seen) == ["a", "a", "c"]
    counts = late_counts(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), "path").writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(60)
    assert {(r.path, r.n) for r in spark.sql("SELECT path, sum(n) AS n FROM late GROUP BY path").collect()} == {("a", 2), ("c", 1)}
