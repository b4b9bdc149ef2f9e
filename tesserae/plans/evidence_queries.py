"""Queries of scanning, parsing, evidence, evaluation and tools, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import codegraph
from tesserae.operators import evaluation as M
from tesserae.operators import evidence as K
from tesserae.operators import expansion as X
from tesserae.operators import fusion as H
from tesserae.operators import resolve as R
from tesserae.operators import tools as L
from tesserae.operators import units as U
from tesserae.operators.index import SQL_ELEMENTS, file_elements
from tesserae.plans import pipeline
from tesserae.plans.registry import query
from tesserae.plans.search_queries import _CLEAN, _FUSED, _WORDS, _words
from tesserae.session import cut, kept, table
from tesserae.sources import parse, scan, tables
from tesserae.streaming.incremental import upsert_files

# Scan

_EXT = "lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1))"
_LANGUAGE = "CASE " + _EXT + " " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in scan.LANGUAGES.items()) + " ELSE 'Unknown' END"
_RULES = scan.ignore_rules("*.min.js\nvendor/\n# comment\n!node_modules/\n/api/**/segment_*\n")


def _folders(names) -> str:
    return f"len(list_intersect(string_split(lower(regexp_replace(path, '[^/]*$', '')), '/'), [{T.quoted(names)}])) > 0"


def _ignored() -> str:
    state = "FALSE"
    for _, pattern, negated in _RULES:
        state = f"CASE WHEN regexp_matches(path, '{pattern}') THEN {not negated} ELSE {state} END"
    return state


_REASON = f"""CASE WHEN path IS NULL THEN 'unreadable' WHEN {_folders(scan.SAFETY)} THEN 'internal_safety' WHEN {_ignored()} THEN 'ignore_rule' WHEN {_folders(scan.EXCLUDED)} THEN 'default_exclusion'
  WHEN {_EXT} NOT IN ({T.quoted(tuple(scan.LANGUAGES))}) THEN 'unsupported_extension' WHEN coalesce(size, strlen(content)) > {scan.HARD_SIZE} THEN 'exceeds_hard_limit' WHEN coalesce(size, strlen(content)) > {scan.NORMAL_SIZE} THEN 'deferred_large_file' END"""
_SCANNED = f"scanned AS (SELECT file_id, path, {_LANGUAGE} AS language, {_REASON} AS skip_reason FROM (SELECT DISTINCT file_id, path, size, content FROM file_info))"


def _scanned(spark, d):
    return scan.scan(table(spark, d, "file_info").select("file_id", "path", "size", "content").distinct(), _RULES)


@query("scan_reasons", f"WITH {_SCANNED} SELECT file_id, language, skip_reason FROM scanned")
def scan_reasons(spark, d):
    return _scanned(spark, d).select("file_id", "language", "skip_reason")


@query("language_breakdown", f"WITH {_SCANNED} SELECT language, count(*) AS n_files FROM scanned WHERE skip_reason IS NULL GROUP BY 1")
def language_breakdown(spark, d):
    return scan.breakdown(_scanned(spark, d))


@query("scan_counters", f"WITH {_SCANNED} SELECT count(*) AS n_seen, sum((skip_reason IS NULL)::INT)::BIGINT AS n_kept, sum((skip_reason IS NOT NULL)::INT)::BIGINT AS n_skipped, sum(coalesce((skip_reason = 'deferred_large_file')::INT, 0))::BIGINT AS n_deferred, sum(coalesce((skip_reason = 'exceeds_hard_limit')::INT, 0))::BIGINT AS n_hard FROM scanned")
def scan_counters(spark, d):
    return scan.counters(_scanned(spark, d))


# Parse and units


def _parsed(spark, d):
    return parse.elements(table(spark, d, "file_info"))


@query("elements_by_kind")
def elements_by_kind(spark, d):
    return _parsed(spark, d).groupBy("language", "kind").agg(F.count("*").alias("n"))


@query("code_elements")
def code_elements(spark, d):
    return _parsed(spark, d)


@query("html_tags", "SELECT doc_id, lower(tag) AS tag, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '<([A-Za-z][A-Za-z0-9-]*)', 1)) AS tag FROM documents) GROUP BY ALL")
def html_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(parse.html_tags(F.col("text"))).alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query("retrieval_units")
def retrieval_units(spark, d):
    return U.units(_parsed(spark, d))


@query("unit_texts")
def unit_texts(spark, d):
    return U.unit_texts(_parsed(spark, d))


@query(
    "innermost_owner",
    """WITH i AS (SELECT DISTINCT slice_id AS id, file_id, w.start_line AS s, w.end_line AS e FROM window_slices w JOIN (SELECT DISTINCT excerpt_id, file_id FROM source_excerpts) USING (excerpt_id) WHERE w.end_line IS NOT NULL),
    o AS (SELECT DISTINCT -excerpt_id - 1 AS owner_id, file_id, start_line AS os, end_line AS oe FROM source_excerpts WHERE end_line IS NOT NULL),
    r AS (SELECT id, owner_id, row_number() OVER (PARTITION BY id ORDER BY oe - os, owner_id) AS r FROM i JOIN o USING (file_id) WHERE os <= s AND e <= oe)
    SELECT id, owner_id FROM r WHERE r = 1""",
)
def innermost_owner(spark, d):
    excerpts = table(spark, d, "source_excerpts")
    inner = table(spark, d, "window_slices").join(excerpts.select("excerpt_id", "file_id").distinct(), "excerpt_id").select(F.col("slice_id").alias("id"), "file_id", F.col("start_line").alias("start"), F.col("end_line").alias("end")).where("end IS NOT NULL").distinct()
    outer = excerpts.select((-F.col("excerpt_id") - 1).alias("owner_id"), "file_id", F.col("start_line").alias("o_start"), F.col("end_line").alias("o_end")).where("o_end IS NOT NULL").distinct()
    return R.innermost(inner, outer, ["file_id"])


@query(
    "line_window",
    """WITH f AS (SELECT DISTINCT file_id, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS l FROM file_info WHERE content IS NOT NULL),
    x AS (SELECT DISTINCT excerpt_id, file_id, start_line AS s, end_line AS e FROM source_excerpts WHERE end_line IS NOT NULL)
    SELECT excerpt_id, CASE WHEN s >= 1 AND s <= e AND s <= len(l) THEN array_to_string(l[greatest(1, s - 2):least(len(l), e + 2)], chr(10)) END AS text FROM x JOIN f USING (file_id)""",
)
def line_window(spark, d):
    files = table(spark, d, "file_info").where("content IS NOT NULL").select("file_id", "content").distinct()
    rows = table(spark, d, "source_excerpts").where("end_line IS NOT NULL").select("excerpt_id", "file_id", "start_line", "end_line").distinct()
    return rows.join(files, "file_id").select("excerpt_id", K.read_range(F.col("content"), F.col("start_line"), F.col("end_line"), 2).alias("text"))


# Resolution

_LAYERS = """w AS (SELECT c_custkey AS id, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT s_suppkey AS target, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(
    "layered_resolution",
    f"""WITH {_LAYERS}, a AS (SELECT w.n, count(*) AS c, min(target) AS t FROM (SELECT DISTINCT n FROM w) w JOIN s USING (n) GROUP BY 1), b AS (SELECT r, count(*) AS c, min(target) AS t FROM s GROUP BY 1)
    SELECT id, CASE WHEN a.c IS NOT NULL THEN 'nation' WHEN b.c IS NOT NULL THEN 'region' END AS layer, CASE WHEN coalesce(a.c, b.c) = 1 THEN coalesce(a.t, b.t) END AS target,
           CASE WHEN coalesce(a.c, b.c) IS NULL THEN 'unresolved' WHEN coalesce(a.c, b.c) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
    FROM w LEFT JOIN a USING (n) LEFT JOIN b USING (r)""",
)
def layered_resolution(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n")).join(nation, "n")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("n")).join(nation, "n")
    # within a layer only the first and the last target can tell one match from several
    ends = lambda key: s.groupBy(key).agg(F.array_distinct(F.array(F.min("target"), F.max("target"))).alias("t"))
    layer = lambda key: w.join(ends(key), key).select("id", F.explode("t").alias("target"))
    return R.resolve_layers(w, [("nation", layer("n")), ("region", layer("r"))])


def _imports(spark, d):
    found = _parsed(spark, d).where("kind = 'Include'")
    files = table(spark, d, "file_info").select("file_id", "repo_name").distinct()
    return found.join(files, "file_id").select(F.col("element_id").alias("id"), "file_id", "repo_name", "file_path", F.col("name").alias("import_text"))


@query("import_targets")
def import_targets(spark, d):
    rows = _imports(spark, d)
    return rows.select("id", R.normalize_import(F.col("import_text")).alias("module"), R.import_kind(F.col("import_text")).alias("kind"))


@query("import_resolution")
def import_resolution(spark, d):
    return R.resolve_imports(_imports(spark, d), table(spark, d, "file_info").select("repo_name", "path").distinct())


def _code(spark, d):
    """Parsed elements with their repositories, and the files, each once."""
    files = table(spark, d, "file_info").select("file_id", "repo_name", "path", "content").dropDuplicates(["file_id"])
    return kept(parse.searchable(files)), files


def _graph(spark, d):
    elements, files = _code(spark, d)
    return elements, files, kept(codegraph.build(elements, files))


@query("call_resolution")
def call_resolution(spark, d):
    elements, files = _code(spark, d)
    return codegraph.resolved_calls(elements, codegraph.imports_of(elements, files)).groupBy("layer", "status").agg(F.count("*").alias("n"))


@query("code_graph_edges")
def code_graph_edges(spark, d):
    return _graph(spark, d)[2]


@query("code_graph_counts")
def code_graph_counts(spark, d):
    return codegraph.counts(_graph(spark, d)[2])


# Suppliers named after a part of their nation stand for types, nations for what they may extend.
@query(
    "type_bases",
    """WITH t AS (SELECT s_suppkey AS id, n_name AS base FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    k AS (SELECT n_name AS name, min(n_nationkey) AS target FROM nation GROUP BY 1)
    SELECT id, CASE WHEN id % 3 = 0 THEN 'same_file' WHEN id % 3 = 1 THEN 'name' WHEN k.target IS NOT NULL THEN 'segment' END AS layer, k.target::BIGINT AS target,
           CASE WHEN k.target IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
    FROM t LEFT JOIN k ON k.name = CASE WHEN id % 3 = 2 THEN regexp_extract(base, '([A-Za-z0-9_]+)$', 1) ELSE base END""",
)
def type_bases(spark, d):
    nation = table(spark, d, "nation")
    known = nation.select(F.col("n_nationkey").cast("bigint").alias("element_id"), F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("name"))
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = F.col("s_suppkey") % 3
    types = s.select(F.col("s_suppkey").alias("id"), F.when(part == 0, F.col("n_nationkey")).otherwise(-1).alias("file_id"), F.when(part == 2, F.concat(F.lit("world::"), "n_name")).otherwise(F.col("n_name")).alias("base_name"))
    return R.resolve_bases(types, known)


@query("containment_edges")
def containment_edges(spark, d):
    return R.containment(_parsed(spark, d))


# Search as a whole


@query("primary_search")
def primary_search(spark, d):
    return pipeline.code_search(table(spark, d, "hybrid_search_options"), table(spark, d, "file_info"))


@query("primary_search_adaptive")
def primary_search_adaptive(spark, d):
    return pipeline.code_search(table(spark, d, "hybrid_search_options"), table(spark, d, "file_info"), alpha=None)


@query("search_metrics")
def search_metrics(spark, d):
    return pipeline.search_metrics(primary_search(spark, d))


@query("hybrid_element_search")
def hybrid_element_search(spark, d):
    """Search over single elements of some kinds, without units."""
    elements, _ = _code(spark, d)
    return pipeline.primary_search(table(spark, d, "hybrid_search_options"), elements.where("kind <> 'Call'"), alpha=0.5, kinds=("Function", "Method", "Class", "Struct"), stored=True)


@query("related_search")
def related_search(spark, d):
    """The first units of each query with what the graph of the code relates them to."""
    elements, files, edges = _graph(spark, d)
    found = pipeline.code_search(table(spark, d, "hybrid_search_options"), files, elements, k=10).select("query_id", F.col("unit_id").alias("element_id"), "rank")
    return X.related_search(found, edges, _nodes(elements))


def _nodes(elements):
    """Elements and files of the graph by their ids: ``element_id, name, file_path``."""
    own = elements.select("element_id", "name", "file_path").where("element_id >= 0")
    base = F.regexp_extract("file_path", r"([^/]*)$", 1)
    return own.unionByName(elements.select(codegraph.file_node(F.col("file_id")).alias("element_id"), base.alias("name"), "file_path").dropDuplicates(["element_id"]))


# Evidence

_SUBJECTS = f"subj AS (SELECT DISTINCT query_id, lower(regexp_replace({_CLEAN}, '[?!.,:;]+$', '')) AS subject FROM ({_WORDS}) WHERE {T.sql_role(_CLEAN)} IN ('Subject', 'Technical'))"
_ITEMS = "items AS (SELECT DISTINCT query_id, element_id, element_name AS name, file_path, coalesce(lexical_rank, 0) = 0 AS expanded FROM primary_search_results)"


def _contains(h: str, n: str) -> str:
    return f"CASE WHEN length({n}) <= 2 THEN list_contains(string_split_regex(lower({h}), '[^a-z0-9]+'), lower({n})) ELSE contains(lower({h}), lower({n})) END"


_BASE = "regexp_replace(subject, '(ment|ers|er|or)$', '')"
_HIT = "(" + " OR ".join(f"coalesce({_contains(f, 'subject')}, FALSE) OR (length({_BASE}) >= 4 AND coalesce(contains(lower({f}), {_BASE}), FALSE))" for f in ("name", "file_path")) + ")"
_COVERAGE = f"""{_SUBJECTS}, {_ITEMS},
cov AS (SELECT query_id, subject, coalesce(bool_or({_HIT} AND NOT coalesce(expanded, FALSE)), FALSE) AS primary_hit, coalesce(bool_or({_HIT} AND coalesce(expanded, FALSE)), FALSE) AS expanded_hit FROM subj LEFT JOIN items USING (query_id) GROUP BY ALL)"""


def _subjects(spark, d):
    clean = F.regexp_replace("word", '[`"]', "")
    return _words(spark, d).where(T.term_role(clean).isin("Subject", "Technical")).select("query_id", F.lower(F.regexp_replace(clean, "[?!.,:;]+$", "")).alias("subject")).distinct()


def _items(spark, d):
    return table(spark, d, "primary_search_results").select("query_id", "element_id", F.col("element_name").alias("name"), "file_path", F.lit(None).cast("string").alias("excerpt"), (F.coalesce("lexical_rank", F.lit(0)) == 0).alias("expanded")).distinct()


@query("subject_coverage", f"WITH {_COVERAGE} SELECT * FROM cov")
def subject_coverage(spark, d):
    return K.subject_coverage(_subjects(spark, d), _items(spark, d))


_TOP = f"top AS (SELECT query_id, count(*) AS n_items, max(round(0.8 * nl + (1 - 0.8) * ns, 9)) AS top_score FROM norm GROUP BY 1)"


@query(
    "sufficiency_gate",
    f"""WITH {_FUSED}, {_TOP}, {_COVERAGE},
    c AS (SELECT query_id, count(*) AS n, sum((primary_hit OR expanded_hit)::INT) AS h, sum(primary_hit::INT) AS p FROM cov GROUP BY 1),
    j AS (SELECT query_id, coalesce(h / n, 0) AS share, top_score, CASE WHEN coalesce(n_items, 0) = 0 THEN 'no evidence' WHEN coalesce(h, 0) = 0 THEN 'no subject covered' WHEN p = 0 THEN 'no primary subject' WHEN coalesce(h / n, 0) < 0.34 THEN 'coverage too low' WHEN top_score < 0.05 THEN 'top score too low' ELSE 'sufficient' END AS reason
          FROM (SELECT DISTINCT query_id FROM hybrid_search_options) LEFT JOIN c USING (query_id) LEFT JOIN top USING (query_id))
    SELECT query_id, reason = 'sufficient' AS sufficient, reason, CASE WHEN reason = 'sufficient' THEN round(greatest(0, least(1, 0.6 * share + 0.4 * top_score)), 6) ELSE 0.0 END AS confidence FROM j""",
)
def sufficiency_gate(spark, d):
    scored = H.fuse_weighted(table(spark, d, "primary_search_results"), F.lit(0.8)).select("query_id", F.col("hybrid_score").alias("score"))
    cov = K.subject_coverage(_subjects(spark, d), _items(spark, d))
    return K.sufficiency(table(spark, d, "hybrid_search_options"), cov, scored).drop("missing")


@query(
    "concept_margin",
    """WITH p AS (SELECT c.label AS query_id, c.vec_id AS concept, list_cosine_similarity(c.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim FROM embeddings c JOIN embeddings v ON c.label = v.label AND c.vec_id % 20 = 0 AND v.vec_id <> c.vec_id),
    g AS (SELECT query_id, concept, max(sim) AS top, sum(sim) AS total, count(*) AS n FROM p GROUP BY ALL),
    m AS (SELECT query_id, concept, top, top - CASE WHEN n > 1 THEN (total - top) / (n - 1) ELSE 0.5 END AS margin FROM g)
    SELECT query_id, concept, round(top, 6) AS top, round(margin, 6) AS margin, top >= 0.6 AND margin >= 0.2 AS supported FROM m""",
)
def concept_margin(spark, d):
    v = table(spark, d, "embeddings")
    concepts = v.where("vec_id % 20 = 0").select(F.col("label").alias("query_id"), F.col("vec_id").alias("concept"), F.col("embedding").alias("c"))
    items = v.select(F.col("label").alias("query_id"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), F.lit(False).alias("lexical"))
    return K.concept_support(concepts.join(items, "query_id").where("item_id <> concept"))


_SEEDS = f"""WITH {_FUSED}, {_SUBJECTS}, f AS (SELECT query_id, element_id, round(0.8 * nl + (1 - 0.8) * ns, 9) AS hybrid, row_number() OVER (PARTITION BY query_id ORDER BY round(0.8 * nl + (1 - 0.8) * ns, 9) DESC, (coalesce(lr, 0) > 0) DESC, element_id)::INT AS rank FROM norm),
e AS (SELECT element_id, lower(max(element_name)) AS name, lower(max(file_path)) AS path FROM primary_search_results GROUP BY 1),
h AS (SELECT repo_name, file_path FROM primary_search_results GROUP BY ALL HAVING count(DISTINCT element_id) > 1),
g AS (SELECT DISTINCT element_id FROM primary_search_results JOIN h USING (repo_name, file_path)),
en AS (SELECT DISTINCT query_id, lower(w) AS entity FROM (SELECT query_id, unnest(string_split_regex(regexp_replace(query_text, '[`"?,;:!]', ' ', 'g'), '\\s+')) AS w FROM hybrid_search_options) WHERE {T.sql_technical('w')}),
x AS (SELECT f.*, EXISTS (SELECT 1 FROM en WHERE en.query_id = f.query_id AND entity = name) AS entity_hit, (SELECT coalesce(sum(contains(name, subject)::INT + contains(path, subject)::INT), 0) FROM subj WHERE subj.query_id = f.query_id) AS hits, g.element_id IS NOT NULL AS has_edge
      FROM f LEFT JOIN e USING (element_id) LEFT JOIN g USING (element_id)),
s AS (SELECT query_id, element_id AS item_id, rank, hybrid, round((hybrid + CASE WHEN entity_hit THEN 0.3 ELSE 0 END + least(0.45, 0.15 * hits) + CASE WHEN has_edge THEN 0.1 ELSE 0 END) / (1 + 0.02 * (rank - 1)), 6) AS seed_score FROM x WHERE hybrid >= 0.05),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_score DESC, hybrid DESC, item_id)::INT AS seed_rank FROM s)"""


def _hubs(spark, d):
    """Edges between the candidates of a file and the file itself, where it holds several: each candidate meets its file, not every other."""
    near = table(spark, d, "primary_search_results").where("repo_name IS NOT NULL AND file_path IS NOT NULL").select("repo_name", "file_path", "element_id").distinct()
    several = near.groupBy("repo_name", "file_path").agg(F.count("*").alias("n")).where("n > 1")
    hub = (-F.shiftrightunsigned(F.xxhash64("repo_name", "file_path"), 1) - 1).alias("source")
    return near.join(several, ["repo_name", "file_path"]).select(hub, F.col("element_id").alias("target"), F.lit("Contains").alias("kind"))


@query("seed_scores", f"{_SEEDS} SELECT query_id, item_id, seed_score, seed_rank FROM r WHERE seed_rank <= 5")
def seed_scores(spark, d):
    results = table(spark, d, "primary_search_results")
    named = results.groupBy("element_id").agg(F.max("element_name").alias("name"), F.max("file_path").alias("file_path"))
    facts = pipeline.seed_facts(table(spark, d, "hybrid_search_options"), _subjects(spark, d), H.fuse_weighted(results, F.lit(0.8)), named, _hubs(spark, d))
    return K.seed_scores(facts).select("query_id", "item_id", "seed_score", "seed_rank")


def _investigated(spark, d, most=15, hops=2):
    elements, files, edges = _graph(spark, d)
    options, nodes = table(spark, d, "hybrid_search_options"), _nodes(elements)
    found = cut(pipeline.code_search(options, files, elements).withColumnRenamed("unit_id", "element_id"))
    seeds = K.seed_scores(pipeline.seed_facts(options, _subjects(spark, d), found, nodes, edges))
    pool = cut(K.investigate(seeds, edges, found.select("query_id", F.col("element_id").alias("item_id"), "rank"), most, hops))
    return elements, files, edges, nodes, found, pool


@query("pool_assembly")
def pool_assembly(spark, d):
    """Seeds of the search over code, what its graph brings in two hops, and the other candidates."""
    return _investigated(spark, d)[-1]


@query("investigation_steps")
def investigation_steps(spark, d):
    return K.steps(_investigated(spark, d)[-1])


@query("evidence_bundle")
def evidence_bundle(spark, d):
    elements, files, _, _, _, pool = _investigated(spark, d)
    return K.bundle(pool, elements, files.select("file_id", "content"))


@query("second_hop")
def second_hop(spark, d):
    _, _, edges, nodes, found, pool = _investigated(spark, d, most=10, hops=1)
    items = pool.join(nodes.select(F.col("element_id").alias("item_id"), "name", "file_path"), "item_id").withColumn("excerpt", F.lit(None).cast("string")).withColumn("expanded", F.col("stage").isin(1, 2))
    gate = K.sufficiency(table(spark, d, "hybrid_search_options"), K.subject_coverage(_subjects(spark, d), items), found.select("query_id", F.col("hybrid_score").alias("score")))
    return K.second_hop(gate, pool, edges)


_ACTIONS = f"act AS (SELECT DISTINCT query_id, lower(regexp_replace({_CLEAN}, '[?!.,:;]+$', '')) AS action FROM ({_WORDS}) WHERE {T.sql_role(_CLEAN)} = 'Action')"


@query(
    "action_coverage",
    f"WITH {_ACTIONS}, {_ITEMS} SELECT query_id, action, coalesce(bool_or(" + " OR ".join(f"coalesce({_contains(f, 'action')}, FALSE)" for f in ("name", "file_path")) + "), FALSE) AS hit FROM act LEFT JOIN items USING (query_id) GROUP BY ALL",
)
def action_coverage(spark, d):
    clean = F.regexp_replace("word", '[`"]', "")
    actions = _words(spark, d).where(T.term_role(clean) == "Action").select("query_id", F.lower(F.regexp_replace(clean, "[?!.,:;]+$", "")).alias("action")).distinct()
    return K.action_coverage(actions, _items(spark, d))


@query(
    "selection_policy",
    f"""WITH {_FUSED}, f AS (SELECT query_id, element_id AS item_id, round(0.8 * nl + (1 - 0.8) * ns, 9) AS policy_score FROM norm), p AS (SELECT element_id AS item_id, max(file_path) AS file_path FROM primary_search_results GROUP BY 1),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY policy_score DESC, item_id) AS r FROM f JOIN p USING (item_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY policy_score DESC, item_id)::INT AS pos FROM a WHERE r <= 2) SELECT query_id, item_id, pos FROM b WHERE pos <= 8""",
)
def selection_policy(spark, d):
    results = table(spark, d, "primary_search_results")
    paths = results.groupBy(F.col("element_id").alias("item_id")).agg(F.max("file_path").alias("file_path"))
    rows = H.fuse_weighted(results, F.lit(0.8)).select("query_id", F.col("element_id").alias("item_id"), F.col("hybrid_score").alias("hybrid"), F.lit(False).alias("entity_hit")).join(paths, "item_id")
    return K.select_policy(rows, 8, 2).select("query_id", "item_id", "pos")


_TITLED = "fu AS (SELECT query_id, element_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.8 * nl + (1 - 0.8) * ns, 9) DESC, (coalesce(lr, 0) > 0) DESC, element_id)::INT AS pos FROM norm), tb AS (SELECT query_id, element_id, max(element_name) AS title, max(file_path) AS body FROM primary_search_results GROUP BY ALL)"
_FULL, _SHORT = "'## ' || title || chr(10) || coalesce(body, '') || chr(10)", "'- ' || title || chr(10)"


@query(
    "context_build",
    f"""WITH RECURSIVE {_FUSED}, {_TITLED}, it AS (SELECT query_id, pos, {_FULL} AS f, {_SHORT} AS s FROM fu JOIN tb USING (query_id, element_id) WHERE pos <= 15),
    w AS (SELECT query_id, 0 AS pos, '' AS t, 0 AS n, 0 AS nf, FALSE AS over FROM (SELECT DISTINCT query_id FROM it)
      UNION ALL SELECT w.query_id, it.pos,
        CASE WHEN over THEN t WHEN length(t || f) <= 400 THEN t || f WHEN n = 0 THEN f[1:400 - 11] || chr(10) || '... [cut]' || chr(10) WHEN length(t || s) <= 400 THEN t || s ELSE t END,
        n + (NOT over AND (length(t || f) <= 400 OR n = 0 OR length(t || s) <= 400))::INT, nf + (NOT over AND length(t || f) <= 400)::INT, over OR NOT (length(t || f) <= 400 OR n = 0 OR length(t || s) <= 400)
      FROM w JOIN it ON it.query_id = w.query_id AND it.pos = w.pos + 1)
    SELECT query_id, max_by(n, pos) AS n_items, max_by(nf, pos) AS n_full, max_by(length(t), pos)::INT AS used, max_by(t, pos) AS rendered FROM w GROUP BY 1""",
)
def context_build(spark, d):
    results = H.fuse_weighted(table(spark, d, "primary_search_results"), F.lit(0.8), 15)
    named = table(spark, d, "primary_search_results").groupBy("query_id", "element_id").agg(F.max("element_name").alias("title"), F.max("file_path").alias("body"))
    return K.build_context(results.join(named, ["query_id", "element_id"]).select("query_id", F.col("rank").alias("pos"), "title", "body"), 400)


# Windows, refusals, prompts


@query(
    "anchored_windows",
    """WITH f AS (SELECT DISTINCT file_id, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS l FROM file_info WHERE content IS NOT NULL),
    x AS (SELECT DISTINCT excerpt_id, file_id, start_line AS s, end_line AS e, greatest(1, start_line - 5) AS a FROM source_excerpts WHERE end_line IS NOT NULL)
    SELECT excerpt_id, CASE WHEN e - s + 1 <= 12 THEN CASE WHEN s >= 1 AND s <= e AND s <= len(l) THEN array_to_string(l[s:least(len(l), e)], chr(10)) END
      WHEN a <= len(l) THEN array_to_string(l[a:least(len(l), a + 11)], chr(10)) || chr(10) || '... [truncated]' END AS text FROM x JOIN f USING (file_id)""",
)
def anchored_windows(spark, d):
    files = table(spark, d, "file_info").where("content IS NOT NULL").select("file_id", "content").distinct()
    rows = table(spark, d, "source_excerpts").where("end_line IS NOT NULL").select("excerpt_id", "file_id", "start_line", "end_line").distinct()
    return rows.join(files, "file_id").select("excerpt_id", K.anchored_window(F.col("content"), F.col("start_line"), F.col("end_line"), 12).alias("text"))


@query("byte_prefixes", "SELECT DISTINCT doc_id, text[1:coalesce(list_max(list_filter(range(0, 61), lambda k: strlen(text[1:k]) <= 60)), 0)] AS prefix FROM documents WHERE text IS NOT NULL")
def byte_prefixes(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.byte_prefix(F.col("text"), 60).alias("prefix")).distinct()


_GATE = f"""{_FUSED}, {_TOP}, {_COVERAGE},
    c AS (SELECT query_id, count(*) AS n, sum((primary_hit OR expanded_hit)::INT) AS h, sum(primary_hit::INT) AS p, string_agg(CASE WHEN NOT primary_hit AND NOT expanded_hit THEN subject END, ', ' ORDER BY subject) AS missing FROM cov GROUP BY 1),
    j AS (SELECT query_id, coalesce(missing, '') AS missing, CASE WHEN coalesce(n_items, 0) = 0 THEN 'no evidence' WHEN coalesce(h, 0) = 0 THEN 'no subject covered' WHEN p = 0 THEN 'no primary subject' WHEN coalesce(h / n, 0) < 0.34 THEN 'coverage too low' WHEN top_score < 0.05 THEN 'top score too low' ELSE 'sufficient' END AS reason
          FROM (SELECT DISTINCT query_id FROM hybrid_search_options) LEFT JOIN c USING (query_id) LEFT JOIN top USING (query_id))"""
_REFUSED = "CASE WHEN missing <> '' THEN 'There is no evidence for: ' || missing ELSE 'There is not enough evidence: ' || reason END"


def _gate(spark, d):
    scored = H.fuse_weighted(table(spark, d, "primary_search_results"), F.lit(0.8)).select("query_id", F.col("hybrid_score").alias("score"))
    return K.sufficiency(table(spark, d, "hybrid_search_options"), K.subject_coverage(_subjects(spark, d), _items(spark, d)), scored)


@query("refusal_messages", f"WITH {_GATE} SELECT query_id, {_REFUSED} AS message FROM j WHERE reason <> 'sufficient'")
def refusal_messages(spark, d):
    return _gate(spark, d).where("NOT sufficient").select("query_id", K.refusal_message(F.col("missing"), F.col("reason")).alias("message"))


@query("prompts", "SELECT DISTINCT query_id, 'Answer from the evidence alone and name the files you used.' || chr(10) || chr(10) || 'Evidence:' || chr(10) || repo_name || chr(10) || chr(10) || 'Question: ' || query_text AS prompt FROM hybrid_search_options")
def prompts(spark, d):
    return table(spark, d, "hybrid_search_options").select("query_id", L.prompt(F.col("query_text"), F.col("repo_name")).alias("prompt")).distinct()


@query("gated_answers", f"WITH {_GATE} SELECT query_id, CASE WHEN reason = 'sufficient' THEN 'GROUNDED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, CASE WHEN reason = 'sufficient' THEN 'See the evidence.' ELSE {_REFUSED} END AS answer FROM j")
def gated_answers(spark, d):
    gated = _gate(spark, d).select("query_id", F.lit("?").alias("question"), "sufficient", K.refusal_message(F.col("missing"), F.col("reason")).alias("refusal"), F.lit("").alias("context"))
    return L.grounded_answers(gated)


# Evaluation

_GRADE = "CASE WHEN semantic_rank BETWEEN 1 AND 3 THEN 3 WHEN semantic_rank BETWEEN 4 AND 10 THEN 2 WHEN semantic_rank BETWEEN 11 AND 15 THEN 1 ELSE 0 END"


def _run(spark, d):
    results = table(spark, d, "primary_search_results")
    run = results.where("lexical_rank > 0").select("query_id", F.col("element_id").alias("item"), F.col("lexical_rank").alias("rank"))
    judged = results.select("query_id", F.col("element_id").alias("item"), F.expr(_GRADE).alias("grade"))
    return run, judged


_METRICS = f"""WITH run AS (SELECT query_id, element_id, min(lexical_rank) AS rank FROM primary_search_results WHERE lexical_rank > 0 GROUP BY ALL),
g AS (SELECT query_id, element_id, max({_GRADE}) AS grade FROM primary_search_results GROUP BY ALL),
x AS (SELECT query_id, rank, coalesce(grade, 0) AS grade FROM run LEFT JOIN g USING (query_id, element_id)),
own AS (SELECT query_id, sum((grade > 0 AND rank <= 1)::INT) AS h1, sum((grade > 0 AND rank <= 3)::INT) AS h3, sum((grade > 0 AND rank <= 5)::INT) AS h5, sum((grade > 0 AND rank <= 10)::INT) AS h10, min(CASE WHEN grade > 0 THEN rank END) AS first,
  sum(CASE WHEN grade > 0 AND rank <= 5 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS d5, sum(CASE WHEN grade > 0 AND rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS d10 FROM x GROUP BY 1),
i AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rank FROM g WHERE grade > 0),
best AS (SELECT query_id, count(*) AS n, sum(CASE WHEN rank <= 5 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS i5, sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS i10 FROM i GROUP BY 1),
m AS (SELECT query_id, round(coalesce(h1 / 1, 0), 6) AS p1, round(coalesce(h3 / 3, 0), 6) AS p3, round(coalesce(h5 / 5, 0), 6) AS p5, round(coalesce(h10 / 10, 0), 6) AS p10, round(coalesce(h5 / n, 0), 6) AS r5, round(coalesce(h10 / n, 0), 6) AS r10,
  round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(d5 / i5, 0), 6) AS ndcg5, round(coalesce(d10 / i10, 0), 6) AS ndcg10 FROM (SELECT DISTINCT query_id FROM g) LEFT JOIN own USING (query_id) LEFT JOIN best USING (query_id))"""


@query("ranking_metrics", f"{_METRICS} SELECT * FROM m")
def ranking_metrics(spark, d):
    return M.ranking_metrics(*_run(spark, d))


@query("metric_averages", f"{_METRICS} SELECT count(*) AS n_queries, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('p1', 'p3', 'p5', 'p10', 'r5', 'r10', 'mrr', 'ndcg5', 'ndcg10'))} FROM m")
def metric_averages(spark, d):
    return M.averages(M.ranking_metrics(*_run(spark, d)))


_FIRST = "f AS (SELECT query_id, coalesce(max(CASE WHEN semantic_rank = 1 THEN lexical_rank END), 0) AS rank FROM primary_search_results GROUP BY 1)"


@query("hit_at_k", f"WITH {_FIRST} SELECT count(*) AS n_queries, {', '.join(f'round(avg((rank > 0 AND rank <= {k})::INT), 6) AS hit{k}' for k in (1, 5, 10, 20, 50))}, round(avg(CASE WHEN rank > 0 THEN 1 / rank ELSE 0 END), 6) AS mrr FROM f")
def hit_at_k(spark, d):
    first = table(spark, d, "primary_search_results").groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("semantic_rank") == 1, F.col("lexical_rank"))), F.lit(0)).alias("rank"))
    return M.hit_rates(first)


_OUTCOME = "CASE WHEN e THEN 'reasoning_failure' WHEN NOT r AND NOT s THEN 'retrieval_failure' WHEN NOT r THEN 'groundedness_failure' WHEN NOT s THEN 'sufficiency_failure' ELSE 'none' END"
_ANSWERS = "a AS (SELECT repo_name, upper(coalesce(status, '')) = 'ERROR' AS e, len(coalesce(citations, [])) > 0 AS r, upper(coalesce(status, '')) = 'GROUNDED' AS s FROM grounded_answers)"


def _outcomes(spark, d):
    state = F.upper(F.coalesce("status", F.lit("")))
    answers = table(spark, d, "grounded_answers")
    return answers.select("repo_name", M.outcome(state == "ERROR", F.coalesce(F.size("citations") > 0, F.lit(False)), state == "GROUNDED").alias("outcome"))


@query("outcome_taxonomy", f"WITH {_ANSWERS} SELECT {_OUTCOME} AS outcome, count(*) AS n FROM a GROUP BY 1")
def outcome_taxonomy(spark, d):
    return _outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query("metrics_rollup", f"WITH {_ANSWERS} SELECT repo_name, outcome, count(*) AS n FROM (SELECT repo_name, {_OUTCOME} AS outcome FROM a) GROUP BY GROUPING SETS ((repo_name), (outcome), (repo_name, outcome), ())")
def metrics_rollup(spark, d):
    return _outcomes(spark, d).groupingSets([["repo_name"], ["outcome"], ["repo_name", "outcome"], []], "repo_name", "outcome").agg(F.count("*").alias("n"))


@query(
    "channel_overlap",
    """WITH o AS (SELECT query_id, element_id, max(lexical_rank) AS lr, max(semantic_rank) AS sr FROM primary_search_results GROUP BY ALL), b AS (SELECT query_id, coalesce(lr BETWEEN 1 AND 10, FALSE) AS l, coalesce(sr BETWEEN 1 AND 10, FALSE) AS s FROM o)
    SELECT query_id, sum((l AND s)::INT)::BIGINT AS n_both, sum((l AND NOT s)::INT)::BIGINT AS n_lexical_only, sum((s AND NOT l)::INT)::BIGINT AS n_semantic_only FROM b GROUP BY 1""",
)
def channel_overlap(spark, d):
    return M.channel_overlap(table(spark, d, "primary_search_results"))


@query(
    "lenient_path_matches",
    """WITH f AS (SELECT query_id, element_id, max(lower(file_path)) AS a FROM primary_search_results WHERE file_path IS NOT NULL GROUP BY ALL), e AS (SELECT query_id, max_by(a, element_id) AS b FROM f GROUP BY 1)
    SELECT query_id, count(*) AS n_candidates, sum((a = b OR ends_with(a, b) OR ends_with(b, a) OR contains(a, b) OR regexp_extract(a, '([^/]*)$', 1) = regexp_extract(b, '([^/]*)$', 1))::INT)::BIGINT AS n_matches FROM f JOIN e USING (query_id) GROUP BY 1""",
)
def lenient_path_matches(spark, d):
    found = table(spark, d, "primary_search_results").where("file_path IS NOT NULL").groupBy("query_id", "element_id").agg(F.max(F.lower("file_path")).alias("a"))
    expected = found.groupBy("query_id").agg(F.max_by("a", "element_id").alias("b"))
    return found.join(expected, "query_id").groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.sum(M.path_matches(F.col("a"), F.col("b")).cast("bigint")).alias("n_matches"))


@query("candidate_diversity", "WITH o AS (SELECT query_id, file_path, count(DISTINCT element_id) AS n FROM primary_search_results GROUP BY ALL) SELECT query_id, count(*) AS n_files, max(n) AS most_of_one_file, sum(n)::BIGINT AS n_candidates FROM o GROUP BY 1")
def candidate_diversity(spark, d):
    return M.diversity(table(spark, d, "primary_search_results"))


# Tools and tables


@query("find_symbol", f"WITH {SQL_ELEMENTS} SELECT element_id, name, file_path, lower(name) = 'scanner' AS exact FROM elements WHERE contains(lower(name), 'scanner') ORDER BY exact DESC, name, file_path, element_id LIMIT 30")
def find_symbol(spark, d):
    return L.find_symbol(file_elements(table(spark, d, "file_info")), "scanner", limit=30).select("element_id", "name", "file_path", "exact")


@query(
    "access_policy",
    f"""SELECT file_path, CASE WHEN trim(file_path) = '' THEN 'denied_empty' WHEN regexp_matches(file_path, '^(/|[A-Za-z]:)') THEN 'denied_absolute' WHEN list_contains(string_split(file_path, '/'), '..') THEN 'denied_traversal'
      WHEN n IN ({T.quoted(L.SENSITIVE_NAMES)}) OR starts_with(n, '.env.') THEN 'denied_name' WHEN regexp_extract(n, '\\.([^.]*)$', 1) IN ({T.quoted(L.SENSITIVE_ENDINGS)}) THEN 'denied_extension'
      WHEN len(list_intersect(string_split(lower(file_path), '/'), [{T.quoted(L.SENSITIVE_FOLDERS)}])) > 0 THEN 'denied_folder' ELSE 'allowed' END AS decision
    FROM (SELECT DISTINCT file_path, string_split(lower(file_path), '/')[-1] AS n FROM documents WHERE file_path IS NOT NULL)""",
)
def access_policy(spark, d):
    paths = table(spark, d, "documents").where("file_path IS NOT NULL").select("file_path").distinct()
    return paths.select("file_path", L.access(F.col("file_path")).alias("decision"))


@query("question_records", "SELECT DISTINCT row_id, c0 AS question_id, c1 AS repo_name, c2 AS source, c3 AS taxonomy, c4 AS difficulty, c5 AS question_text FROM question_records")
def question_records(spark, d):
    return tables.questions_from_records(table(spark, d, "question_records")).select("row_id", "question_id", "repo_name", "source", "taxonomy", "difficulty", "question_text")


@query(
    "incremental_upsert",
    """WITH f AS (SELECT DISTINCT file_id, repo_name || ':' || path AS path, size, scanned_at, ingested_at FROM file_info WHERE path IS NOT NULL), c AS (SELECT path, arg_max(size, scanned_at) AS size FROM (SELECT path, coalesce(size, -1) AS size, scanned_at FROM f WHERE ingested_at > scanned_at + INTERVAL 1 DAY) GROUP BY 1)
    SELECT path, size FROM c UNION ALL SELECT DISTINCT path, 0 FROM f WHERE path NOT IN (SELECT path FROM c)""",
)
def incremental_upsert(spark, d):
    files = table(spark, d, "file_info").where("path IS NOT NULL").select("file_id", F.concat_ws(":", "repo_name", "path").alias("path"), "size", "scanned_at", "ingested_at").distinct()
    changed = files.where("ingested_at > scanned_at + INTERVAL 1 DAY").select("path", F.coalesce("size", F.lit(-1).cast("bigint")).alias("size"), "scanned_at")
    current = files.select("path", F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("scanned_at")).distinct()
    return upsert_files(current, changed).select("path", "size")
