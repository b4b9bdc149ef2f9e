"""Queries of tokenising, indexing, lexical search and fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import fusion as H
from tesserae.operators import index as I
from tesserae.operators import lexical as D
from tesserae.plans.registry import query
from tesserae.session import table


def _files(spark, d):
    return I.file_elements(table(spark, d, "file_info"))


def _options(spark, d):
    return table(spark, d, "hybrid_search_options")


# Text

_NAMES = "SELECT DISTINCT regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS name FROM file_info"


@query("tokenize_identifier", f"SELECT name, unnest({T.sql_identifier_tokens('name')}) AS token FROM ({_NAMES})")
def tokenize_identifier(spark, d):
    return _files(spark, d).select("name").distinct().select("name", F.explode(T.identifier_tokens(F.col("name"))).alias("token"))


@query("tokenize_path", f"SELECT path, unnest({T.sql_path_tokens('path')}) AS token FROM (SELECT DISTINCT path FROM file_info WHERE path IS NOT NULL)")
def tokenize_path(spark, d):
    return table(spark, d, "file_info").where("path IS NOT NULL").select("path").distinct().select("path", F.explode(T.path_tokens(F.col("path"))).alias("token"))


@query("tokenize_query", f"SELECT query_id, unnest({T.sql_query_tokens('query_text')}) AS token FROM hybrid_search_options WHERE query_text IS NOT NULL")
def tokenize_query(spark, d):
    return _options(spark, d).where("query_text IS NOT NULL").select("query_id", F.explode(T.query_tokens(F.col("query_text"))).alias("token"))


_WORDS = "SELECT query_id, pos, word FROM (SELECT query_id, unnest(string_split_regex(trim(query_text), '\\s+')) AS word, generate_subscripts(string_split_regex(trim(query_text), '\\s+'), 1) AS pos FROM hybrid_search_options) WHERE word <> ''"


def _words(spark, d):
    return _options(spark, d).select("query_id", F.posexplode(F.split(F.trim("query_text"), r"\s+")).alias("pos", "word")).where("word <> ''").withColumn("pos", F.col("pos") + 1)


@query("stemmer", f"SELECT word, {T.sql_stem('word')} AS stem FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> ''")
def stemmer(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


_CLEAN = "regexp_replace(word, '[`\"]', '', 'g')"


@query("term_roles", f"SELECT query_id, pos::INT AS pos, {_CLEAN} AS term, {T.sql_role(_CLEAN)} AS role FROM ({_WORDS})")
def term_roles(spark, d):
    clean = F.regexp_replace("word", '[`"]', "")
    return _words(spark, d).select("query_id", "pos", clean.alias("term"), T.term_role(clean).alias("role"))


@query("technical_entities", f"SELECT query_id, {_CLEAN} AS term FROM ({_WORDS}) WHERE {T.sql_technical(_CLEAN)}")
def technical_entities(spark, d):
    clean = F.regexp_replace("word", '[`"]', "")
    return _words(spark, d).where(T.is_technical(clean)).select("query_id", clean.alias("term"))


@query("normalized_queries", "SELECT query_id, lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'))) AS normalized, lower(regexp_replace(query_text, '[^A-Za-z0-9]', '', 'g')) AS collapsed FROM hybrid_search_options")
def normalized_queries(spark, d):
    return _options(spark, d).select("query_id", T.normalize_text(F.col("query_text")).alias("normalized"), T.collapse_identifier(F.col("query_text")).alias("collapsed"))


@query(
    "compound_pairs",
    f"""WITH s AS (SELECT query_id, pos, lower({_CLEAN}) AS term FROM ({_WORDS}) WHERE {T.sql_role(_CLEAN)} = 'Subject'),
    p AS (SELECT query_id, term, lead(term) OVER (PARTITION BY query_id ORDER BY pos) AS next FROM s),
    w AS (SELECT query_id, string_agg(term, '' ORDER BY pos) AS compound, count(*) AS n FROM s GROUP BY 1)
    SELECT query_id, term || next AS compound FROM p WHERE next IS NOT NULL UNION SELECT query_id, compound FROM w WHERE n BETWEEN 2 AND 4""",
)
def compound_pairs(spark, d):
    clean = F.regexp_replace("word", '[`"]', "")
    subjects = _words(spark, d).where(T.term_role(clean) == "Subject").select("query_id", "pos", F.lower(clean).alias("term"))
    terms = subjects.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
    return terms.select("query_id", F.explode(T.compounds(F.col("terms"))).alias("compound"))


_ALPHA = " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.INTENT_ALPHA.items())
_INTENTS = f"SELECT query_id, intent, (CASE intent {_ALPHA} END)::DOUBLE AS recommended_alpha FROM (SELECT query_id, {T.sql_intent('query_text')} AS intent FROM hybrid_search_options)"


@query("query_intents", _INTENTS)
def query_intents(spark, d):
    kind = T.intent(F.col("query_text"))
    return _options(spark, d).select("query_id", kind.alias("intent"), T.intent_alpha(kind).alias("recommended_alpha"))


_HEAD = "trim(text)"


@query(
    "headlines",
    f"""WITH h AS (SELECT doc_id, {_HEAD} AS t, trim(regexp_extract({_HEAD}, '^([^\\r\\n]+)[\\r\\n]', 1)) AS first, trim(regexp_extract({_HEAD}, '^(.+?)(?: {{2,}}|\\t)', 1)) AS gap,
      trim(regexp_extract({_HEAD}, '(?s)(?:^|.*[.!?]\\s+)([^.!?]*\\?)', 1)) AS question, trim(regexp_extract({_HEAD}, '^(.+?[.!?])(?:\\s|$)', 1)) AS sentence FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN first <> '' THEN first WHEN gap <> '' THEN gap WHEN question <> '' THEN question WHEN sentence <> '' THEN sentence ELSE t END AS headline FROM h""",
)
def headlines(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.headline(F.col("text")).alias("headline"))


@query("text_token_counts", "SELECT doc_id, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'))::INT AS n_text, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))::INT AS n_words FROM documents")
def text_token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.text_tokens(F.col("text"))).alias("n_text"), F.size(T.word_tokens(F.col("text"))).alias("n_words"))


# Index

_OCCURRENCES = f"""{I.SQL_ELEMENTS},
occ AS (
  SELECT element_id, 'name' AS field, unnest({T.sql_identifier_tokens('name')}) AS term FROM elements
  UNION ALL SELECT element_id, 'context', unnest({T.sql_identifier_tokens('parent_context')}) FROM elements
  UNION ALL SELECT element_id, 'detail', unnest({T.sql_identifier_tokens('detail')}) FROM elements
  UNION ALL SELECT element_id, 'path', unnest({T.sql_path_tokens('file_path')}) FROM elements),
post AS (SELECT term, element_id, count(*)::INT AS tf, list_sort(list(DISTINCT field)) AS fields FROM occ GROUP BY ALL),
len AS (SELECT element_id, coalesce(n, 0)::INT AS length FROM elements LEFT JOIN (SELECT element_id, count(*) AS n FROM occ GROUP BY 1) USING (element_id))"""


@query("posting_lists", f"WITH {_OCCURRENCES} SELECT term, element_id, tf, array_to_string(fields, ',') AS fields FROM post")
def posting_lists(spark, d):
    return I.postings(_files(spark, d)).withColumn("fields", F.array_join("fields", ","))


@query("term_df", f"WITH {_OCCURRENCES} SELECT term, count(*) AS df FROM post GROUP BY 1")
def term_df(spark, d):
    return I.document_frequency(I.postings(_files(spark, d)))


@query("element_lengths", f"WITH {_OCCURRENCES} SELECT element_id, length FROM len")
def element_lengths(spark, d):
    return I.lengths(_files(spark, d))


@query("index_statistics", f"WITH {_OCCURRENCES} SELECT (SELECT count(*) FROM len) AS n_elements, (SELECT round(avg(length), 6) FROM len) AS avg_length, (SELECT count(DISTINCT term) FROM post) AS n_terms, (SELECT count(*) FROM post)::BIGINT AS n_postings")
def index_statistics(spark, d):
    elements = _files(spark, d)
    return I.statistics(elements, I.postings(elements))


@query("vocabulary", f"WITH {_OCCURRENCES} SELECT DISTINCT term FROM post")
def vocabulary(spark, d):
    return I.postings(_files(spark, d)).select("term").distinct()


# Lexical search

_TEXT = "regexp_replace(query_text, '[`?!,;\"]', ' ', 'g')"
_STOP = T.quoted(T.STOPWORDS)
_TERMS = f"""qt AS (SELECT DISTINCT query_id, {T.sql_query_tokens(_TEXT)} AS tokens FROM hybrid_search_options),
qo AS (SELECT query_id, list_filter(string_split_regex(trim({_TEXT}), '\\s+'), lambda w: w <> '') AS words FROM hybrid_search_options),
base AS (SELECT query_id, unnest(tokens) AS term FROM qt),
cl AS (SELECT query_id, count(*) AS n FROM base WHERE term NOT IN ({_STOP}) GROUP BY 1)"""


@query("query_lookup_terms", f"WITH {_TERMS} SELECT query_id, term FROM base")
def query_lookup_terms(spark, d):
    words = F.regexp_replace("query_text", '[`?!,;"]', " ")
    return _options(spark, d).select("query_id", F.explode(T.query_tokens(words)).alias("term"))


_FOUND = f"""{_OCCURRENCES}, {_TERMS},
clean AS (SELECT * FROM base WHERE term NOT IN ({_STOP})),
found AS (
  SELECT query_id, element_id, count(*)::INT AS matched, sum(list_contains(fields, 'name')::INT)::INT AS name_hits, sum(list_contains(fields, 'context')::INT)::INT AS context_hits,
         sum(list_contains(fields, 'detail')::INT)::INT AS detail_hits, sum(list_contains(fields, 'path')::INT)::INT AS path_hits
  FROM clean JOIN post USING (term) GROUP BY ALL)"""


def _clean_terms(spark, d):
    return query_lookup_terms(spark, d).where(~F.col("term").isin(*T.STOPWORDS)).withColumn("clean", F.lit(True))


@query("candidate_hits", f"WITH {_FOUND} SELECT * FROM found")
def candidate_hits(spark, d):
    return D.candidates(_clean_terms(spark, d), _files(spark, d))


# Files asked for by their own names, so that all terms match somewhere.
_ASKED = "asked AS (SELECT element_id AS query_id, name AS query_text FROM elements WHERE name <> '')"


@query("match_all_terms", f"WITH {_FOUND} SELECT query_id, element_id FROM found JOIN cl USING (query_id) WHERE matched >= n".replace("qt AS (", _ASKED + ", qt AS (", 1).replace("hybrid_search_options", "asked"))
def match_all_terms(spark, d):
    words = F.regexp_replace("query_text", '[`?!,;"]', " ")
    asked = _files(spark, d).where("name <> ''").select(F.col("element_id").alias("query_id"), F.col("name").alias("query_text"))
    terms = asked.select("query_id", F.explode(T.query_tokens(words)).alias("term")).where(~F.col("term").isin(*T.STOPWORDS))
    return D.all_terms(terms, _files(spark, d))


@query("posting_lookup", f"WITH {_FOUND} SELECT term, element_id, tf FROM post WHERE term IN (SELECT term FROM clean)")
def posting_lookup(spark, d):
    return I.lookup(I.postings(_files(spark, d)), _clean_terms(spark, d)).select("term", "element_id", "tf")


@query("code_syntax", f"SELECT doc_id, regexp_matches(text, '{T.CODE_SYNTAX}') AS has_code FROM documents")
def code_syntax(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_code_syntax(F.col("text")).alias("has_code"))


_FLAGS = f"""{_FOUND},
flags AS (
  SELECT found.*, name, file_path, list_contains(words, name) AS exact, list_contains(list_transform(words, lambda w: lower(w)), lower(name)) OR (regexp_replace(name, '[^A-Za-z0-9]', '', 'g') <> ''
           AND list_contains(list_concat(list_transform(words, lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))), CASE WHEN len(words) BETWEEN 2 AND 4 THEN [lower(regexp_replace(array_to_string(words, ''), '[^A-Za-z0-9]', '', 'g'))] ELSE [] END), lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')))) AS normalised,
         len(list_filter(words, lambda w: length(w) >= 3 AND starts_with(lower(name), lower(w)))) > 0 AS prefix
  FROM found JOIN qo USING (query_id) JOIN elements USING (element_id)),
stats AS (SELECT count(*) AS n, avg(length) AS average FROM len),
w AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, average FROM post, stats GROUP BY term, n, average),
bm AS (
  SELECT query_id, element_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS bm25
  FROM clean JOIN w USING (term) JOIN post USING (term) JOIN len USING (element_id) GROUP BY ALL),
nt AS (SELECT query_id, count(*) AS n_terms FROM clean GROUP BY 1)"""


@query("name_match_flags", f"WITH {_FLAGS} SELECT query_id, element_id, exact, normalised, prefix FROM flags")
def name_match_flags(spark, d):
    return D.name_flags(_clean_terms(spark, d), _options(spark, d), _files(spark, d))


@query("bm25_idf", f"WITH {_FLAGS} SELECT term, round(idf, 6) AS idf FROM w")
def bm25_idf(spark, d):
    elements = _files(spark, d)
    n = elements.agg(F.count("*").alias("n"))
    return I.document_frequency(I.postings(elements)).crossJoin(F.broadcast(n)).select("term", F.round(D.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _ranking(score: str) -> str:
    return f"""WITH {_FLAGS}, scored AS (SELECT flags.*, round({score}, 6) AS score FROM flags JOIN bm USING (query_id, element_id) JOIN nt USING (query_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, exact DESC, matched DESC, file_path, element_id)::INT AS rank FROM scored)
    SELECT query_id, element_id, rank, score FROM r WHERE rank <= 10"""


_BASELINE = "50.0 * matched / n_terms + 100 * exact::INT + 50 * normalised::INT + 25 * (name_hits > 0)::INT + 15 * (context_hits > 0)::INT + 10 * (detail_hits > 0)::INT + 5 * (path_hits > 0)::INT + 5 * matched"
_AWARE = "bm25 + 5.0 * matched / n_terms + 10 * exact::INT + 5 * normalised::INT + 2 * (prefix AND NOT normalised)::INT + 3.0 * name_hits + 1.5 * context_hits + 1.0 * detail_hits + 0.5 * path_hits"


def _ranked(spark, d, ranker):
    return D.ranked(_clean_terms(spark, d), _options(spark, d), _files(spark, d), ranker, 10).select("query_id", "element_id", "rank", "score")


@query("baseline_rank", _ranking(_BASELINE))
def baseline_rank(spark, d):
    return _ranked(spark, d, "baseline")


@query("bm25_topk", _ranking("bm25"))
def bm25_topk(spark, d):
    return _ranked(spark, d, "bm25")


@query("structure_aware_rank", _ranking(_AWARE))
def structure_aware_rank(spark, d):
    return _ranked(spark, d, "structure_aware")


# Fusion

_FIN = "CASE WHEN {0} IS NOT NULL AND NOT isnan({0}) AND abs({0}) <> 'infinity'::DOUBLE THEN {0} END"
_FUSED = f"""one AS (
  SELECT query_id, element_id, max({_FIN.format('lexical_score')}) AS ls, max({_FIN.format('semantic_score')}) AS ss, max(lexical_rank) AS lr, max(semantic_rank) AS sr
  FROM primary_search_results GROUP BY ALL),
ends AS (SELECT query_id, min(CASE WHEN lr > 0 THEN ls END) AS l0, max(CASE WHEN lr > 0 THEN ls END) AS l1, min(CASE WHEN sr > 0 THEN ss END) AS s0, max(CASE WHEN sr > 0 THEN ss END) AS s1 FROM one GROUP BY 1),
norm AS (
  SELECT query_id, element_id, lr, sr, CASE WHEN NOT lr > 0 OR lr IS NULL OR ls IS NULL THEN 0.0 WHEN l1 - l0 < 1e-9 THEN 1.0 ELSE (ls - l0) / (l1 - l0) END AS nl,
         CASE WHEN NOT sr > 0 OR sr IS NULL OR ss IS NULL THEN 0.0 WHEN s1 - s0 < 1e-9 THEN 1.0 ELSE (ss - s0) / (s1 - s0) END AS ns
  FROM one JOIN ends USING (query_id)),
opt AS (
  SELECT query_id, max(lower(regexp_replace(coalesce(fusion_method, 'weighted'), '[^A-Za-z]', '', 'g'))) AS method, max(coalesce(alpha, 0.5)) AS alpha, max(rrf_k) AS rrf_k, max(coalesce(max_results, 20)) AS max_results
  FROM hybrid_search_options GROUP BY 1)"""
_ORDER = "ORDER BY hybrid_score DESC, (coalesce(lr, 0) > 0) DESC, element_id"


def _rr(k: str) -> str:
    kk = f"(CASE WHEN {k} IS NULL OR {k} <= 0 THEN 60.0 ELSE {k} END)"
    return f"(CASE WHEN lr > 0 THEN 1 / ({kk} + lr) ELSE 0.0 END + CASE WHEN sr > 0 THEN 1 / ({kk} + sr) ELSE 0.0 END)"


@query("minmax_norm", f"WITH {_FUSED} SELECT query_id, element_id, round(nl, 6) AS norm_lexical, round(ns, 6) AS norm_semantic FROM norm")
def minmax_norm(spark, d):
    return H.candidates(table(spark, d, "primary_search_results")).select("query_id", "element_id", F.round("norm_lexical", 6).alias("norm_lexical"), F.round("norm_semantic", 6).alias("norm_semantic"))


def _fusion_sql(score: str, limit: str) -> str:
    return f"WITH {_FUSED}, s AS (SELECT *, round({score}, 9) AS hybrid_score FROM norm JOIN opt USING (query_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER})::INT AS rank FROM s) SELECT query_id, element_id, rank FROM r WHERE rank <= {limit}"


@query("fuse_weighted", _fusion_sql("0.8 * nl + (1 - 0.8) * ns", "10"))
def fuse_weighted(spark, d):
    rows = H.fuse_weighted(table(spark, d, "primary_search_results"), F.lit(0.8), 10)
    return rows.join(_options(spark, d).select("query_id").distinct(), "query_id", "left_semi").select("query_id", "element_id", "rank")


@query("fuse_rrf", _fusion_sql(_rr("60.0"), "10"))
def fuse_rrf(spark, d):
    rows = H.fuse_reciprocal(table(spark, d, "primary_search_results"), F.lit(60.0), 10)
    return rows.join(_options(spark, d).select("query_id").distinct(), "query_id", "left_semi").select("query_id", "element_id", "rank")


@query("fuse_by_options", _fusion_sql(f"CASE WHEN starts_with(method, 'recip') OR method = 'rrf' THEN {_rr('rrf_k')} ELSE greatest(0, least(1, alpha)) * nl + (1 - greatest(0, least(1, alpha))) * ns END", "max_results"))
def fuse_by_options(spark, d):
    return H.fuse_by_options(table(spark, d, "primary_search_results"), _options(spark, d)).select("query_id", "element_id", "rank")


_STRATEGIES = " UNION ALL ".join(f"SELECT '{n}' AS strategy, {'NULL' if a is None else a}::DOUBLE AS al, {'NULL' if k is None else k}::DOUBLE AS kk" for n, a, k in H.strategies())


@query(
    "fusion_sweep",
    f"WITH {_FUSED}, st AS ({_STRATEGIES}), s AS (SELECT *, round(CASE WHEN al IS NOT NULL THEN al * nl + (1 - al) * ns ELSE {_rr('kk')} END, 9) AS hybrid_score FROM norm, st),"
    f" r AS (SELECT *, row_number() OVER (PARTITION BY strategy, query_id {_ORDER})::INT AS rank FROM s) SELECT strategy, query_id, element_id, rank FROM r WHERE rank <= 10",
)
def fusion_sweep(spark, d):
    return H.sweep(table(spark, d, "primary_search_results"), 10)


@query(
    "merge_two_lists",
    f"""WITH {_FUSED}, a AS (SELECT query_id, element_id, row_number() OVER (PARTITION BY query_id ORDER BY round(nl, 9) DESC, (coalesce(lr, 0) > 0) DESC, element_id) AS rank FROM norm),
    b AS (SELECT query_id, element_id, row_number() OVER (PARTITION BY query_id ORDER BY round(ns, 9) DESC, (coalesce(lr, 0) > 0) DESC, element_id) AS rank FROM norm),
    u AS (SELECT query_id, element_id, 1 AS l, 1.0 / (60 + rank) AS s FROM a WHERE rank <= 10 UNION ALL SELECT query_id, element_id, 2, 0.5 / (60 + rank) FROM b WHERE rank <= 10)
    SELECT query_id, element_id, round(sum(s), 6) AS score, CASE WHEN count(DISTINCT l) = 2 THEN 'both_queries' WHEN min(l) = 1 THEN 'original_query' ELSE 'expanded_query' END AS provenance FROM u GROUP BY ALL""",
)
def merge_two_lists(spark, d):
    results = table(spark, d, "primary_search_results")
    merged = H.merge_lists(H.fuse_weighted(results, F.lit(1.0), 10), H.fuse_weighted(results, F.lit(0.0), 10))
    return merged.select("query_id", "element_id", F.round("score", 6).alias("score"), "provenance")


@query(
    "route_by_intent",
    f"WITH {_FUSED}, al AS (SELECT DISTINCT * FROM ({_INTENTS})), s AS (SELECT *, round(recommended_alpha * nl + (1 - recommended_alpha) * ns, 9) AS hybrid_score FROM norm JOIN al USING (query_id)),"
    f" r AS (SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER})::INT AS rank FROM s) SELECT query_id, element_id, rank FROM r WHERE rank <= 10",
)
def route_by_intent(spark, d):
    options = _options(spark, d)
    alpha = options.select("query_id", T.intent_alpha(T.intent(F.col("query_text"))).alias("intent_alpha"))
    rows = H.candidates(table(spark, d, "primary_search_results")).join(alpha, "query_id")
    return H.ranked(rows, H.weighted(F.col("norm_lexical"), F.col("norm_semantic"), F.col("intent_alpha"))).where("rank <= 10").select("query_id", "element_id", "rank")
