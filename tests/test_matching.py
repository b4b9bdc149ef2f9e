"""Lexical hits where the elements are: agreement with a plain count, and no hit in a shuffle."""

import types

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesserae.operators import lexical as D
from tesserae.operators import matching as Q

TINY = "/root/testdata/sf0.001"


def shuffled_after_python(df) -> list[str]:
    """Steps of the plan that move or gather rows above the Python that makes them."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    return [x for x in lines[:at] if "Exchange" in x or "Aggregate" in x or "Join" in x]


@pytest.mark.parametrize("name", ["bm25_topk", "baseline_rank", "structure_aware_rank"])
def test_only_the_first_of_each_query_leave_a_task(spark, name):
    above = shuffled_after_python(entry.queries()[name](spark, TINY))
    assert len(above) == 1 and "Exchange" in above[0]  # that of the window over what tasks kept


@pytest.mark.parametrize("name", ["match_all_terms", "name_match_flags", "candidate_hits"])
def test_hits_stay_where_their_elements_are(spark, name):
    assert shuffled_after_python(entry.queries()[name](spark, TINY)) == []


def blocks(monkeypatch, elements=3, cells=7):
    monkeypatch.setattr(Q, "ELEMENT_BLOCK", elements)
    monkeypatch.setattr(Q, "CELLS", cells)


ROWS = [(1, "UserService", "auth", "java", "src/auth/UserService.java"), (2, "user_store", "store", "py", "src/store/user_store.py"), (3, "parseToken", "auth", "go", "src/auth/token.go"),
        (4, None, "store", None, None), (5, "", "store", "user", "src/.user"), (6, "user", "user", "user", "user/user.user"), (7, "user_store", "b", "py", "b/user_store.py"), (8, "user_store", "b", "py", "b/user_store.py")]
ASKED = [(1, "Where is `UserService` used?"), (2, "user store of auth"), (3, "zzz"), (4, None), (5, "src user the-store userstore"), (6, "us store"), (7, " user  user_store \t")]


def test_kernel_by_small_blocks_gives_the_same(spark, monkeypatch):
    elements = spark.createDataFrame(ROWS, "element_id bigint, name string, parent_context string, detail string, file_path string").coalesce(1)
    queries = spark.createDataFrame(ASKED, "query_id bigint, query_text string")
    terms = D.query_terms(queries)
    (asked,) = Q._met(terms, queries, 100)
    read = Q._read(elements, None, (), True).toArrow()
    schema = pa.schema([("query_id", pa.int64()), ("element_id", pa.int64()), ("score", pa.float64()), ("matched", pa.int32()), ("marks", pa.int32()), ("file_path", pa.string())])
    shared = types.SimpleNamespace(value=asked)
    weigh = types.SimpleNamespace(value=(np.linspace(0.5, 2, len(asked.terms)), 6.0))
    own = {f"{f}_tokens": read[f"{f}_tokens"].to_pylist() for f in Q.FIELDS}
    held = dict(zip(read["element_id"].to_pylist(), zip(*own.values(), strict=True), strict=True))
    by_query = {}
    for r in terms.collect():
        by_query.setdefault(r.query_id, []).append(r.term)
    want = {(q, e): sum(any(t in f for f in fields) for t in ts) for q, ts in by_query.items() for e, fields in held.items()}
    want = {k: n for k, n in want.items() if n}

    def best(k, ranker):
        got = [r for b in Q._best(shared, weigh, ranker, k, False, schema)(iter(read.to_batches())) for r in b.to_pylist()]
        for r in got:
            r["exact"] = None if r["marks"] & 8 else bool(r["marks"] & 1)
        order = lambda r: (r["query_id"], r["score"] is None, -(r["score"] or 0), -1 * (2 if r["exact"] else 1 if r["exact"] is False else 0), -r["matched"], r["file_path"] or "", r["element_id"])
        return sorted(got, key=order)

    for ranker in ("baseline", "bm25", "structure_aware"):
        monkeypatch.undo()
        whole = best(100, ranker)
        assert {(r["query_id"], r["element_id"]): r["matched"] for r in whole} == want
        blocks(monkeypatch)
        assert best(100, ranker) == whole
        first = {}
        for r in whole:
            first.setdefault(r["query_id"], []).append(r)
        got = {}
        for r in best(2, ranker):
            got.setdefault(r["query_id"], []).append(r)
        assert {q: rows[:2] for q, rows in got.items()} == {q: rows[:2] for q, rows in first.items()}
        assert all((r["score"] is None) == (ranker != "bm25" and r["element_id"] == 4) and (r["exact"] is None) == (r["element_id"] == 4) for r in whole)


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "QUERY_BLOCK", 5)
    con = duckdb.connect()
    for t in ("file_info", "hybrid_search_options"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    for name in ("bm25_topk", "match_all_terms"):
        got = entry.queries()[name](spark, TINY).toPandas()
        want = con.sql(entry.oracle_sql()[name]).df()[list(got.columns)]
        keys = ["query_id", "element_id"]
        assert len(got) == len(want) > 0 and np.allclose(got.sort_values(keys).to_numpy(float), want.sort_values(keys).to_numpy(float), atol=1e-6)


def test_queries_of_many_terms(spark):
    words = [f"q{a}{b}{c}" for a in "abcde" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst"]
    many = spark.createDataFrame([(1, w) for w in words], "query_id bigint, term string")
    element = spark.createDataFrame([(1, " ".join(words), words[0], "", "")], "element_id bigint, name string, parent_context string, detail string, file_path string")
    assert [tuple(r) for r in D.candidates(many, element).collect()] == [(1, 1, 2000, 2000, 1, 0, 0)]
