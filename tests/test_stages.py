"""Stages of retrieval in one pass: the same first stages as the selections stage by stage, and one shuffle for all of them."""

import re

import duckdb
import pytest

from lavra.operators import stages as S
from lavra.queries import ORACLES, QUERIES, retrieval as Q

KEY = ["document_id", "field_name", "clause_id"]
CLAUSES = "document_id string, clause_id string, title string, category string, page_start int, page_end int, text string"


def test_first_stages_are_those_of_the_selections(spark, sf):
    from lavra.sources.tables import table

    first = {tuple(r)[:3]: r.stage for r in S.first_stages(table(spark, sf, "clauses"), Q._numbers(spark, sf)).collect()}
    expected = {}
    for stage, selected in enumerate(Q._all_stages(spark, sf)):
        for r in selected.select(*KEY).collect():
            expected.setdefault(tuple(r), stage)
    assert first == expected


@pytest.fixture
def odd(spark, tmp_path):
    """Repeated, null and empty rows, a running title, sections of eight and nine pages, pages beside, phrases of the last stage only."""
    rows = [("a", f"c{k:02d}", f"{k // 9 + 1}. Clausula {k}", "x", k + 1, k + 1, f"franquia e retencao {'premio ' * (k % 4)}texto") for k in range(20)]
    rows += [("b", f"c{k}", "Titulo corrente", "x", k, k + 1, "custos de defesa ..... 12" if k % 2 else "apolice vigente, custeio de defesa") for k in range(6)]
    rows += [("d", f"c{k}", "1. Abertura" if k == 1 else "", "x", k, k, "sublimites" if k == 1 else "texto") for k in range(1, 9)]
    rows += [("b", "n", None, None, 3, 3, None), ("b", "nulo", "DEFINICOES GERAIS", None, None, None, "foro e jurisdicao"), ("b", None, "x", None, 1, 1, "foro"), (None, "c0", "x", None, 1, 1, "foro"), ("c", "c0", "", "", 1, 1, "")]
    spark.createDataFrame(rows + rows[:9], CLAUSES).write.parquet(f"{tmp_path}/clauses.parquet")
    spark.createDataFrame([(d, n) for d, most in (("a", 20), ("b", 7), ("z", 1)) for n in range(1, most + 1)] + [(None, 1), ("b", None)], "document_id string, page_number int").write.parquet(f"{tmp_path}/page_text.parquet")
    chunks = [(d, c, n, t) for d, c, _, _, n, _, t in rows if d and c and n is not None]
    spark.createDataFrame(chunks, "document_id string, clause_id string, page_number int, text string").write.parquet(f"{tmp_path}/evidence_chunks.parquet")
    found = [(1, "a", "FOUND", "premio", 2, "retencao  premio"), (2, "a", "FOUND", "side_a", 2, "texto"), (3, "b", "FOUND", "custos_defesa", 3, "custos de\ndefesa"), (4, "b", "FOUND", "numero_apolice", 2, "apolice"), (5, "z", "FOUND", "premio", 1, "premio"), (6, "b", "FOUND", "premio", None, "premio"), (7, None, "FOUND", "moeda", 1, "foro")]
    spark.createDataFrame(found + found[:2], "evidence_id long, document_id string, status string, field_name string, pagina int, trecho_origem string").write.parquet(f"{tmp_path}/field_evidence.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["r24_progressive_stages", "r25_new_associations"])
def test_odd_tables(spark, odd, name):
    con = duckdb.connect()
    for t in ("clauses", "page_text", "evidence_chunks", "field_evidence"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    ours, theirs = QUERIES[name](spark, odd), con.execute(f"SELECT {', '.join(QUERIES[name](spark, odd).columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in ours.collect()]
    assert sorted(got, key=str) == sorted(theirs, key=str)
    assert name != "r25_new_associations" or {r[3] for r in got} == {1, 2, 3, 4}


def test_long_spans_and_empty_tables(spark):
    empty = spark.createDataFrame([], CLAUSES)
    assert S.first_stages(empty, spark.createDataFrame([("a", 1)], "document_id string, page_number int")).count() == 0
    assert S._span([{"paged": True, "page_start": 1, "page_end": 10**12}, {"paged": True, "page_start": 5, "page_end": 3}, {"paged": True, "page_start": 7, "page_end": 10**12 + 2}]) == 10**12 + 2


def _exchanges(frame):
    return re.findall(r"\bExchange \w+", frame._jdf.queryExecution().executedPlan().toString())


def test_stages_take_one_shuffle(spark, sf):
    """Neither rankings nor selections are shuffled or written between stages."""
    from lavra.sources.tables import table

    first = S.first_stages(table(spark, sf, "clauses"), Q._numbers(spark, sf))
    assert _exchanges(first) == ["Exchange hashpartitioning"] and "ExistingRDD" not in first._jdf.queryExecution().executedPlan().toString()


def test_r24_keeps_only_its_hits(spark, sf, monkeypatch):
    """Of the stages, r24 writes nothing but the hits of its anchors."""
    from lavra.operators import retrieval as R

    kept = []
    monkeypatch.setattr(R, "cut", lambda df, cut=R.cut: kept.append(df.columns) or cut(df))
    QUERIES["r24_progressive_stages"](spark, sf)
    assert kept == [["anchor_id", "document_id", "field_name", "clause_id"]]
