"""Every query with SQL gives the same rows as that SQL in DuckDB."""

import glob
import importlib
import os
import re

import duckdb
import pandas as pd
import pytest

from lavra.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    def cell(v):
        if v is None or (not isinstance(v, (list, str)) and pd.isna(v)):
            return "null"
        return f"{float(v):.9f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark, sf):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranking_is_monotone(spark, sf):
    """A larger quota keeps what a smaller one selects, and a cap selects nothing new."""
    from lavra.operators import retrieval as R
    from lavra.sources.tables import table

    ranked = R.rank_fields(R.prepare(table(spark, sf, "clauses")), table(spark, sf, "page_text").select("document_id", "page_number")).cache()
    key = ["document_id", "field_name", "clause_id"]
    small, large = R.select_quota(ranked, 2).select(*key), R.select_quota(ranked, 5).select(*key)
    assert small.exceptAll(large).count() == 0
    capped = R.cap_round_robin(R.select_quota(ranked), 2).select("document_id", "clause_id").distinct()
    assert capped.exceptAll(R.select_quota(ranked).select("document_id", "clause_id").distinct()).count() == 0


def _exchanged_texts(plan: str) -> list[str]:
    """Lines of exchanges and of what they carry that name a text column."""
    return [line.strip() for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning\(.*\b(?:text|trecho_origem)#", line)]


@pytest.mark.parametrize("name", ["j05_unknown_citations", "j06_chunk_pages", "n07_token_estimate", "n12_corpus_size", "t12_contents_line", "s05_ocr_routing", "a13_consolidation", "d02_headings", "o01_chunk_order"])
def test_no_text_takes_part_in_a_shuffle(spark, sf, name):
    frame = QUERIES[name](spark, sf)
    assert not _exchanged_texts(frame._jdf.queryExecution().executedPlan().toString())


def test_larger_limit_and_smaller_retention_favour_their_side(spark, tmp_path):
    fields = {"limite_maximo_garantia": ("R$ 20.000.000,00", "BRL 10,000,000.00"), "retencao_franquia": ("R$ 50.000,00", "R$ 100.000,00"), "premio": ("R$ 1.000,00", "R$ 1.000,00"), "moeda": ("BRL", "BRL")}
    rows = [(10 * s + k, "ab"[s], name, values[s], 1, f"{name}: {values[s]}", 0.9, "FOUND") for s in (0, 1) for k, (name, values) in enumerate(fields.items())]
    spark.createDataFrame(rows, "evidence_id long, document_id string, field_name string, valor string, pagina int, trecho_origem string, confianca double, status string").write.parquet(f"{tmp_path}/field_evidence.parquet")
    spark.createDataFrame([("a", "X", "sim"), ("b", "X", None)], "document_id string, seguradora string, side_a string").write.parquet(f"{tmp_path}/policy_extraction.parquet")
    got = {r.field_name: (r["class"], r.reason) for r in QUERIES["c01_classification"](spark, str(tmp_path)).collect()}
    assert got["limite_maximo_garantia"] == ("mais_favoravel_A", "vantagem_nominal") and got["retencao_franquia"] == ("mais_favoravel_A", "vantagem_nominal")
    assert got["premio"] == ("igual", "mesmo_valor")
    back = {r.field_name: r["class"] for r in QUERIES["c08_reversal"](spark, str(tmp_path)).collect()}
    assert back["limite_maximo_garantia"] == "mais_favoravel_B" and back["premio"] == "igual"


def test_stages_only_add(spark, sf):
    """Every stage keeps what the one before selected; stage 4 selects every ranked candidate."""
    from lavra.queries import retrieval as Q

    key = ["document_id", "field_name", "clause_id"]
    stages = [s.select(*key) for s in Q._all_stages(spark, sf)]
    assert all(a.exceptAll(b).count() == 0 for a, b in zip(stages, stages[1:]))
    assert Q._ranked(spark, sf, True).select(*key).exceptAll(stages[4]).count() == 0
