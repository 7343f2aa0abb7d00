"""File, upload, address and record sources on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lavra.sources import files, records

PDF = b"%PDF-1.7 x"


def test_uploads(spark):
    rows = [("a.pdf", PDF), ("b.html", b"<html>"), ("c.pdf", b"<html>"), ("d.png", PDF), ("e.pdf", b""), ("f.tif", b"II*\0abc"), (None, PDF), ("g.pdf", None), ("h.pdf", PDF * 20)]
    got = {r.name: r.refused for r in files.accept_uploads(spark.createDataFrame(rows, "name string, content binary"), 100).collect()}
    assert got == {"a.pdf": None, "b.html": "suffix", "c.pdf": "signature", "d.png": "type", "e.pdf": "empty", "f.tif": None, None: "suffix", "g.pdf": "empty", "h.pdf": "size"}
    assert files.accept_uploads(spark.createDataFrame([], "name string, content binary")).count() == 0


def test_scan_keeps_accepted_suffixes(spark, tmp_path):
    for name, content in (("a.pdf", PDF), ("b.txt", PDF), ("c.pdf", b"<html>")):
        (tmp_path / name).write_bytes(content)
    assert [r.path.rsplit("/", 1)[-1] for r in files.scan_files(spark, str(tmp_path)).collect()] == ["a.pdf"]


@pytest.mark.parametrize(
    ("url", "out"),
    [
        ("HTTPS://Exemplo.com:443/a?b=1#c", "https://exemplo.com/a?b=1"), ("http://município.com.br", "http://xn--municpio-g2a.com.br/"), ("https://[2606:4700::1111]/x", "https://[2606:4700::1111]/x"),
        ("https://[::1]/", None), ("http://10.0.0.1/", None), ("http://8.8.8.8/", "http://8.8.8.8/"), ("https://a.local/", None), ("https://u:p@a.com/", None), ("https://a.com:8443/", None),
        ("https://a.com/?api-key=1", None), ("ftp://a.com/", None), ("https://a.com/x y", None), ("", None), (None, None), ("https://" + "a" * 3000, None), ("http://999.1.1.1/", None),
    ],
)
def test_canonical_url(url, out):
    assert files.canonical_url(url) == out


def test_addresses_as_columns(spark):
    df = spark.createDataFrame([("https://a.com/#x",), (None,)], "u string")
    assert [r[0] for r in df.select(files.public_address(F.col("u"))).collect()] == ["https://a.com/", None]
    maps = spark.sql("SELECT map('a', 'x', 'b', 'y') AS m, map('b', 'z') AS n, CAST(NULL AS map<string,string>) AS o")
    assert maps.select(files.merge_references(F.col("m"), F.col("n"), F.col("o"))).first()[0] == {"a": "x", "b": "z"}


def test_records(spark, tmp_path):
    (tmp_path / "k1.json").write_text(json.dumps({"key": "k1", "n": 1}))
    (tmp_path / "bad.json").write_text('{"key": ')
    (tmp_path / "empty.json").write_text("")
    hits = records.read_json_cache(spark, str(tmp_path), "key string, n int").collect()
    assert [(r.entry.key, r.entry.n) for r in hits] == [("k1", 1)]
    assert records.read_json_cache(spark, str(tmp_path / "none"), "key string").count() == 0
    ledgers = tmp_path / "l"
    ledgers.mkdir()
    for run in ("b", "a"):
        (ledgers / f"{run}-attempt-ledger.json").write_text(json.dumps({"run_id": run, "events": [{"document_id": "d", "status": "ok"}, {"document_id": "e", "status": None}]}))
    assert [(r.run_id, r.document_id) for r in records.read_ledgers(spark, str(ledgers)).collect()] == [("a", "d"), ("a", "e"), ("b", "d"), ("b", "e")]
    rates = tmp_path / "r"
    rates.mkdir()
    (rates / "rates.json").write_text(json.dumps({"models": {"m": {"input": 1.5, "cached_input": -1, "output": 2}}}))
    assert [tuple(r) for r in records.read_rates(spark, str(rates)).collect()] == [("m", 1.5, None, 2.0)]
    assert records.read_rates(spark, str(tmp_path / "none")).count() == 0


def test_registry(spark, tmp_path):
    (tmp_path / "r.md").write_text("# Registro\n| `a.pdf` | sem endereço |\n| `a.pdf` | https://x.com/a |\n| a.pdf | https://x.com/b |\n- b.pdf: <https://x.com/c>\n")
    names = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",), ("a.pdf",)], "name string")
    assert sorted(map(tuple, records.registry_references(spark, str(tmp_path), names).collect())) == [("a.pdf", "https://x.com/a"), ("b.pdf", "https://x.com/c")]


def test_session(spark):
    index = spark.createDataFrame([("r", "d1", "x"), ("r", "d2", "y"), ("r", "d3", "z"), ("r", "d1", "x")], "run_id string, document_id string, digest string")
    results = spark.createDataFrame([("r", "d1", "x", "one"), ("r", "d2", "other", "two")], "run_id string, document_id string, digest string, result string")
    session, violations = records.load_session(index, results, spark.createDataFrame([], "document_id string, report string"))
    assert [(r.document_id, r.result) for r in session.collect()] == [("d1", "one")]
    assert tuple(violations.first()) == (1, 1, 1)
