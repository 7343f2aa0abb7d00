"""Structuring, sinks, files, vectors and streaming against small brute-force versions."""

import random
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lavra.operators import sinks, structure, vectors
from lavra.sources import files
from lavra.streaming import admission


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(20, 60), st.integers(0, 15))
def test_back_off_chunks(text, size, overlap):
    chunks = structure.back_off_chunks(text, size, overlap)
    assert all(0 < len(c["text"]) <= size and c["text"] == c["text"].strip() for c in chunks)
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
    assert bool(chunks) == bool(text.strip())
    if chunks:
        assert text.strip().startswith(chunks[0]["text"]) and text.strip().endswith(chunks[-1]["text"])


def test_sub_chunks_table(spark):
    rows = [(1, "curto"), (2, None), (3, ""), (4, "palavra " * 400), (5, "x" * 3000)]
    got = structure.sub_chunks(spark.createDataFrame(rows, "id long, text string"), ["id"]).orderBy("id", "chunk_index").collect()
    for key, text in rows:
        assert [r.text for r in got if r.id == key] == [c["text"] for c in structure.back_off_chunks(text, 1200, 150)]


def test_pack_in_order(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.randrange(1, 40)) for g in "ab" for k in range(60)] + [("c", 0, 101), ("c", 1, 5)]
    got = {(r.g, r.k): r.batch for r in structure.pack_in_order(spark.createDataFrame(rows, "g string, k long, n long"), "g", "k", "n", 100).collect()}
    for g in "ab":
        batch, room = 0, 0
        for _, k, n in sorted(r for r in rows if r[0] == g):
            if n > room:
                batch, room = batch + 1, 100
            room -= n
            assert got[(g, k)] == batch
    assert got[("c", 0)] == -1 and got[("c", 1)] == 1


@pytest.mark.parametrize(
    ("text", "amounts"),
    [
        ("R$ 1.234,56 e 7", ["1234.56", "7.00"]), ("1,234.5", ["1234.50"]), ("0.123", ["123.00"]), ("1.23.4", []), ("12,3456", []), ("x9 9x", []), ("-5,25", ["-5.25"]), ("", []), (None, None), ("1.2,3", []),
    ],
)
def test_amounts_in(spark, text, amounts):
    row = spark.createDataFrame([(text,)], "t string").select(structure.amounts_in(F.col("t")).alias("a")).first()
    assert row.a == (None if amounts is None else [Decimal(a) for a in amounts])


@pytest.mark.parametrize(
    ("text", "out"), [('{"a": [1, 2,],}', '{"a": [1, 2]}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('{"a": "x,]"}', '{"a": "x,]"}'), ("{", None), (None, None), ("", None)]
)
def test_repair_json(text, out):
    assert structure.repair_json(text) == out


def test_repair_json_is_strict_and_linear():
    assert structure.repair_json('{"a": NaN}') is None and structure.repair_json('"' + "x" * 300_000 + '"') is None
    assert structure.repair_json('{"a": 1}', True) is None and structure.repair_json('{"a": 1,}', True) == '{"a": 1}'
    assert structure.repair_json("[" + ", " * 100_000 + "]") is None


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(k, [rng.random() - 0.5 for _ in range(5)], k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vectors.top_k(df, df.where("vec_id % 20 = 0"), 4).collect()

    def distance(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return max(0.0, 1 - dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5)

    for q in (0, 20, 40):
        best = sorted((round(distance(v, rows[q][1]), 5), k) for k, v, _ in rows)[:4]
        assert {r.vec_id for r in got if r.query_id == q} == {k for _, k in best}
    same = vectors.top_k(df, df.where("vec_id % 20 = 0"), 4, "label").collect()
    assert all(rows[r.vec_id][2] == rows[r.query_id][2] for r in same)


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v long")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    path = str(tmp_path / "t")
    sinks.append_new_keys(old, None, ["k"], path)
    sinks.append_new_keys(new, spark.read.parquet(path), ["k"], path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    cells = spark.createDataFrame([("=1+1",), (" @x",), ("ok",), (None,)], "c string")
    assert [r[0] for r in cells.select(sinks.spreadsheet_safe(F.col("c"))).collect()] == ["'=1+1", "' @x", "ok", None]
    sinks.write_csv(cells.withColumn("n", F.lit(1)), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n...")
    (tmp_path / "c.html").write_bytes(b"<html>")
    (tmp_path / "d.pdf").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: r.media_type for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "application/pdf", "b.png": "image/png"}
    urls = [("HTTPS://Example.org/a?b=1#c", "https://example.org/a?b=1"), ("ftp://example.org", None), ("http://localhost/x", None), ("http://10.0.0.1/", None), ("http://u:p@example.org/", None), ("https://example.org/?token=1", None), ("https://example.org:8080/", None), (None, None)]
    df = spark.createDataFrame(urls, "u string, want string")
    assert all(r.got == r.want for r in df.select("want", files.public_address(F.col("u")).alias("got")).collect())


def test_streaming_admission(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, k % 4, rng.choice(["error", "view", "view", "view"])) for k in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, event_type string").parquet(str(tmp_path / "in"))
    query = admission.admit(stream, 30).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.event_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for user in range(4):
        state = (0, "", False)
        for k, u, kind in rows:
            if u == user:
                admitted, _, *state = admission.decide(kind == "error", *state, 30)
                assert got[k] == admitted


def test_windowed_failures(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:10:00' AS ts, 'error' AS event_type UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 00:50:00', 'view'")
    assert sorted((r.event_type, r.n, r.failures) for r in admission.windowed_failures(df).collect()) == [("error", 1, 1), ("view", 1, 0)]
