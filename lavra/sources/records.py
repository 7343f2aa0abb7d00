"""JSON, ledger, rate and register files as sources; unreadable ones are misses, not failures.

Defined results: missing folders and files, empty ones and texts that do not parse give no row (a count tells how many
did not); repeated keys keep the file that comes last by path.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_CORRUPT = "_corrupt"


def _texts(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """(path, text) of whole files; None where there is no such folder."""
    try:
        read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    except AnalysisException:
        return None
    return read.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_json_cache(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """(path, entry) of the cache files that hold an object of the schema; all else is a miss."""
    texts = _texts(spark, path, pattern)
    if texts is None:
        return spark.createDataFrame([], f"path string, entry struct<{schema}>")
    parsed = F.from_json("text", f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    whole = texts.select("path", parsed.alias("e")).where(F.col("e").isNotNull() & F.col(f"e.{_CORRUPT}").isNull())
    names = [f.name for f in whole.schema["e"].dataType.fields if f.name != _CORRUPT]
    return whole.select("path", F.struct(*[F.col(f"e.{n}") for n in names]).alias("entry"))


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """(path, run_id, document_id, status, position) of the attempts in all ``*-attempt-ledger.json`` files, in order of their paths."""
    schema = "run_id string, events array<struct<document_id:string,status:string>>"
    entries = read_json_cache(spark, path, schema, "*-attempt-ledger.json")
    each = entries.select("path", "entry.run_id", F.posexplode("entry.events").alias("position", "e"))
    return each.select("path", "run_id", "e.document_id", "e.status", "position").orderBy("path", "position")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(model, p_in, p_cached, p_out) of a file of rates, non-negative ones only; empty on any error."""
    schema = "models map<string,struct<input:double,cached_input:double,output:double>>"
    each = read_json_cache(spark, path, schema).select(F.explode("entry.models").alias("model", "r"))
    good = lambda c: F.when((F.col(f"r.{c}") >= 0) & ~F.isnan(f"r.{c}"), F.col(f"r.{c}"))
    return each.select("model", good("input").alias("p_in"), good("cached_input").alias("p_cached"), good("output").alias("p_out"))


def registry_references(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(name, url): for each file name the address on the first line of a Markdown register that mentions it."""
    texts = _texts(spark, path, "*.md")
    if texts is None:
        return spark.createDataFrame([], "name string, url string")
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    url = F.regexp_extract("line", r"https?://[^\s)>\]|]+", 0)
    # a line may mention any name: words of the line that look like file names meet the names in an equi-join
    words = lines.where(url != "").select("path", "no", url.alias("url"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[^\s|`()\[\]<>*]+\.[A-Za-z0-9]+"), F.lit(0)))).alias("name"))
    first = F.row_number().over(Window.partitionBy("name").orderBy("path", "no"))
    return words.join(names.select("name").distinct(), "name").withColumn("_n", first).where("_n = 1").select("name", "url")


def load_session(index: DataFrame, results: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session, violations) of stored runs bound by digest.

    ``index`` has (run_id, document_id, digest), ``results`` (run_id, document_id, digest, result) and ``reports``
    (document_id, report).  A result counts where the index names its digest; violations count results of another
    digest, indexed documents without result, and results without report.
    """
    bound = index.select("run_id", "document_id", F.col("digest").alias("expected")).distinct()
    met = bound.join(results, ["run_id", "document_id"], "left")
    good = met.where("digest = expected").select("run_id", "document_id", "result")
    session = good.join(reports.select("document_id", "report").distinct(), "document_id", "left")
    counts = met.agg(F.count_if(F.expr("digest <> expected")).alias("other_digest"), F.count_if(F.col("digest").isNull()).alias("without_result"))
    without = session.agg(F.count_if(F.col("report").isNull()).alias("without_report"))
    return session, counts.crossJoin(without)  # one row beside one row
