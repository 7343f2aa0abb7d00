"""Declarative plans: SQL text over the project's Parquet tables, planned by Catalyst."""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession

from lavra.sources.tables import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings processed_documents page_text policy_extraction"
    " field_evidence clauses evidence_chunks golden_anchors exchange_rates"
)
_TABLE = re.compile(r"\{(" + "|".join(TABLES.split()) + r")\}")


def plan(name: str, text: str, doc: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of SQL text in which ``{table}`` stands for a table of the given folder, and doubled braces for braces."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mark = md5(sf_dir.encode()).hexdigest()[:10]

        def view(m: re.Match) -> str:
            of = f"{m.group(1)}_{mark}"
            table(spark, sf_dir, m.group(1)).createOrReplaceTempView(of)
            return of

        return spark.sql(_TABLE.sub(view, text).replace("{{", "{").replace("}}", "}"))

    run.__name__, run.__doc__ = name, doc
    return run
