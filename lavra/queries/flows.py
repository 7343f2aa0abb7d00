"""Operators of the library applied to whole tables: sinks, vectors, answers, and sequential structuring."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lavra.functions import dims
from lavra.operators import retrieval as R, sinks, vectors as V
from lavra.plans.dialect import DUCK
from lavra.queries.retrieval import _TOP
from lavra.sources.tables import table

#: An answer rests on passages no farther than this; beyond it the question stays unanswered.
ANSWER_DISTANCE = 0.9


def _latest(rows):
    best = F.max(F.struct("stored_at", "extraction_id")).alias("b")
    return rows.groupBy("document_id").agg(best).select("document_id", "b.extraction_id", "b.stored_at")


def k02_upsert(spark, sf_dir):
    """Extractions of one half merged into those of the other: one row a document, the newer half winning."""
    rows = table(spark, sf_dir, "policy_extraction").select("document_id", "extraction_id", "stored_at").distinct()
    old, new = _latest(rows.where("extraction_id % 2 = 0")), _latest(rows.where("extraction_id % 2 = 1"))
    return sinks.upsert(old, new, ["document_id"]).select("document_id", "extraction_id")


def _stored_chunks(spark, sf_dir):
    return table(spark, sf_dir, "evidence_chunks").select("document_id", "clause_id", "chunk_id", "chunk_index").distinct()


def k03_vector_upsert(spark, sf_dir):
    """Chunks after a new write of a quarter of the documents: theirs are replaced as a whole, stale ones pruned."""
    old = _stored_chunks(spark, sf_dir)
    new = old.where("document_id < '4' AND chunk_index = 0").withColumn("chunk_id", F.concat("chunk_id", F.lit(":new")))
    return sinks.replace_children(old, new, "document_id").select("document_id", "chunk_id")


def k04_delete_document(spark, sf_dir):
    """Chunks that stay when the documents of one source are deleted."""
    gone = table(spark, sf_dir, "processed_documents").groupBy("sha256").agg(F.min("source_name").alias("s")).where("s = 'Acervo Jaburu'").select(F.col("sha256").alias("document_id"))
    return _stored_chunks(spark, sf_dir).join(gone, "document_id", "left_anti").select("document_id", "chunk_id")


def u03_overlap(spark, sf_dir):
    """Query terms of every field that a clause holds, with their number."""
    terms = F.broadcast(dims.terms(spark))
    held = R.prepare(table(spark, sf_dir, "clauses")).select("document_id", "clause_id", F.explode(F.array_distinct("words")).alias("term")).join(terms, "term")
    return held.groupBy("document_id", "clause_id", "field_name").agg(F.count("*").alias("shared"), F.array_join(F.array_sort(F.collect_set("term")), "+").alias("terms"))


def v03_unit_vectors(spark, sf_dir):
    """Length of every vector once scaled; null where it cannot be."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("u"))
    return vectors.select("vec_id", F.round(F.sqrt(V.dot(F.col("u"), F.col("u"))), 6).alias("length"))


def _hash_encoder(texts: pd.Series) -> pd.Series:
    """A stand-in for a model: eight numbers from a text's hash."""
    return texts.map(lambda t: (np.frombuffer(hashlib.sha256(t.encode()).digest()[:8], dtype=np.uint8) + 1.0).tolist())


def v04_encode_misses(spark, sf_dir):
    """Clause titles with vectors, of which a part was cached: rows, and texts encoded anew, by first sign of the hash."""
    titles = table(spark, sf_dir, "clauses").select("id", "title").distinct()
    cache = titles.where("title IS NOT NULL").select(F.lit("m").alias("model"), F.sha2("title", 256).alias("text_hash")).distinct().where("text_hash < '8'").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    rows, misses = V.encode_misses(titles, cache, "m", _hash_encoder, "title")
    sign = F.substring("text_hash", 1, 1).alias("sign")
    counted = rows.where("text_hash IS NOT NULL").groupBy(sign).agg(F.count("*").alias("n_rows"), F.count("embedding").alias("n_vectors"))
    return counted.join(misses.groupBy(sign).agg(F.count("*").alias("n_encoded")), "sign", "left").fillna(0, ["n_encoded"])


def v06_local_filter(spark, sf_dir):
    """The nearest ten of all labels, filtered again by the query's label and cut to five."""
    vectors = table(spark, sf_dir, "embeddings")
    found = V.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)
    labels = vectors.select("vec_id", "label").distinct()
    both = found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").where("label = wanted")
    return sinks.first_of(both, ["query_id"], ["distance", "vec_id"], 5).select("query_id", "vec_id", "distance")


def l06_answer(spark, sf_dir):
    """Answers that cite retrieved passages only: the nearest two within reach, else no answer and no citation."""
    vectors = table(spark, sf_dir, "embeddings")
    found = V.top_k(vectors, vectors.where("vec_id % 100 = 0"), 5, "label")
    cited = F.filter(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "distance"))), lambda x: (x["rank"] <= 2) & (x["distance"] <= ANSWER_DISTANCE))
    grouped = found.groupBy("query_id").agg(F.count("*").alias("retrieved"), cited.alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["vec_id"].cast("string")), ",")
    return grouped.select("query_id", "retrieved", F.when(F.size("c") > 0, "answered").otherwise("nao_localizado").alias("answer"), text.alias("citations"))


QUERIES = {f.__name__: f for f in (k02_upsert, k03_vector_upsert, k04_delete_document, u03_overlap, v03_unit_vectors, v04_encode_misses, v06_local_filter, l06_answer)}
_CHUNKS = "(SELECT DISTINCT document_id, clause_id, chunk_id, chunk_index FROM evidence_chunks)"
_NEAR = _TOP.format("", 10).replace("SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM", "SELECT query_id, vec_id, d, rank FROM", 1)
ORACLES = {
    "k02_upsert": """WITH x AS (SELECT DISTINCT document_id, extraction_id, stored_at FROM policy_extraction), l AS (SELECT document_id, extraction_id % 2 AS half, arg_max(extraction_id, {'a': stored_at, 'b': extraction_id}) AS extraction_id FROM x GROUP BY ALL)
        SELECT document_id, extraction_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY half DESC) AS rn FROM l) WHERE rn = 1""",
    "k03_vector_upsert": f"SELECT document_id, chunk_id || ':new' AS chunk_id FROM {_CHUNKS} WHERE document_id < '4' AND chunk_index = 0 UNION ALL SELECT document_id, chunk_id FROM {_CHUNKS} o WHERE document_id NOT IN (SELECT document_id FROM evidence_chunks WHERE document_id < '4' AND chunk_index = 0)",
    "k04_delete_document": f"SELECT document_id, chunk_id FROM {_CHUNKS} WHERE document_id NOT IN (SELECT sha256 FROM processed_documents GROUP BY sha256 HAVING min(source_name) = 'Acervo Jaburu')",
    "u03_overlap": f"WITH {dims.values_sql(dims.term_rows(), 'terms', 'field_name, term, n_terms')}, w AS (SELECT DISTINCT document_id, clause_id, unnest(string_split({DUCK.words(chr(39).join(('coalesce(text, ', '', ')')))}, ' ')) AS term FROM clauses) SELECT document_id, clause_id, field_name, count(*) AS shared, string_agg(term, '+' ORDER BY term) AS terms FROM w JOIN terms USING (term) GROUP BY ALL",
    "v03_unit_vectors": "SELECT vec_id, CASE WHEN list_sum(list_transform(embedding, lambda x: abs(x))) > 0 THEN 1.0::DOUBLE END AS length FROM embeddings",
    "v04_encode_misses": """WITH t AS (SELECT DISTINCT id, title, sha256(title) AS h FROM clauses WHERE title IS NOT NULL) SELECT substring(h, 1, 1) AS sign, count(*) AS n_rows, count(*) AS n_vectors, count(DISTINCT CASE WHEN h >= '8' THEN h END) AS n_encoded FROM t GROUP BY 1""",
    "v06_local_filter": f"SELECT query_id, vec_id, round(d, 6) AS distance FROM (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), n.vec_id) AS rn FROM ({_NEAR}) n JOIN embeddings v ON v.vec_id = n.vec_id JOIN embeddings q ON q.vec_id = n.query_id WHERE v.label = q.label) WHERE rn <= 5",
    "l06_answer": f"SELECT query_id, count(*) AS retrieved, CASE WHEN count(*) FILTER (rank <= 2 AND distance <= {ANSWER_DISTANCE}) > 0 THEN 'answered' ELSE 'nao_localizado' END AS answer, coalesce(string_agg(vec_id, ',' ORDER BY rank) FILTER (rank <= 2 AND distance <= {ANSWER_DISTANCE}), '') AS citations FROM ({_TOP.format('AND q.label = v.label', 5)}) GROUP BY query_id",
}
