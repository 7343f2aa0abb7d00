"""Queries of the text operators over the project's tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lavra.llm import encoding, leakage, lookalike, names, scan_noise, site_lines, splitting, truncation
from lavra.session import broadcast_if_small, cut
from lavra.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one insurer or policyholder."""
    return names.variant_pairs(names.link_names(names.spellings(table(spark, sf_dir, "policy_extraction"))))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with its entity's most frequent one."""
    return names.canonical_names(names.link_names(names.spellings(table(spark, sf_dir, "policy_extraction"))))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy lines of scanned pages by kind."""
    return scan_noise.noise(table(spark, sf_dir, "page_text")).select("page_id", "line_no", "kind")


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous readable paragraphs, without its noise and its source's repeated lines."""
    pages = table(spark, sf_dir, "page_text")
    found, fixes = scan_noise.noise_and_corrections(pages)
    return scan_noise.repaired_pages(pages, found, fixes, p5_found(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text holds characters standing for others."""
    evidence = lookalike.lookalikes(table(spark, sf_dir, "field_evidence"), "evidence", "evidence_id", "trecho_origem")
    pages = lookalike.lookalikes(table(spark, sf_dir, "page_text"), "page", "page_id", "text")
    return evidence.unionByName(pages).select("record_kind", "record_id")


def p4_quotes_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field: quotations, and those found on their page as stored and in canonical form."""
    evidence = (
        table(spark, sf_dir, "field_evidence")
        .where(F.col("pagina").isNotNull() & F.col("trecho_origem").isNotNull() & (F.col("trecho_origem") != "nao_localizado"))
        .select("evidence_id", "document_id", "field_name", F.col("pagina").alias("page_number"), "trecho_origem")
        .distinct()
        .withColumn("q", lookalike.canonical_column("trecho_origem"))
    )
    pages = (
        table(spark, sf_dir, "page_text")
        .where(F.col("text").isNotNull())
        .select("document_id", "page_number", "text")
        .distinct()
        .withColumn("c", lookalike.canonical_column("text"))
    )
    met = evidence.join(pages, ["document_id", "page_number"], "left").groupBy("field_name", "evidence_id").agg(
        F.max(F.coalesce(F.expr("contains(text, trecho_origem)"), F.lit(False))).alias("stored"),
        F.max(F.coalesce(F.expr("contains(c, q)"), F.lit(False))).alias("canonical"),
    )
    return met.groupBy("field_name").agg(
        F.count("*").alias("n_quotes"), F.count_if("stored").alias("n_as_stored"), F.count_if("canonical").alias("n_canonical")
    )


def _site_lines(spark: SparkSession, sf_dir: str):
    lines = site_lines.page_lines(table(spark, sf_dir, "page_text"))
    sources = site_lines.document_sources(table(spark, sf_dir, "processed_documents"))
    return lines, sources


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line that a source repeats in its documents."""
    lines, sources = _site_lines(spark, sf_dir)
    repeated = site_lines.repeated_keys(*site_lines.delta(lines, sources))
    return site_lines.occurrences(lines, sources, repeated).select("page_id", "line_no")


def p5_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that lose lines, without those lines."""
    lines, sources = _site_lines(spark, sf_dir)
    repeated = site_lines.repeated_keys(*site_lines.delta(lines, sources))
    found = site_lines.occurrences(lines, sources, repeated)
    pages = table(spark, sf_dir, "page_text").select("page_id", "document_id", "page_number", "text")
    return site_lines.clean_pages(pages, found)


def p5_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to rebuild when the later half of the deliveries arrives: documents with a line whose status crossed a threshold.

    The tables of the first half and the merged ones are written; only documents that hold a crossed line are looked at.
    """
    lines, sources = _site_lines(spark, sf_dir)
    first = table(spark, sf_dir, "processed_documents").groupBy(F.col("sha256").alias("document_id")).agg(F.min("delivery_id").alias("d"))
    early = first.where("d % 2 = 0").select("document_id")
    half = lambda kind: site_lines.delta(lines.join(early, "document_id", kind), sources.join(early, "document_id", kind))
    old = tuple(map(cut, half("left_semi")))
    merged = tuple(cut(site_lines.merge_counts(a, b)) for a, b in zip(old, half("left_anti")))
    crossed = site_lines.crossings(old, merged)
    where = lines.join(broadcast_if_small(crossed), ["key_a", "key_b"]).join(sources, ["document_id", "source_name"])
    return where.groupBy("page_id", "document_id").agg(F.countDistinct(F.when(F.col("crossed") > 0, F.col("line_no"))).alias("n_newly_repeated"), F.countDistinct(F.when(F.col("crossed") < 0, F.col("line_no"))).alias("n_no_longer"))


def p5_merged_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a repeated line by tables that were merged from two deltas; equal to ``p5_found``."""
    lines, sources = _site_lines(spark, sf_dir)
    early = table(spark, sf_dir, "processed_documents").groupBy(F.col("sha256").alias("document_id")).agg(F.min("delivery_id").alias("d")).where("d % 2 = 0").select("document_id")
    half = lambda kind: site_lines.delta(lines.join(early, "document_id", kind), sources.join(early, "document_id", kind))
    merged = (site_lines.merge_counts(a, b) for a, b in zip(half("left_semi"), half("left_anti")))
    return site_lines.occurrences(lines, sources, site_lines.repeated_keys(*merged)).select("page_id", "line_no")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses and chunks over the limit."""
    clauses = splitting.oversized(table(spark, sf_dir, "clauses").select("document_id", F.col("clause_id").alias("item_id"), "text"))
    chunks = splitting.oversized(table(spark, sf_dir, "evidence_chunks").select("document_id", F.col("chunk_id").alias("item_id"), "text"))
    both = clauses.select(F.lit("clause").alias("item_kind"), "document_id", "item_id").unionByName(
        chunks.select(F.lit("chunk").alias("item_kind"), "document_id", "item_id")
    )
    return both.distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all evidence chunks under the limit, numbered from 0 within clause and page."""
    chunks = table(spark, sf_dir, "evidence_chunks").select("chunk_id", "document_id", "clause_id", "page_number", "chunk_index", "text").distinct()
    return splitting.renumber(splitting.split_items(chunks))


def p6_clause_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all clauses, each with the page its first character stands on."""
    clauses = table(spark, sf_dir, "clauses").select("document_id", "clause_id", "page_start", "page_end", "text").distinct()
    chunks = table(spark, sf_dir, "evidence_chunks").select("document_id", "clause_id", "page_number", "chunk_index", F.length("text").alias("n")).distinct()
    return splitting.clause_pieces(clauses, chunks)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document's text."""
    return encoding.encode_table(spark, table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of evaluation items."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "golden_anchors"))


def p9_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items and the number of documents each leaked into."""
    items = table(spark, sf_dir, "golden_anchors")
    return leakage.leak_report(leakage.leaks(table(spark, sf_dir, "documents"), items), items)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stop in mid-word or mid-sentence."""
    return truncation.truncated(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of truncated documents of each source."""
    return truncation.truncation_rates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_canonical, p2_found, p2_pages, p4_found, p4_quotes_on_page, p5_found, p5_clean_pages, p5_incremental, p5_merged_found, p6_found, p6_pieces, p6_clause_pieces, p8_ids,
        p9_found, p9_leak_report, p10_found, p10_source_rates,
    )
}

ORACLES = {
    "p6_found": """
        SELECT DISTINCT 'clause' AS item_kind, document_id, clause_id AS item_id FROM clauses
        WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 1200
        UNION ALL
        SELECT DISTINCT 'chunk', document_id, chunk_id FROM evidence_chunks
        WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 1200""",
}
