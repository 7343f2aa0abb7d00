"""More operators in SQL: matrices, plans, guards, sets, lookups - and the sequential ones as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.functions import dims
from lavra.operators import structure
from lavra.plans.sql import plan
from lavra.queries.relational import (
    BEST_D, BEST_S, C_D, C_S, DATES, EV_D, EV_S, FE_D, FE_S, FINE, GRP, LINES_D, LINES_S, PG_D, PG_S, RATES, date_d, date_s, fold_d, fold_s, norm_d, norm_s,
)
from lavra.sources.tables import table


def both(name: str, doc: str, text: str, **parts: tuple[str, str]) -> tuple[str, str, str, str]:
    """An entry whose texts differ only in named parts, written ``<part>``."""
    spark = duck = text
    for key, (s, d) in {"C": (C_S, C_D), "FE": (FE_S, FE_D), "PG": (PG_S, PG_D), "EV": (EV_S, EV_D), "BEST": (BEST_S, BEST_D), "LINES": (LINES_S, LINES_D), **parts}.items():
        spark, duck = spark.replace(f"<{key}>", s), duck.replace(f"<{key}>", d)
    for t in ("policy_extraction", "processed_documents", "evidence_chunks", "clauses", "page_text", "field_evidence", "events", "golden_anchors", "documents", "embeddings", "orders", "customer"):
        spark, duck = spark.replace(f"[{t}]", "{" + t + "}"), duck.replace(f"[{t}]", t)
    return name, doc, spark, duck


def n_if(condition: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


ENTRIES = [
    both("t04_lower_fold", "Lower-case titles without accents, white space kept", "SELECT document_id, clause_id, <f> AS value FROM <C>", f=("translate(lower(title), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn')", "strip_accents(lower(title))")),
    both("t05_words", "Plain words of a title", "SELECT document_id, clause_id, <f> AS value FROM <C>", f=("array_join(regexp_extract_all(translate(lower(title), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '[a-z0-9]+', 0), ' ')", "array_to_string(regexp_extract_all(strip_accents(lower(title)), '[a-z0-9]+'), ' ')")),
    both("t21_signature", "Signature of a document's fields in order", "SELECT document_id, <h> AS signature FROM <BEST> GROUP BY document_id", h=("sha2(array_join(transform(array_sort(collect_list(struct(field_name, evidence_id))), x -> concat(x.field_name, ':', x.evidence_id)), '|'), 256)", "sha256(string_agg(field_name || ':' || evidence_id, '|' ORDER BY field_name, evidence_id))")),
    both("d11_heading_batches", "Unclassified headings in batches of twenty", "SELECT document_id, clause_id, CAST(floor((row_number() OVER (PARTITION BY document_id ORDER BY clause_id) - 1) / 20) AS BIGINT) AS batch FROM <C> WHERE category = 'nao_classificada'"),
    # validation
    both("check_p09_downgrade", "Evidence found but of low confidence becomes ambiguous, nothing else changes", "SELECT evidence_id, CASE WHEN status = 'FOUND' AND coalesce(confianca, 0) < 0.5 THEN 'AMBIGUOUS' ELSE status END AS status FROM <FE>"),
    both("check_p10_valid_ids", "Rows with ill-formed identifiers", "SELECT DISTINCT document_id FROM [clauses] WHERE NOT <f>", f=("(document_id RLIKE '^[0-9a-f]{{64}}$' AND clause_id RLIKE '^clause-[0-9]{{4}}$')", "(regexp_matches(document_id, '^[0-9a-f]{64}$') AND regexp_matches(clause_id, '^clause-[0-9]{4}$'))")),
    both("check_p12_group_view", "Fields of the group LIMITS of each document", f"WITH {GRP} SELECT b.document_id, b.field_name, b.evidence_id FROM <BEST> b JOIN grp g ON g.field_name = b.field_name WHERE g.group_id = 'LIMITS'"),
    # joins
    both("j02_last_comparison", "Latest extraction of each candidate, null where there is none", "SELECT d.document_id, e.extraction_id FROM (SELECT DISTINCT sha256 AS document_id FROM [processed_documents]) d LEFT JOIN (SELECT document_id, max(extraction_id) AS extraction_id FROM [policy_extraction] GROUP BY document_id) e ON e.document_id = d.document_id"),
    both("j03_review_default", "Review status of each evidence, with a default", "SELECT f.evidence_id, coalesce(r.review, 'Não revisado') AS review FROM <FE> f LEFT JOIN (SELECT DISTINCT document_id, 'Confirmado' AS review FROM [policy_extraction] WHERE side_a = 'sim') r ON r.document_id = f.document_id"),
    both("j10_rate_lookup", "Events with the rate of their model", f"WITH {RATES} SELECT e.event_id, r.p_in FROM [events] e LEFT JOIN rates r ON r.model = e.event_type"),
    # aggregates
    both("a17_run_counts", "Attempts, completions and unknown outcomes of each run", f"SELECT user_id, count(*) AS attempts, {n_if("event_type = 'purchase'")} AS completed, {n_if("event_type = 'error'")} AS errors, count(*) - {n_if("event_type IN ('purchase', 'error')")} AS unknown FROM [events] GROUP BY user_id"),
    # ordering and sets
    both("o04_priority", "Fields of a document in the order of their groups", f"WITH {GRP} SELECT b.document_id, b.field_name, row_number() OVER (PARTITION BY b.document_id ORDER BY coalesce(g.group_id, 'ZZZ'), coalesce(g.field_order, 999), b.field_name) AS pos FROM <BEST> b LEFT JOIN grp g ON g.field_name = b.field_name"),
    both("u06_unique_candidates", "Distinct chunks of each document over all clauses", "SELECT document_id, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT clause_id) AS n_clauses FROM [evidence_chunks] GROUP BY document_id"),
    both("u07_group_translation", "Groups of one registry that share fields with each of the other", f"WITH {GRP}, {FINE} SELECT DISTINCT g.group_id, f.group_id AS finer_group FROM grp g JOIN fine f ON f.field_name = g.field_name"),
    # admission
    both("l04_status_lattice", "Status of a field over all its evidence, strongest first", "SELECT document_id, field_name, CASE WHEN max(CASE WHEN status = 'TECHNICAL_UNAVAILABLE' THEN 1 ELSE 0 END) = 1 THEN 'TECHNICAL_UNAVAILABLE' WHEN max(CASE WHEN status = 'AMBIGUOUS' THEN 1 ELSE 0 END) = 1 THEN 'AMBIGUOUS' WHEN max(CASE WHEN status = 'FOUND' THEN 1 ELSE 0 END) = 1 THEN 'FOUND' WHEN max(CASE WHEN status = 'NOT_RETRIEVED' THEN 1 ELSE 0 END) = 1 THEN 'NOT_RETRIEVED' ELSE 'NOT_FOUND' END AS status FROM <FE> GROUP BY document_id, field_name"),
    # comparison
    # sinks
    both("k07_markdown_rows", "Evidence as Markdown table rows", r"SELECT evidence_id, concat('| ', coalesce(field_name, ''), ' | ', coalesce(replace(valor, '|', '\|'), ''), ' |') AS line FROM <FE>".replace("'\\|'", "concat(chr(92), '|')")),
    both("r23_anchor_validation", "Anchors with a missing quotation, page or field", "SELECT item_id FROM [golden_anchors] WHERE quote IS NULL OR trim(quote) = '' OR page_number < 1 OR field_name IS NULL"),
]

def d06_page_provenance(spark, sf_dir):
    """Characters of each clause by page."""
    return structure.page_provenance(table(spark, sf_dir, "clauses"), table(spark, sf_dir, "evidence_chunks").select("document_id", "clause_id", "page_number", "chunk_index", "text").distinct())


def d07_sub_chunks(spark, sf_dir):
    """Sub-chunks of all clauses with overlap, ending at spaces."""
    return structure.sub_chunks(table(spark, sf_dir, "clauses").select("document_id", "clause_id", "text").distinct(), ["document_id", "clause_id"])


def o08_batch_packing(spark, sf_dir):
    """Clauses of a document packed in order into batches of 6,000 characters."""
    items = table(spark, sf_dir, "clauses").select("document_id", "clause_id", F.length("text").alias("n")).distinct()
    return structure.pack_in_order(items, "document_id", "clause_id", "n", 6000)


_SEQUENTIAL = (d06_page_provenance, d07_sub_chunks, o08_batch_packing)
QUERIES = {name: plan(name, spark, doc) for name, doc, spark, _ in ENTRIES} | {f.__name__: f for f in _SEQUENTIAL}
ORACLES = {name: duck for name, _, _, duck in ENTRIES} | {
    # the rule of windows as a recursion: a window ends before its last space, the next begins 150 before that end
    "d07_sub_chunks": r"""WITH RECURSIVE b AS (SELECT DISTINCT document_id, clause_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM clauses WHERE text IS NOT NULL),
        w AS (SELECT document_id, clause_id, body, 0::BIGINT AS start, -1::BIGINT AS stop FROM b WHERE body <> ''
          UNION ALL SELECT document_id, clause_id, body, CASE WHEN stop < 0 THEN start ELSE skip END, end_ FROM (
            SELECT *, CASE WHEN pos + 1200 >= length(body) THEN length(body) ELSE CASE WHEN instr(reverse(substring(body, pos + 1, 1200)), ' ') BETWEEN 1 AND 1199 THEN pos + 1200 - instr(reverse(substring(body, pos + 1, 1200)), ' ') ELSE pos + 1200 END END AS end_, pos AS skip
            FROM (SELECT *, CASE WHEN stop < 0 THEN 0 ELSE greatest(stop - 150, start + 1) + length(substring(body, greatest(stop - 150, start + 1) + 1)) - length(regexp_replace(substring(body, greatest(stop - 150, start + 1) + 1), '^\s+', '')) END AS pos FROM w WHERE stop < length(body))) WHERE pos < length(body))
        SELECT document_id, clause_id, (row_number() OVER (PARTITION BY document_id, clause_id ORDER BY start) - 1)::INT AS chunk_index, piece AS text FROM (SELECT *, regexp_replace(substring(body, start + 1, stop - start), '^\s+|\s+$', '', 'g') AS piece FROM w WHERE stop >= 0) WHERE piece <> ''""",
    "o08_batch_packing": """WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY clause_id, n) AS rn FROM (SELECT DISTINCT document_id, clause_id, length(text) AS n FROM clauses)),
        p AS (SELECT document_id, 0::BIGINT AS rn, ''::VARCHAR AS clause_id, 0 AS open, 0::BIGINT AS room, 0 AS batch FROM (SELECT DISTINCT document_id FROM i)
          UNION ALL SELECT i.document_id, i.rn, i.clause_id, CASE WHEN i.n > 6000 OR i.n <= p.room THEN p.open ELSE p.open + 1 END, CASE WHEN i.n > 6000 THEN p.room WHEN i.n <= p.room THEN p.room - i.n ELSE 6000 - i.n END, CASE WHEN i.n > 6000 THEN -1 WHEN i.n <= p.room THEN p.open ELSE p.open + 1 END
          FROM p JOIN i ON i.document_id = p.document_id AND i.rn = p.rn + 1)
        SELECT document_id, clause_id, batch FROM p WHERE rn > 0""",
    "d06_page_provenance": f"""WITH o AS (SELECT document_id, clause_id, page_number, sum(length(text)) OVER (PARTITION BY document_id, clause_id ORDER BY page_number, chunk_index) AS e, length(text) AS n FROM (SELECT DISTINCT document_id, clause_id, page_number, chunk_index, text FROM evidence_chunks))
        SELECT document_id, clause_id, page_number, CAST(min(e - n) AS BIGINT) AS begin, CAST(max(e) AS BIGINT) AS end FROM o JOIN (SELECT DISTINCT document_id, clause_id FROM clauses) USING (document_id, clause_id) GROUP BY ALL""",
}
