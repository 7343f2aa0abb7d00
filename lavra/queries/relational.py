"""Operators that SQL expresses: scalars, structuring, validation, joins, aggregates, ordering, telemetry, comparison.

Each entry is (name, what it does, Spark SQL, SQL to compare with).  ``{table}`` in the Spark text is a table of the
folder; fixed values of the domain (patterns, marker texts, orders of precedence) stand in the text as they are.
"""

from __future__ import annotations

from lavra.functions import dims
from lavra.plans.sql import plan

ACC_S = "translate(lower(replace({0}, 'ß', 'ss')), 'áàâãäåéèêëíìîïóòôõöúùûüçñý', 'aaaaaaeeeeiiiiooooouuuucny')"
ACC_D = "strip_accents(lower(replace({0}, 'ß', 'ss')))"
COLLAPSE_S = r"trim(regexp_replace({0}, '\\s+', ' '))"
COLLAPSE_D = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"

# rows once each, without their texts: no text takes part in removing duplicates
C_S = "(SELECT DISTINCT id, document_id, clause_id, title, category, page_start, page_end FROM {clauses})"
C_D = "(SELECT DISTINCT * FROM clauses)"
FE_S = "(SELECT DISTINCT evidence_id, document_id, source_name, field_name, valor, pagina, confianca, status, trecho_origem IS NULL AS no_quote FROM {field_evidence})"
FE_D = "(SELECT DISTINCT * FROM field_evidence)"
PG_S = "(SELECT DISTINCT page_id, document_id, page_number, extraction_method FROM {page_text})"
PG_D = "(SELECT DISTINCT * FROM page_text)"


def fold_s(x: str) -> str:
    return COLLAPSE_S.format(ACC_S.format(x))


def fold_d(x: str) -> str:
    return COLLAPSE_D.format(ACC_D.format(x))


# The shape of a heading, in both dialects.
HEADING_S = r"(length(trim(line)) BETWEEN 1 AND 140 AND (trim(line) RLIKE '(?i)^(cl[aá]usula\\s+)?[0-9]+(\\.[0-9]+)*[.)\\s-]+[^0-9]' OR (length(regexp_replace(line, '[^\\p{L}]', '')) >= 6 AND regexp_replace(line, '[^\\p{L}]', '') = upper(regexp_replace(line, '[^\\p{L}ªº]', '')))))"
HEADING_D = r"(length(trim(line)) BETWEEN 1 AND 140 AND (regexp_matches(trim(line), '(?i)^(cl[aá]usula\s+)?[0-9]+(\.[0-9]+)*[.)\s-]+[^0-9]') OR (length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 6 AND regexp_replace(line, '[^\p{L}]', '', 'g') = upper(regexp_replace(line, '[^\p{L}ªº]', '', 'g')))))"

# Categories by the patterns of a title, in order.
CATEGORY = [
    ("exclu", "exclusoes"), ("definic|glossario", "definicoes"), ("vigencia|periodo de seguro", "vigencia"), ("limite|franquia|retencao|premio|sublimite", "limites"),
    ("cobertura|garantia|side [abc]|defesa", "coberturas"), ("objeto", "objeto"), ("sinistro|reclamac|notificac", "sinistro"), ("territor|jurisdic", "territorialidade"),
    ("cancelamento|renovacao", "cancelamento_renovacao"),
]
CATEGORY_S = "CASE " + " ".join(f"WHEN f RLIKE '{p}' THEN '{c}'" for p, c in CATEGORY) + " ELSE 'nao_classificada' END"
CATEGORY_D = "CASE " + " ".join(f"WHEN regexp_matches(f, '{p}') THEN '{c}'" for p, c in CATEGORY) + " ELSE 'nao_classificada' END"

# telemetry: events stand for model requests
EV_S = "(SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(get_json_object(props, '$.k') AS BIGINT) END AS tokens FROM {events})"
EV_D = "(SELECT *, (props->>'$.k')::BIGINT AS k, CASE WHEN event_type = 'signup' THEN NULL ELSE (props->>'$.k')::BIGINT END AS tokens FROM events)"

# consolidated evidence: highest confidence, first id on ties
BEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY confianca DESC NULLS LAST, evidence_id) AS rn FROM {fe}) WHERE rn = 1)"
BEST_S, BEST_D = BEST.format(fe=FE_S), BEST.format(fe=FE_D)
MONEY = "('limite_maximo_garantia', 'retencao_franquia', 'premio')"
DATES = "('vigencia_inicio', 'vigencia_fim', 'data_retroativa')"
IDENTITY = "('seguradora', 'numero_apolice', 'tomador_segurado')"


def date_s(x: str) -> str:
    return (
        f"CASE WHEN {x} RLIKE '^[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}$' THEN try_cast({x} AS DATE) WHEN {x} RLIKE '^[0-9]{{{{1,2}}}}[/-][0-9]{{{{1,2}}}}[/-][0-9]{{{{4}}}}$' THEN"
        f" try_cast(concat_ws('-', right({x}, 4), lpad(split({x}, '[/-]')[1], 2, '0'), lpad(split({x}, '[/-]')[0], 2, '0')) AS DATE) END"
    )


def date_d(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast({x} AS DATE) WHEN regexp_matches({x}, '^[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}}$') THEN"
        f" try_cast(right({x}, 4) || '-' || lpad(regexp_extract({x}, '[/-]([0-9]+)[/-]', 1), 2, '0') || '-' || lpad(regexp_extract({x}, '^([0-9]+)', 1), 2, '0') AS DATE) END"
    )


def currency(x: str, spark: bool) -> str:
    """The code of the only currency named, else null."""
    test = (lambda p: f"({x} RLIKE '{p}')") if spark else (lambda p: f"regexp_matches({x}, '{p}')")
    b = "\\\\b" if spark else "\\b"
    d = "\\\\$" if spark else "\\$"
    codes = {"BRL": f"r{d}|{b}brl{b}|{b}reais{b}|{b}real{b}", "USD": f"us{d}|{b}usd{b}|{b}dolares{b}", "EUR": f"€|{b}eur{b}|{b}euros?{b}", "GBP": f"£|{b}gbp{b}"}
    count = " + ".join(f"(CASE WHEN {test(p)} THEN 1 ELSE 0 END)" for p in codes.values())
    return f"CASE WHEN ({count}) <> 1 THEN NULL " + " ".join(f"WHEN {test(p)} THEN '{c}'" for c, p in codes.items()) + " END"


def norm_s(x: str) -> str:
    return COLLAPSE_S.format(f"lower(replace({x}, 'ß', 'ss'))")


def norm_d(x: str) -> str:
    return COLLAPSE_D.format(f"lower(replace({x}, 'ß', 'ss'))")


LINES_S = f"lines AS (SELECT document_id, page_number, pos + 1 AS line_no, line FROM {{page_text}} LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line WHERE text IS NOT NULL)"
LINES_D = f"lines AS (SELECT document_id, page_number, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM {PG_D} WHERE text IS NOT NULL)"
FIRST = "max(CASE WHEN page_line = 1 AND NOT heading THEN 1 ELSE 0 END) OVER (PARTITION BY document_id)"


def sections(heading: str, lines: str) -> str:
    """Lines with running section numbers; a first line without heading opens section 1."""
    return f"""{lines},
marked AS (SELECT *, {heading} AS heading, row_number() OVER (PARTITION BY document_id ORDER BY page_number, line_no) AS page_line FROM lines),
sections AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING) + {FIRST} AS section FROM marked)"""


SECTIONS_S, SECTIONS_D = sections(HEADING_S, LINES_S).replace("FROM lines)", "FROM (SELECT DISTINCT * FROM lines))"), sections(HEADING_D, LINES_D)
GRP = dims.values_sql(dims.group_rows(dims.GROUPS), "grp", "group_id, field_name, field_order")
FINE = dims.values_sql(dims.group_rows(dims.FINER_GROUPS), "fine", "group_id, field_name, field_order")
RATES = "rates(model, p_in, p_out) AS (VALUES ('click', CAST(0.25 AS DOUBLE), CAST(2.0 AS DOUBLE)), ('view', CAST(1.25 AS DOUBLE), CAST(10.0 AS DOUBLE)), ('purchase', CAST(5.0 AS DOUBLE), CAST(30.0 AS DOUBLE)))"

ENTRIES: list[tuple[str, str, str, str]] = [
    # text scalars
    ("t01_normalize", "Case-folded titles with single spaces", f"SELECT document_id, clause_id, {norm_s('title')} AS value FROM {C_S}", f"SELECT document_id, clause_id, {norm_d('title')} AS value FROM {C_D}"),
    ("t02_fold", "Folded titles without accents", f"SELECT document_id, clause_id, {fold_s('title')} AS value FROM {C_S}", f"SELECT document_id, clause_id, {fold_d('title')} AS value FROM {C_D}"),
    ("t07_term_counts", "Words of a title with their counts", f"SELECT term, count(*) AS n FROM (SELECT explode(split({fold_s('title')}, ' ')) AS term FROM {C_S} WHERE title IS NOT NULL) GROUP BY term", f"SELECT term, count(*) AS n FROM (SELECT unnest(string_split({fold_d('title')}, ' ')) AS term FROM {C_D} WHERE title IS NOT NULL) GROUP BY term"),
    ("t09_markdown_escape", "Values escaped for Markdown", r"SELECT evidence_id, replace(regexp_replace(valor, '([\\\\*_{{}}\\[\\]<>#|])', '\\\\$1'), chr(96), concat(chr(92), chr(96))) AS value FROM " + FE_S, r"SELECT evidence_id, replace(regexp_replace(valor, '([\\*_{}\[\]<>#|])', '\\\1', 'g'), chr(96), chr(92) || chr(96)) AS value FROM " + FE_D),
    ("t10_citation", "Citation of a source and page", f"SELECT evidence_id, CASE WHEN pagina IS NULL THEN concat(source_name, ': nao_localizado (sem página inferida)') ELSE concat(source_name, ', p. ', pagina) END AS value FROM {FE_S}", f"SELECT evidence_id, CASE WHEN pagina IS NULL THEN source_name || ': nao_localizado (sem página inferida)' ELSE source_name || ', p. ' || pagina END AS value FROM {FE_D}"),
    ("t11_sha256", "Hash of each text", f"SELECT DISTINCT chunk_id, sha2(text, 256) AS digest FROM {{evidence_chunks}}", "SELECT DISTINCT chunk_id, sha256(text) AS digest FROM evidence_chunks"),
    ("t13_safe_identifier", "Whether a cache key is a safe identifier", "SELECT delivery_id, coalesce(cache_key RLIKE '^[A-Za-z0-9][A-Za-z0-9_.:-]{{0,127}}$', false) AS safe FROM {processed_documents}", "SELECT delivery_id, coalesce(regexp_matches(cache_key, '^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$'), false) AS safe FROM processed_documents"),
    # numeric, currency, date scalars
    ("n01_currency", "The only currency a value names", f"SELECT evidence_id, {currency('f', True)} AS code FROM (SELECT evidence_id, {fold_s('valor')} AS f FROM {FE_S})", f"SELECT evidence_id, {currency('f', False)} AS code FROM (SELECT evidence_id, {fold_d('valor')} AS f FROM {FE_D})"),
    ("n06_day_distance", "Distance of deliveries of a document by bucket", "SELECT sha256, CASE WHEN d <= 366 THEN 'ate_um_ano' WHEN d <= 1098 THEN 'ate_tres_anos' ELSE 'mais' END AS bucket FROM (SELECT sha256, datediff(max(processed_at), min(processed_at)) AS d FROM {processed_documents} GROUP BY sha256)", "SELECT sha256, CASE WHEN d <= 366 THEN 'ate_um_ano' WHEN d <= 1098 THEN 'ate_tres_anos' ELSE 'mais' END AS bucket FROM (SELECT sha256, datediff('day', min(processed_at), max(processed_at)) AS d FROM processed_documents GROUP BY sha256)"),
    ("n09_valid_numbers", "Confidences that are numbers from 0 to 1", f"SELECT evidence_id, CASE WHEN confianca >= 0 AND confianca <= 1 THEN confianca END AS confidence FROM {FE_S}", f"SELECT evidence_id, CASE WHEN confianca >= 0 AND confianca <= 1 THEN confianca END AS confidence FROM {FE_D}"),
    # structuring
    ("d01_lines", "Lines of all pages", f"WITH {LINES_S} SELECT DISTINCT document_id, page_number, line_no, sha2(line, 256) AS line_hash FROM lines", f"WITH {LINES_D} SELECT document_id, page_number, line_no, sha256(line) AS line_hash FROM lines"),
    ("d03_category", "Category of a title, first matching rule", f"SELECT document_id, clause_id, {CATEGORY_S} AS category FROM (SELECT document_id, clause_id, coalesce({fold_s('title')}, '') AS f FROM {C_S})", f"SELECT document_id, clause_id, {CATEGORY_D} AS category FROM (SELECT document_id, clause_id, coalesce({fold_d('title')}, '') AS f FROM {C_D})"),
    ("d05_fixed_chunks", "Section text cut at multiples of 400 characters, blank chunks dropped, then numbered", f"""WITH {SECTIONS_S}, texts AS (SELECT document_id, section, array_join(transform(array_sort(collect_list(struct(page_number, line_no, line))), x -> x.line), '\\n') AS text FROM sections GROUP BY document_id, section),
        cut AS (SELECT document_id, section, k, substring(text, k * 400 + 1, 400) AS piece FROM texts LATERAL VIEW explode(sequence(0, greatest(0, CAST(ceil(length(text) / 400) AS INT) - 1))) t AS k)
        SELECT document_id, concat('clause-', lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY section, k) AS STRING), 4, '0')) AS clause_id, sha2(piece, 256) AS digest FROM cut WHERE piece RLIKE '\\\\S'""",
     f"""WITH {SECTIONS_D}, texts AS (SELECT document_id, section, string_agg(line, chr(10) ORDER BY page_number, line_no) AS text FROM sections GROUP BY document_id, section),
        cut AS (SELECT document_id, section, k, substring(text, k * 400 + 1, 400) AS piece FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(text) / 400) AS BIGINT)))) AS k FROM texts))
        SELECT document_id, 'clause-' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY section, k) AS VARCHAR), 4, '0') AS clause_id, sha256(piece) AS digest FROM cut WHERE regexp_matches(piece, '\\S')"""),
    ("d08_chunk_ids", "Composite chunk identifiers", "SELECT DISTINCT chunk_id, concat_ws(':', document_id, clause_id, concat('p', page_number), concat('c', chunk_index)) AS composite FROM {evidence_chunks}", "SELECT DISTINCT chunk_id, concat_ws(':', document_id, clause_id, 'p' || page_number, 'c' || chunk_index) AS composite FROM evidence_chunks"),
    # validation
    ("check_p01_projection", "Documents without their large columns", "SELECT DISTINCT delivery_id, sha256 AS document_id, source_name, stored_at FROM {processed_documents}", "SELECT DISTINCT delivery_id, sha256 AS document_id, source_name, stored_at FROM processed_documents"),
    ("check_p02_range_checks", "Deliveries that break a range constraint", "SELECT delivery_id FROM {processed_documents} WHERE size_bytes <= 0 OR page_count < 1 OR NOT sha256 RLIKE '^[0-9a-f]{{64}}$'", "SELECT delivery_id FROM processed_documents WHERE size_bytes <= 0 OR page_count < 1 OR NOT regexp_matches(sha256, '^[0-9a-f]{64}$')"),
    ("check_p03_all_or_nothing", "Evidence that is neither wholly located nor wholly missing", f"SELECT evidence_id FROM {FE_S} WHERE CASE WHEN coalesce(valor, 'nao_localizado') = 'nao_localizado' THEN pagina IS NOT NULL ELSE pagina IS NULL OR no_quote OR coalesce(confianca, 0) <= 0 END", f"SELECT evidence_id FROM {FE_D} WHERE CASE WHEN coalesce(valor, 'nao_localizado') = 'nao_localizado' THEN pagina IS NOT NULL ELSE pagina IS NULL OR trecho_origem IS NULL OR coalesce(confianca, 0) <= 0 END"),
    ("check_p04_status_consistency", "Evidence whose status contradicts its value", f"SELECT evidence_id FROM {FE_S} WHERE (status = 'FOUND' AND coalesce(valor, 'nao_localizado') = 'nao_localizado') OR (status LIKE 'NOT_%' AND coalesce(valor, 'nao_localizado') <> 'nao_localizado')", f"SELECT evidence_id FROM {FE_D} WHERE (status = 'FOUND' AND coalesce(valor, 'nao_localizado') = 'nao_localizado') OR (status LIKE 'NOT_%' AND coalesce(valor, 'nao_localizado') <> 'nao_localizado')"),
    ("check_p15_pending_fields", "Fields of a document still to be worked on", f"SELECT document_id, field_name FROM {BEST_S} WHERE valor IS NULL OR valor = 'nao_localizado' OR status IN ('AMBIGUOUS', 'NOT_RETRIEVED') OR coalesce(confianca, 0) < 0.5", f"SELECT document_id, field_name FROM {BEST_D} WHERE valor IS NULL OR valor = 'nao_localizado' OR status IN ('AMBIGUOUS', 'NOT_RETRIEVED') OR coalesce(confianca, 0) < 0.5"),
    ("check_p18_required_fields", "Documents without a located required field", f"SELECT DISTINCT x.document_id, r.field_name FROM {FE_S} x JOIN (VALUES ('seguradora'), ('numero_apolice'), ('limite_maximo_garantia')) r(field_name) LEFT ANTI JOIN {FE_S} f ON f.document_id = x.document_id AND f.field_name = r.field_name AND f.status = 'FOUND'", f"SELECT DISTINCT x.document_id, r.field_name FROM {FE_D} x, (VALUES ('seguradora'), ('numero_apolice'), ('limite_maximo_garantia')) r(field_name) WHERE NOT EXISTS (SELECT 1 FROM field_evidence f WHERE f.document_id = x.document_id AND f.field_name = r.field_name AND f.status = 'FOUND')"),
    # joins
    ("j04_hits_to_metadata", "Metadata of the chunks named by evidence", f"SELECT e.evidence_id, count(DISTINCT c.clause_id) AS n_clauses FROM {FE_S} e JOIN {C_S} c ON c.document_id = e.document_id AND e.pagina BETWEEN c.page_start AND c.page_end GROUP BY e.evidence_id", f"SELECT e.evidence_id, count(DISTINCT c.clause_id) AS n_clauses FROM {FE_D} e JOIN {C_D} c ON c.document_id = e.document_id AND e.pagina BETWEEN c.page_start AND c.page_end GROUP BY e.evidence_id"),
    ("j05_unknown_citations", "Evidence that cites a page its document does not have", f"SELECT e.evidence_id FROM {FE_S} e LEFT ANTI JOIN {PG_S} p ON p.document_id = e.document_id AND p.page_number = e.pagina WHERE e.pagina IS NOT NULL", f"SELECT e.evidence_id FROM {FE_D} e WHERE e.pagina IS NOT NULL AND NOT EXISTS (SELECT 1 FROM page_text p WHERE p.document_id = e.document_id AND p.page_number = e.pagina)"),
    ("j08_page_neighbours", "Pages next to each cited page", f"SELECT DISTINCT e.document_id, p.page_number FROM (SELECT DISTINCT document_id, explode(array(pagina - 1, pagina, pagina + 1)) AS page_number FROM {{field_evidence}} WHERE pagina IS NOT NULL) e JOIN {PG_S} p ON p.document_id = e.document_id AND p.page_number = e.page_number", "SELECT DISTINCT p.document_id, p.page_number FROM page_text p JOIN (SELECT DISTINCT document_id, pagina FROM field_evidence) e ON e.document_id = p.document_id AND p.page_number BETWEEN e.pagina - 1 AND e.pagina + 1"),
    ("j09_continuation", "The next two clauses, where the page goes on", f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_start, clause_id) AS pos FROM {C_S}) SELECT a.document_id, a.clause_id, b.clause_id AS next_id FROM o a JOIN o b ON a.document_id = b.document_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 2 AND b.page_start <= a.page_end + 1", f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_start, clause_id) AS pos FROM {C_D}) SELECT a.document_id, a.clause_id, b.clause_id AS next_id FROM o a JOIN o b ON a.document_id = b.document_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 2 AND b.page_start <= a.page_end + 1"),
    ("j13_field_groups", "Group of each field in both registries, and groups that share fields", f"WITH {GRP}, {FINE} SELECT g.group_id, f.group_id AS finer_group, count(*) AS n_fields FROM grp g JOIN fine f ON f.field_name = g.field_name GROUP BY g.group_id, f.group_id", f"WITH {GRP}, {FINE} SELECT g.group_id, f.group_id AS finer_group, count(*) AS n_fields FROM grp g JOIN fine f ON f.field_name = g.field_name GROUP BY g.group_id, f.group_id"),
    ("j15_orphans", "Chunks whose document was never delivered", "SELECT DISTINCT c.chunk_id FROM {evidence_chunks} c LEFT ANTI JOIN {processed_documents} d ON d.sha256 = c.document_id", "SELECT DISTINCT c.chunk_id FROM evidence_chunks c WHERE c.document_id NOT IN (SELECT sha256 FROM processed_documents)"),
    # aggregates
    ("a01_null_poisoned_sum", "Totals that are unknown where one part is, with the known part", f"SELECT user_id, count(*) AS requests, CASE WHEN count(*) = count(tokens) THEN coalesce(sum(tokens), 0) END AS tokens, coalesce(sum(tokens), 0) AS known_tokens FROM {EV_S} GROUP BY user_id", f"SELECT user_id, count(*) AS requests, CASE WHEN count(*) = count(tokens) THEN CAST(coalesce(sum(tokens), 0) AS BIGINT) END AS tokens, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS known_tokens FROM {EV_D} GROUP BY user_id"),
    ("a02_counters", "Requests of unknown usage and failures by user", f"SELECT user_id, count_if(tokens IS NULL) AS unknown_usage, count_if(event_type = 'error') AS failures FROM {EV_S} GROUP BY user_id", f"SELECT user_id, count(*) FILTER (tokens IS NULL) AS unknown_usage, count(*) FILTER (event_type = 'error') AS failures FROM {EV_D} GROUP BY user_id"),
    ("a03_by_model", "Totals by model", f"SELECT event_type AS model, count(*) AS requests, coalesce(sum(tokens), 0) AS known_tokens FROM {EV_S} GROUP BY event_type", f"SELECT event_type AS model, count(*) AS requests, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS known_tokens FROM {EV_D} GROUP BY event_type"),
    ("a04_latency", "Interpolated median and nearest-rank 95th percentile", "SELECT event_type AS model, round(percentile(value, 0.5), 6) AS median_value, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM {events} GROUP BY event_type", "SELECT event_type AS model, round(quantile_cont(value, 0.5), 6) AS median_value, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type"),
    ("a06_canonical_events", "Cached parts larger than the whole are unknown", f"SELECT event_id, k, CASE WHEN value > k THEN NULL ELSE value END AS cached, CASE WHEN value > k THEN NULL ELSE round(k - value, 6) END AS uncached FROM {EV_S}", f"SELECT event_id, k, CASE WHEN value > k THEN NULL ELSE value END AS cached, CASE WHEN value > k THEN NULL ELSE round(k - value, 6) END AS uncached FROM {EV_D}"),
    ("a07_session_totals", "Session totals over globally distinct events", f"SELECT count(DISTINCT user_id) AS runs, count(*) AS events FROM (SELECT user_id, k, max(event_id) AS event_id FROM {EV_S} GROUP BY user_id, k)", f"SELECT count(DISTINCT user_id) AS runs, count(*) AS events FROM (SELECT user_id, k, max(event_id) AS event_id FROM {EV_D} GROUP BY user_id, k)"),
    ("a09_distinct_tiers", "Sorted set of event types of a user", "SELECT user_id, array_join(array_sort(collect_set(event_type)), '+') AS tiers FROM {events} GROUP BY user_id", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '+') AS tiers FROM events GROUP BY user_id"),
    ("a13_consolidation", "Evidence of highest confidence a field, and whether values conflict", f"SELECT b.document_id, b.field_name, b.evidence_id, n.k > 1 AS conflict FROM {BEST_S} b JOIN (SELECT document_id, field_name, count(DISTINCT {norm_s('valor')}) AS k FROM {FE_S} GROUP BY document_id, field_name) n ON n.document_id = b.document_id AND n.field_name = b.field_name", f"SELECT b.document_id, b.field_name, b.evidence_id, n.k > 1 AS conflict FROM {BEST_D} b JOIN (SELECT document_id, field_name, count(DISTINCT {norm_d('valor')}) AS k FROM {FE_D} GROUP BY document_id, field_name) n ON n.document_id = b.document_id AND n.field_name = b.field_name"),
    ("a14_metadata_resolution", "Language and source of a document where all deliveries agree", "SELECT sha256, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS lang, CASE WHEN count(DISTINCT source_name) = 1 THEN min(source_name) END AS source_name, count(DISTINCT source_name) > 1 AS conflict FROM {processed_documents} GROUP BY sha256", "SELECT sha256, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS lang, CASE WHEN count(DISTINCT source_name) = 1 THEN min(source_name) END AS source_name, count(DISTINCT source_name) > 1 AS conflict FROM processed_documents GROUP BY sha256"),
    ("a15_extraction_method", "The extraction method of a document, or mixed", "SELECT document_id, CASE WHEN count(DISTINCT extraction_method) = 1 THEN min(extraction_method) ELSE 'mixed' END AS method FROM {page_text} GROUP BY document_id", "SELECT document_id, CASE WHEN count(DISTINCT extraction_method) = 1 THEN min(extraction_method) ELSE 'mixed' END AS method FROM page_text GROUP BY document_id"),
    ("a16_rollup", "Totals by source with a grand total", f"SELECT coalesce(source_name, '?') AS source_name, grouping(source_name) AS total, count(*) AS n FROM {FE_S} GROUP BY ROLLUP(source_name)", f"SELECT coalesce(source_name, '?') AS source_name, grouping(source_name)::INT AS total, count(*) AS n FROM {FE_D} GROUP BY ROLLUP(source_name)"),
    ("a20_recall", "Share of located evidence a field, unknown where there is none", f"SELECT field_name, round(try_divide(count_if(status = 'FOUND'), count(status)), 6) AS recall FROM {FE_S} GROUP BY field_name", f"SELECT field_name, round(count(*) FILTER (status = 'FOUND') / nullif(count(status), 0), 6) AS recall FROM {FE_D} GROUP BY field_name"),
    # ordering
    ("o01_chunk_order", "Position of each chunk in its document", "SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, clause_id, chunk_index, chunk_id) AS pos FROM (SELECT DISTINCT document_id, chunk_id, page_number, clause_id, chunk_index FROM {evidence_chunks})", "SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, clause_id, chunk_index, chunk_id) AS pos FROM (SELECT DISTINCT document_id, chunk_id, page_number, clause_id, chunk_index FROM evidence_chunks)"),
    ("o09_fixed_batches", "Batches of eight fields a document", f"SELECT document_id, field_name, CAST(floor((row_number() OVER (PARTITION BY document_id ORDER BY field_name) - 1) / 8) AS BIGINT) AS batch FROM {BEST_S}", f"SELECT document_id, field_name, CAST(floor((row_number() OVER (PARTITION BY document_id ORDER BY field_name) - 1) / 8) AS BIGINT) AS batch FROM {BEST_D}"),
    ("o11_rolling_failures", "Failures among a user's last ten events, and the streak they end", "WITH f AS (SELECT user_id, event_id, CAST(event_type = 'error' AS INT) AS bad FROM {events}), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f) SELECT user_id, event_id, sum(bad) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_ten, sum(bad) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM g", "WITH f AS (SELECT user_id, event_id, CAST(event_type = 'error' AS INT) AS bad FROM events), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f) SELECT user_id, event_id, CAST(sum(bad) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_ten, CAST(sum(bad) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS streak FROM g"),
    ("o12_latest_event", "Latest event of each user and type", "SELECT user_id, event_type, max_by(event_id, struct(ts, event_id)) AS event_id FROM {events} GROUP BY user_id, event_type", "SELECT user_id, event_type, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events GROUP BY user_id, event_type"),
    # sets
    ("u01_stale_ids", "Chunks of the store whose clause is gone", f"SELECT document_id, clause_id FROM {{evidence_chunks}} EXCEPT SELECT document_id, clause_id FROM {{clauses}}", "SELECT document_id, clause_id FROM evidence_chunks EXCEPT SELECT document_id, clause_id FROM clauses"),
    ("u02_page_union", "Distinct pages of all candidates of a document", "SELECT document_id, array_join(array_sort(collect_set(page_number)), ',') AS pages FROM {evidence_chunks} GROUP BY document_id", "SELECT document_id, array_to_string(list_sort(list_distinct(list(page_number))), ',') AS pages FROM evidence_chunks GROUP BY document_id"),
    # admission control
    ("x01_budget", "The first fifty requests of each run are admitted", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {events}) WHERE rn <= 50", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 50"),
    ("x10_resume", "Pages still to be recognised: those without text", "SELECT DISTINCT p.document_id, p.page_number FROM {page_text} p LEFT ANTI JOIN (SELECT document_id, page_number FROM {page_text} WHERE trim(text) <> '') d ON d.document_id = p.document_id AND d.page_number = p.page_number", "SELECT DISTINCT document_id, page_number FROM page_text p WHERE NOT EXISTS (SELECT 1 FROM page_text d WHERE trim(d.text) <> '' AND d.document_id = p.document_id AND d.page_number = p.page_number)"),
    # comparison
    # sinks as the tables they would leave
    ("k05_csv_escape", "Values safe for a spreadsheet", r"SELECT evidence_id, CASE WHEN valor RLIKE '^\\s*[=+@-]' OR valor RLIKE '^[\\t\\r\\n]' THEN concat(chr(39), valor) ELSE valor END AS cell FROM " + FE_S, r"SELECT evidence_id, CASE WHEN regexp_matches(valor, '^\s*[=+@-]') OR regexp_matches(valor, '^[\t\r\n]') THEN chr(39) || valor ELSE valor END AS cell FROM " + FE_D),
    # vectors
    ("v05_dimensions", "Vectors by dimension, and those that are no unit vectors", "SELECT size(embedding) AS dims, count(*) AS n, count_if(abs(sqrt(aggregate(embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)) - 1) > 0.00001) AS not_unit FROM {embeddings} GROUP BY size(embedding)", "SELECT len(embedding)::INT AS dims, count(*) AS n, count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.00001) AS not_unit FROM embeddings GROUP BY 1"),
]

QUERIES = {name: plan(name, spark, doc) for name, doc, spark, _ in ENTRIES}
ORACLES = {name: duck for name, _, _, duck in ENTRIES}
