"""Text, value, structure, source, sink, telemetry and admission operators as queries of both dialects.

``events`` stand for model requests: a user is a run, an event type a model, ``props.k`` its tokens, ``value`` its
latency; attributes that events lack are derived from their numbers by the fixed rules of ``REQUESTS``.
"""

from __future__ import annotations

from lavra.functions import dims
from lavra.plans.dialect import Dialect, entries
from lavra.plans.sql import plan
from lavra.queries.comparison import DATES, IDENTITY, MISSING, MONEY, best

Q = "'"
FIELDS_12 = ("base_cobertura", "data_retroativa", "limite_maximo_garantia", "moeda", "numero_apolice", "premio", "retencao_franquia", "seguradora", "side_a", "tomador_segurado", "vigencia_fim", "vigencia_inicio")
# Short titles of insurers by a word of their name.
INSURERS = (("porto", "PORTO SEGURO"), ("allianz", "ALLIANZ"), ("axa", "AXA SEGUROS"), ("berkley", "BERKLEY"))
# Labels of fields in front matter, over folded lines.
LABELS = {
    "seguradora": "seguradora", "numero_apolice": "(?:numero +(?:da +)?apolice|apolice *(?:n[.º°o]*|numero))", "tomador_segurado": "(?:tomador|segurado|tomador */ *segurado)",
    "vigencia_inicio": "(?:inicio +(?:da +)?vigencia|vigencia *[-/]? *inicio)", "vigencia_fim": "(?:fim +(?:da +)?vigencia|vigencia *[-/]? *fim)", "data_retroativa": "data +retroativa", "moeda": "moeda",
    "limite_maximo_garantia": "(?:limite +maximo +(?:de +)?garantia|lmg)", "sublimites": "sublimites?", "retencao_franquia": "(?:retencao|franquia|retencao */ *franquia)", "premio": "premio(?: +total)?",
}
# Device names that no file may have.
DEVICES = "CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]"
RATES = "rates(model, p_in, p_cached, p_out) AS (VALUES ('click', CAST(0.25 AS DECIMAL(8, 2)), CAST(0.05 AS DECIMAL(8, 2)), CAST(2 AS DECIMAL(8, 2))), ('view', CAST(1.25 AS DECIMAL(8, 2)), CAST(0.1 AS DECIMAL(8, 2)), CAST(10 AS DECIMAL(8, 2))), ('purchase', CAST(5 AS DECIMAL(8, 2)), CAST(0.5 AS DECIMAL(8, 2)), CAST(30 AS DECIMAL(8, 2))))"
# Kinds of errors that are faults of the transport, of the model's output, and those that end a run.
TRANSPORT = "('timeout', 'connection', 'RPM', 'TPM', 'rate_limit', 'provider_error', 'model_unavailable', 'TPD')"
CONTRACT = "('response_incomplete', 'response_empty', 'invalid_response', 'schema_invalid')"
FATAL = "('authentication', 'permission', 'quota', 'credit', 'TPD')"
SEMANTIC = "('EVIDENCE_INVALID', 'AMBIGUOUS', 'SEMANTIC_INCOMPLETE', 'SEMANTIC_ESCALATION_REQUIRED', 'SEMANTIC_QUALITY_FAILURE')"
# Fixed value: the shape of a numbered heading.
HEADING = r"(?i)^(cl[aá]usula\s+)?[0-9]+(\.[0-9]+)*[.)\s-]+[^0-9]"
GRP = dims.values_sql(dims.group_rows(dims.GROUPS), "grp", "group_id, field_name, field_order")


def requests(d: Dialect) -> str:
    """``req``: requests with tokens, cached part, role, step, level of fallback, status, error code and message."""
    k = d.pick("CAST(get_json_object(props, '$.k') AS BIGINT)", "(props->>'$.k')::BIGINT")
    choose = lambda *xs: "CASE k % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    status = choose("400", "401", "403", "404", "429", "429", "503", "NULL")
    code = choose("'insufficient_quota'", "''", "'credit_balance_exhausted'", "''", "''", "'daily_limit'", "''", "'context_length_exceeded'")
    message = choose("''", "''", "''", "''", "'tokens per minute'", "''", "''", "'the context length'")
    return f"""e AS (SELECT *, {k} AS k FROM {d.t('events')}),
req AS (SELECT event_id, user_id AS run_id, ts, event_type AS model, value AS latency, k, CAST(k % 5 AS INT) AS step, CAST(event_id % 3 AS INT) AS fallback_level, event_type = 'error' AS failed,
  CASE WHEN event_type = 'signup' THEN NULL ELSE k * 10 END AS input_tokens, CASE WHEN event_type = 'signup' OR value > k * 10 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS cached_tokens,
  CASE WHEN event_type = 'signup' THEN NULL ELSE k * 2 END AS output_tokens, CASE event_id % 3 WHEN 0 THEN 'extraction' WHEN 1 THEN 'verifier' ELSE 'auxiliary' END AS role,
  CASE WHEN event_type = 'error' THEN {status} END AS status, CASE WHEN event_type = 'error' THEN {code} END AS code, CASE WHEN event_type = 'error' THEN {message} END AS message FROM e)"""


def kinds(d: Dialect) -> str:
    """``req`` with the kind of each error, by ordered rules, as ``kinded``."""
    return f"""{requests(d)},
kinded AS (SELECT *, CASE WHEN NOT failed THEN NULL WHEN code IN ('insufficient_quota', 'quota_exceeded', 'organization_usage_limit_exceeded') THEN 'quota'
  WHEN code IN ('billing_hard_limit_reached', 'billing_not_active', 'insufficient_credits', 'credit_balance_exhausted', 'organization_spend_limit_exceeded', 'project_spend_limit_exceeded') THEN 'credit'
  WHEN status = 401 THEN 'authentication' WHEN status = 403 THEN 'permission' WHEN status = 404 OR code IN ('model_not_found', 'model_unavailable', 'model_not_available') THEN 'model_unavailable'
  WHEN code IN ('context_length_exceeded', 'context_window_exceeded') OR contains(message, 'context length') THEN 'context_length'
  WHEN status = 429 THEN CASE WHEN contains(message, 'tokens per day') OR contains(message, 'tpd') OR contains(code, 'daily') THEN 'TPD' WHEN contains(message, 'tokens per minute') OR contains(message, 'tpm') THEN 'TPM'
    WHEN contains(message, 'requests per minute') OR contains(message, 'rpm') THEN 'RPM' ELSE 'rate_limit' END
  WHEN status IS NULL THEN 'timeout' WHEN status >= 500 THEN 'provider_error' ELSE 'invalid_request' END AS kind FROM req)"""


CATEGORY = f"CASE WHEN kind IN {TRANSPORT} THEN 'PROVIDER_TRANSPORT_FAILURE' WHEN kind IN {CONTRACT} THEN 'MODEL_OUTPUT_CONTRACT_FAILURE' END"


def lines(d: Dialect) -> str:
    """``lines``: every line of every page; consumers drop repeated rows once the text is gone."""
    if d.spark:
        return "lines AS (SELECT document_id, page_number, CAST(pos + 1 AS BIGINT) AS line_no, line FROM {page_text} LATERAL VIEW posexplode(split(text, '\\\\n')) t AS pos, line WHERE text IS NOT NULL)"
    return "lines AS (SELECT document_id, page_number, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT document_id, page_number, text FROM page_text) WHERE text IS NOT NULL)"


def heading(d: Dialect) -> str:
    """Whether a line is a heading: numbered, or of six letters and more in upper case, and not long."""
    letters = d.sub("line", r"[^\p{L}]", "")
    return f"(length(trim(line)) BETWEEN 1 AND 140 AND ({d.matches('trim(line)', HEADING)} OR (length({letters}) >= 6 AND {letters} = upper({d.sub('line', '[^' + chr(92) + 'p{L}ªº]', '')}))))"


def sections(d: Dialect) -> str:
    """Lines with running section numbers, without their text; a first line without heading opens section 1."""
    own = "OVER (PARTITION BY document_id ORDER BY page_number, line_no"
    return f"""{lines(d)},
marked AS (SELECT DISTINCT document_id, page_number, line_no, {heading(d)} AS heading FROM lines),
placed AS (SELECT *, row_number() {own}) AS n FROM marked),
sections AS (SELECT *, sum(CASE WHEN heading OR n = 1 THEN 1 ELSE 0 END) {own} ROWS UNBOUNDED PRECEDING) AS section FROM placed)"""


def total(x: str) -> str:
    """A sum that is unknown where one part is."""
    return f"CASE WHEN count(*) = count({x}) THEN CAST(coalesce(sum({x}), 0) AS BIGINT) END"


def known(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


def clauses(d: Dialect, *columns: str) -> str:
    return f"(SELECT DISTINCT {', '.join(columns)} FROM {d.t('clauses')})"


def cost(x: str, digits: int) -> str:
    return f"round(CAST({x} AS DOUBLE) / 1000000, {digits})"


PRICE = "(input_tokens - cached_tokens) * p_in + cached_tokens * p_cached + output_tokens * p_out"


def literal(d: Dialect, page: str, quote: str) -> str:
    return f"contains({page}, {quote})"


def evidence_checks(d: Dialect) -> str:
    """Every located evidence with its defect, if any: not on its page, or a value that its quotation does not state."""
    nums, qnums = d.amounts("valor"), d.amounts("trecho_origem")
    fv, fq = d.fold("valor"), d.fold("trecho_origem")
    return f"""ev AS (SELECT DISTINCT evidence_id, document_id, field_name, pagina, {d.norm('valor')} AS v, {d.norm('trecho_origem')} AS q, CASE WHEN field_name IN {MONEY} THEN {nums} END AS nv, CASE WHEN field_name IN {MONEY} THEN {qnums} END AS nq,
  {d.currency(fv)} AS cv, {d.currency(fq)} AS cq, CASE WHEN field_name IN {DATES} THEN {d.date(fv)} END AS dv, CASE WHEN field_name IN {DATES} THEN {d.dates_in(fq)} END AS dq
  FROM {d.t('field_evidence')} WHERE valor IS NOT NULL AND valor <> {MISSING}),
pg AS (SELECT document_id, page_number, {d.norm('text')} AS t FROM {d.t('page_text')} WHERE text IS NOT NULL),
met AS (SELECT e.evidence_id, max(CASE WHEN coalesce(e.q, '') NOT IN ('', {MISSING}) AND contains(p.t, e.q) THEN 1 ELSE 0 END) AS literal FROM (SELECT evidence_id, document_id, pagina, q FROM ev) e LEFT JOIN pg p ON p.document_id = e.document_id AND p.page_number = e.pagina GROUP BY e.evidence_id),
checked AS (SELECT e.evidence_id, e.field_name, CASE WHEN m.literal = 0 THEN 'quotation_not_on_page'
  WHEN field_name IN {MONEY} AND {d.size('nv')} > 0 AND {d.size(d.only('nv', 'n', f"NOT {d.has('nq', 'n')}"))} > 0 THEN 'number_not_quoted'
  WHEN field_name IN {MONEY} AND {d.size('nv')} = 0 AND NOT contains(q, v) THEN 'value_not_quoted'
  WHEN field_name IN {MONEY} AND cv IS NOT NULL AND cv IS DISTINCT FROM cq THEN 'currency_not_quoted'
  WHEN field_name IN {MONEY} AND {d.size('nv')} > 0 AND contains(v, '%') <> contains(q, '%') THEN 'unit_not_quoted'
  WHEN field_name IN {DATES} AND dv IS NOT NULL AND NOT {d.has('dq', 'dv')} THEN 'date_not_quoted'
  WHEN field_name IN {DATES} AND dv IS NULL AND NOT contains(q, v) THEN 'value_not_quoted'
  WHEN field_name = 'moeda' AND (cv IS NULL OR cv IS DISTINCT FROM cq) THEN 'currency_not_quoted'
  WHEN field_name IN {IDENTITY} AND field_name <> 'moeda' AND NOT contains(q, v) THEN 'value_not_quoted' END AS defect FROM ev e JOIN met m ON m.evidence_id = e.evidence_id)"""


def labelled(d: Dialect) -> str:
    """``labelled``: lines of a known label and a value of the field's type, of at most 250 characters."""
    fold = d.fold("line")
    field = "CASE " + " ".join(f"WHEN {d.matches('f', f'^ *(?:{p}) *: *.+$')} THEN '{f}'" for f, p in LABELS.items()) + " END"
    value = d.pick("trim(substring(line, instr(line, ':') + 1))", "trim(substring(line, instr(line, ':') + 1))")
    kind = f"field_name IN {DATES} AND {d.date(d.fold('value'))} IS NULL OR field_name IN {MONEY} AND ({d.size(d.amounts('value'))} = 0 OR {d.currency(d.fold('value'))} IS NULL AND NOT contains(value, '%')) OR field_name = 'moeda' AND {d.currency(d.fold('value'))} IS NULL"
    return f"""{lines(d)},
folded AS (SELECT document_id, page_number, line_no, line, {fold} AS f FROM lines WHERE contains(line, ':')),
named AS (SELECT DISTINCT document_id, page_number, line_no, {field} AS field_name, {value} AS value FROM folded),
labelled AS (SELECT * FROM named WHERE field_name IS NOT NULL AND length(value) BETWEEN 1 AND 250 AND NOT coalesce({kind}, false))"""


def json_pairs(*pairs: tuple[str, str]) -> str:
    """A JSON object of text columns, names in order."""
    return "concat('{{', " + ", ', ', ".join(f"'\"{n}\": \"', coalesce({x}, ''), '\"'" for n, x in pairs) + ", '}}')"


def braces(d: Dialect, text: str) -> str:
    return text if d.spark else text.replace("{{", "{").replace("}}", "}")


DOC_TYPE = "CASE f WHEN 'condicoes gerais' THEN 'Condições gerais' WHEN 'condicoes contratuais' THEN 'Condições gerais' WHEN 'condicoes_gerais' THEN 'Condições gerais' WHEN 'apolice' THEN 'Apólice' WHEN 'apolice emitida' THEN 'Apólice' WHEN 'proposta' THEN 'Proposta' WHEN 'endosso' THEN 'Endosso' ELSE trim(title) END"
COMPANY = "CASE WHEN contains(f, 'capital aberto') AND NOT contains(f, 'capital fechado') THEN 'Capital aberto' WHEN contains(f, 'capital fechado') AND NOT contains(f, 'capital aberto') THEN 'Capital fechado' END"
BRANCH = r"\bd\s*&\s*o\b|directors.{0,8}officers|diretores e administradores|responsabilidade civil.{0,35}administradores"
STEM = "regexp_replace(n, '[.][^.]*$', '')"


def file_names(d: Dialect) -> str:
    """Path parts and reserved signs out, device names prefixed, stem cut to 150 characters."""
    bare = d.sub(d.sub("replace(file_name, chr(92), '/')", "^.*/", ""), r'[<>:"/|?*\x00-\x1f]', "_")
    trimmed = d.sub(bare, "^[ .]+|[ .]+$", "")
    stem, ending = d.sub("n", "[.][^.]*$", ""), d.group("n", "([.][^.]*)$", 1)
    safe = f"CASE WHEN {d.matches(f'upper({d.group(chr(115), chr(94) + chr(40) + chr(91) + chr(94) + chr(46) + chr(93) + chr(42) + chr(41), 1)})', f'^(?:{DEVICES})$')} THEN concat('documento_', s) ELSE s END"
    return f"""n AS (SELECT DISTINCT delivery_id, CASE WHEN {trimmed} = '' THEN 'documento' ELSE {trimmed} END AS n FROM {d.t('processed_documents')}),
s AS (SELECT delivery_id, {stem} AS s, lower({ending}) AS x FROM n)
SELECT delivery_id, concat({d.sub(f"substring({safe}, 1, 150)", "^[ .]+|[ .]+$", "")}, x) AS name FROM s"""


def metadata(d: Dialect) -> str:
    """``meta``: what compatibility compares: branch, company type, currency, document type, product and period of each document."""
    fold = d.fold("title")
    some = lambda x: f"CASE WHEN count(DISTINCT {x}) = 1 THEN min({x}) END"
    return f"""titles AS (SELECT DISTINCT document_id, title, {fold} AS f FROM {d.t('clauses')} WHERE title IS NOT NULL),
kindof AS (SELECT document_id, {some(f"CASE WHEN {d.matches('f', BRANCH)} THEN 'D&O' END")} AS branch, {some(COMPANY)} AS company_type, {some(f"CASE WHEN {DOC_TYPE} <> trim(title) THEN {DOC_TYPE} END")} AS document_type FROM titles GROUP BY document_id),
px AS (SELECT DISTINCT document_id, extraction_id, seguradora, moeda, base_cobertura, vigencia_inicio, vigencia_fim FROM {d.t('policy_extraction')}),
meta AS (SELECT p.document_id, min(CASE WHEN p.seguradora <> {MISSING} THEN p.seguradora END) AS insurer, any_value(k.branch) AS branch, any_value(k.company_type) AS company_type, any_value(k.document_type) AS document_type,
  {some(d.currency(d.fold('p.moeda')))} AS currency, {some(f"CASE WHEN p.base_cobertura <> {MISSING} THEN p.base_cobertura END")} AS product, min({d.date(d.fold('p.vigencia_inicio'))}) AS starts
  FROM px p LEFT JOIN kindof k ON k.document_id = p.document_id GROUP BY p.document_id)"""


HARD, SOFT = ("branch", "company_type", "currency", "document_type"), ("product",)


def compatibility(d: Dialect) -> str:
    pair = lambda c: f"a.{c} IS NOT NULL AND b.{c} IS NOT NULL"
    same = lambda c: f"{d.norm(f'a.{c}')} = {d.norm(f'b.{c}')}"
    n = lambda conditions: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions)
    names = (*HARD, *SOFT)
    days = f"abs({d.days('a.starts', 'b.starts')})"
    near = f"a.starts IS NOT NULL AND b.starts IS NOT NULL AND {days} <= 366"
    far = f"a.starts IS NOT NULL AND b.starts IS NOT NULL AND {days} > 3 * 366"
    between = f"a.starts IS NOT NULL AND b.starts IS NOT NULL AND {days} > 366 AND {days} <= 3 * 366"
    return f"""WITH {metadata(d)}, refs AS (SELECT insurer, min(document_id) AS ref_id FROM meta WHERE insurer IS NOT NULL GROUP BY insurer),
scored AS (SELECT a.document_id AS ref_id, b.document_id AS cand_id, {n([pair(c) for c in names] + ['a.starts IS NOT NULL AND b.starts IS NOT NULL'])} AS paired, {n([pair(c) + ' AND ' + same(c) for c in names] + [near])} AS matches,
  {n([pair(c) + ' AND NOT ' + same(c) for c in HARD] + [far])} AS hard, {n([pair(c) + ' AND NOT ' + same(c) for c in SOFT] + [between])} AS soft, {n(['a.starts IS NOT NULL AND b.starts IS NOT NULL'])} AS timed
  FROM refs r JOIN meta a ON a.document_id = r.ref_id JOIN meta b ON b.insurer = r.insurer AND b.document_id <> r.ref_id)
SELECT ref_id, cand_id, paired, matches, CASE WHEN hard > 0 THEN 'Baixa' WHEN paired >= 5 AND matches >= 5 AND timed = 1 AND soft = 0 THEN 'Alta' WHEN paired >= 3 AND matches >= 2 THEN 'Média' ELSE 'Não determinada' END AS status FROM scored"""


def breaker(d: Dialect) -> str:
    """First request that opens a run's circuit; fatal kinds open it at once."""
    own = "OVER (PARTITION BY run_id ORDER BY event_id"
    return f"""WITH {kinds(d)}, f AS (SELECT run_id, event_id, kind, CASE WHEN kind IN {TRANSPORT} THEN 1 ELSE 0 END AS bad, row_number() {own}) AS n FROM kinded),
g AS (SELECT *, sum(bad) {own} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ten, sum(bad) {own} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three FROM f),
opened AS (SELECT run_id, min(event_id) AS opened_at FROM g WHERE kind IN {FATAL} OR three = 3 OR (n >= 10 AND ten >= 2) GROUP BY run_id)
SELECT g.run_id, g.event_id, CASE WHEN g.event_id > o.opened_at THEN 'refused' WHEN g.event_id = o.opened_at THEN 'opens' ELSE 'admitted' END AS decision FROM g LEFT JOIN opened o ON o.run_id = g.run_id"""


def bits(d: Dialect) -> str:
    return f"CAST(round(100.0 * count(CASE WHEN fallback_level > 0 THEN 1 END) / count(*), 6) AS DOUBLE)"


ENTRIES = entries([
    # text
    ("t03_fold_first", "Titles without accents first, then in lower case, white space collapsed last", lambda d: f"SELECT document_id, clause_id, {d.collapse(d.lower(d.bare('title')))} AS value FROM {clauses(d, 'document_id', 'clause_id', 'title')}"),
    ("t06_phrase", "Clauses whose text holds the phrase 'terceiro reclamante' as whole words", lambda d: f"SELECT DISTINCT document_id, clause_id FROM {d.t('clauses')} WHERE contains(concat(' ', {d.words('text')}, ' '), ' terceiro reclamante ')"),
    ("t08_citation_whitespace", "Quotations with single spaces, letters kept", lambda d: f"SELECT DISTINCT evidence_id, trim({d.sub('trecho_origem', '[ \\n\\t]+', ' ')}) AS value FROM {d.t('field_evidence')}"),
    ("t11_cache_key", "Hash of the canonical JSON of a clause's identity and text", lambda d: f"SELECT DISTINCT document_id, clause_id, {d.sha(braces(d, json_pairs(('category', 'category'), ('clause_id', 'clause_id'), ('document_id', 'document_id'), ('text_sha256', d.sha('text')))))} AS cache_key FROM {d.t('clauses')}"),
    ("t12_contents_line", "Clauses with lines of a table of contents", lambda d: f"SELECT DISTINCT document_id, clause_id FROM {d.t('clauses')} WHERE {d.matches('text', chr(92) + '.{3,}' + chr(92) + 's*[0-9]+')}"),
    ("t16_process_number", "Process numbers of a line in their canonical form", lambda d: f"WITH {lines(d)}, n AS (SELECT DISTINCT document_id, page_number, line_no, {d.group('line', '([0-9]{5}[./-][0-9]{6}[/.-][0-9]{4}[-./][0-9]{2})', 1)} AS raw FROM lines WHERE {d.matches('line', '[0-9]{5}[./-][0-9]{6}[/.-][0-9]{4}[-./][0-9]{2}')}) SELECT document_id, page_number, line_no, {d.sub('raw', '^([0-9]{5}).([0-9]{6}).([0-9]{4}).([0-9]{2})$', '$1.$2/$3-$4')} AS process FROM n"),
    ("t17_short_title", "Short title of a document: that of its insurer, its name without a trailing label, else the file name", lambda d: f"WITH x AS (SELECT sha256, min(file_name) AS file_name FROM {d.t('processed_documents')} GROUP BY sha256), s AS (SELECT document_id, min(CASE WHEN seguradora <> {MISSING} THEN seguradora END) AS insurer FROM {d.t('policy_extraction')} GROUP BY document_id) SELECT x.sha256, CASE {' '.join(f'WHEN {d.matches(d.bare(Q.join(("lower(insurer)",))), chr(92) + "b" + token + chr(92) + "b")} THEN {Q}{title}{Q}' for token, title in INSURERS)} WHEN insurer IS NOT NULL THEN trim({d.sub('insurer', ' +(?:Ap[oó]lice|Produto|Tomador) *: *$', '')}) ELSE file_name END AS title FROM x LEFT JOIN s ON s.document_id = x.sha256"),
    ("t18_title_disambiguation", "File titles made unique where a title repeats", lambda d: f"WITH x AS (SELECT DISTINCT delivery_id, source_name, file_name FROM {d.t('processed_documents')}), n AS (SELECT source_name, count(*) AS n FROM x GROUP BY source_name) SELECT x.delivery_id, CASE WHEN n.n > 1 THEN concat(x.source_name, ' · ', x.file_name) ELSE x.source_name END AS title FROM x LEFT JOIN n ON n.source_name = x.source_name"),
    ("t19_number_display", "Numbers for display: separators of thousands, fixed decimals, a text for unknown ones", lambda d: f"SELECT DISTINCT evidence_id, coalesce({d.pick('format_number(confianca * 12345, 2)', 'format(' + Q + '{:,.2f}' + Q + ', confianca * 12345)')}, 'Não informado') AS shown FROM {d.t('field_evidence')}"),
    ("t22_alias_classifiers", "Kind of document, of company, and branch that a title names", lambda d: f"SELECT document_id, clause_id, {DOC_TYPE} AS document_type, {COMPANY} AS company_type, CASE WHEN {d.matches('f', BRANCH)} THEN 'D&O' END AS branch FROM (SELECT document_id, clause_id, title, {d.fold('title')} AS f FROM {clauses(d, 'document_id', 'clause_id', 'title')})"),
    # values
    ("n02_amounts", "Numbers of each value, in either notation", lambda d: f"SELECT DISTINCT evidence_id, {d.joined(d.each(d.amounts('valor'), 'x', d.text('x')), '|')} AS amounts FROM {d.t('field_evidence')} WHERE valor IS NOT NULL"),
    ("n03_parsed_date", "Dates of values: ISO, day first, or in words", lambda d: f"SELECT DISTINCT evidence_id, {d.text(d.date(d.fold('valor')))} AS day FROM {d.t('field_evidence')} WHERE field_name IN {DATES}"),
    ("n04_dates_in_text", "Dates that a quotation names", lambda d: f"SELECT DISTINCT evidence_id, {d.joined(d.each(d.dates_in(d.fold('trecho_origem')), 'x', d.text('x')), '|')} AS dates FROM {d.t('field_evidence')} WHERE trecho_origem IS NOT NULL"),
    ("n07_token_estimate", "Estimated tokens and reserved bytes of a clause", lambda d: f"SELECT DISTINCT document_id, clause_id, CAST(ceil(length(text) / 3.5) + 1000 AS BIGINT) AS tokens, CAST({d.pick('octet_length', 'strlen')}(text) + 1000 AS BIGINT) AS reserve FROM {d.t('clauses')}"),
    ("n08_cost", "Cost by model with its cached part; unknown where any part is", lambda d: f"WITH {requests(d)}, {RATES} SELECT e.model, CASE WHEN count(*) = count({PRICE}) THEN {cost(f'sum({PRICE})', 8)} END AS cost FROM req e LEFT JOIN rates r ON r.model = e.model GROUP BY e.model"),
    ("n10_context_reduction", "How much smaller a clause is than its document", lambda d: f"WITH c AS {clauses(d, 'document_id', 'clause_id', 'length(text) AS n')} SELECT document_id, clause_id, round(100 * (1 - CAST(n AS DOUBLE) / CAST(whole AS DOUBLE)), 6) AS percent FROM (SELECT *, sum(n) OVER (PARTITION BY document_id) AS whole FROM c) WHERE whole > 0"),
    ("n11_scenarios", "Planned calls of each document in four scenarios: batches of clauses, with repairs and attempts", lambda d: f"WITH n AS (SELECT document_id, count(*) AS n FROM {clauses(d, 'document_id', 'clause_id')} GROUP BY document_id), s(scenario, repairs, attempts) AS (VALUES ('plain', 1, 1), ('repair', 2, 1), ('retry', 1, 2), ('worst', 2, 2)) SELECT n.document_id, s.scenario, CAST(ceil(n.n / 8.0) * s.repairs * s.attempts AS BIGINT) AS calls FROM n CROSS JOIN s"),
    ("n12_corpus_size", "Chunks, heading batches, characters and tokens of each document", lambda d: f"SELECT document_id, count(*) AS n_chunks, CAST(ceil({d.n_if(Q.join(('category = ', 'nao_classificada', '')))} / 20.0) AS BIGINT) AS heading_batches, CAST(sum(n) AS BIGINT) AS n_chars, CAST(sum(ceil(n / 3.5) + 1000) AS BIGINT) AS tokens FROM {clauses(d, 'document_id', 'clause_id', 'category', 'length(text) AS n')} GROUP BY document_id"),
    ("n13_scenario_price", "Price by role and model with a multiplier of the input, and a status where rates are missing", lambda d: f"WITH {requests(d)}, {RATES} SELECT e.role, e.model, CASE WHEN count(r.p_in) < count(*) THEN 'UNVERIFIED' ELSE 'OK' END AS status, {cost('sum(k * p_in * CASE e.role WHEN ' + Q + 'verifier' + Q + ' THEN 2 ELSE 1 END)', 6)} AS price FROM req e LEFT JOIN rates r ON r.model = e.model GROUP BY e.role, e.model"),
    ("n14_token_counts", "Reported counts that are whole numbers from 0; all else is unknown", lambda d: f"SELECT event_id, {d.pick('CASE WHEN get_json_object(props, ' + Q + '$.k' + Q + ') RLIKE ' + Q + '^[0-9]+$' + Q + ' THEN CAST(get_json_object(props, ' + Q + '$.k' + Q + ') AS BIGINT) END', 'CASE WHEN regexp_matches(props->>' + Q + '$.k' + Q + ', ' + Q + '^[0-9]+$' + Q + ') THEN CAST(props->>' + Q + '$.k' + Q + ' AS BIGINT) END')} AS tokens, {d.pick('get_json_object(props, ' + Q + '$.details.cached' + Q + ')', 'props->>' + Q + '$.details.cached' + Q)} AS cached FROM {d.t('events')}"),
    ("n15_known_subtotal", "Known cost of each run, and whether it is incomplete", lambda d: f"WITH {requests(d)}, {RATES} SELECT run_id, {cost(f'coalesce(sum({PRICE}), 0)', 9)} AS known, count(*) > count({PRICE}) AS incomplete FROM req e LEFT JOIN rates r ON r.model = e.model GROUP BY run_id"),
    # structure
    ("d02_headings", "Heading lines", lambda d: f"WITH {lines(d)} SELECT DISTINCT document_id, page_number, line_no FROM lines WHERE {heading(d)}"),
    ("d04_sections", "Section number and extent of each section", lambda d: f"WITH {sections(d)} SELECT document_id, CAST(section AS BIGINT) AS section, min(page_number) AS page_start, max(page_number) AS page_end, count(*) AS n_lines FROM sections GROUP BY document_id, section"),
    ("d12_integrity", "Violations: repeated clause ids, pages outside their clause, texts that their chunks do not make up, chunks that no clause holds", lambda d: f"""WITH c AS {clauses(d, 'document_id', 'clause_id', 'page_start', 'page_end', 'length(text) AS n')}, k AS (SELECT DISTINCT chunk_id, document_id, clause_id, page_number, length(text) AS n FROM {d.t('evidence_chunks')}), kk AS (SELECT document_id, clause_id, sum(n) AS n FROM k GROUP BY document_id, clause_id)
        SELECT (SELECT count(*) FROM (SELECT document_id, clause_id FROM c GROUP BY document_id, clause_id HAVING count(*) > 1)) AS bad_ids, (SELECT count(*) FROM k JOIN c ON c.document_id = k.document_id AND c.clause_id = k.clause_id WHERE k.page_number NOT BETWEEN c.page_start AND c.page_end) AS bad_pages,
        (SELECT count(*) FROM kk JOIN c ON c.document_id = kk.document_id AND c.clause_id = kk.clause_id WHERE kk.n < c.n) AS short_texts, (SELECT count(*) FROM k LEFT JOIN c ON c.document_id = k.document_id AND c.clause_id = k.clause_id WHERE c.clause_id IS NULL) AS orphans"""),
    ("d13_front_matter", "Non-blank lines of the first three pages: the first 100 within the first 5,000 characters of each", lambda d: f"WITH p AS (SELECT document_id, page_number, substring(text, 1, 5000) AS text FROM {d.t('page_text')} WHERE page_number <= 3 AND text IS NOT NULL), l AS (SELECT document_id, page_number, {d.pick('pos + 1', 'line_no')} AS line_no, trim(line) AS line FROM {d.pick('p LATERAL VIEW posexplode(split(text, ' + Q + chr(92) * 2 + 'n' + Q + ')) t AS pos, line', '(SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM p)')}) SELECT DISTINCT document_id, page_number, CAST(line_no AS BIGINT) AS line_no, line FROM l WHERE line_no <= 100 AND line <> ''"),
    # validation
    ("check_p05_literal_quotes", "Defect of each located evidence: not on its page, or a value that its quotation does not state", lambda d: f"WITH {evidence_checks(d)} SELECT evidence_id, field_name, defect FROM checked"),
    ("check_p08_labelled_lines", "Lines of a known label and a value of the field's type", lambda d: f"WITH {labelled(d)} SELECT document_id, page_number, line_no, field_name, value FROM labelled"),
    ("check_p14_gated_lines", "The same of documents whose text names general conditions", lambda d: f"WITH {labelled(d)}, ok AS (SELECT DISTINCT document_id FROM {d.t('page_text')} WHERE contains({d.fold('text')}, 'condicoes gerais')) SELECT l.document_id, l.page_number, l.line_no, l.field_name FROM labelled l JOIN ok ON ok.document_id = l.document_id"),
    ("check_p16_result_validity", "Documents whose evidence lacks a field, repeats one, or has none of its pages", lambda d: f"WITH f AS (SELECT document_id, count(DISTINCT field_name) AS n_fields, count(*) AS n_rows, max(pagina) AS last_page FROM (SELECT DISTINCT evidence_id, document_id, field_name, pagina FROM {d.t('field_evidence')}) GROUP BY document_id), p AS (SELECT document_id, count(DISTINCT page_number) AS n_pages FROM {d.t('page_text')} GROUP BY document_id) SELECT f.document_id, n_fields = {len(FIELDS_12)} AS complete, n_rows = n_fields AS single, coalesce(last_page <= n_pages, n_pages IS NOT NULL AND last_page IS NULL) AS pages_exist FROM f LEFT JOIN p ON p.document_id = f.document_id"),
    ("check_p17_literal_review", "Per field: evidence by defect", lambda d: f"WITH {evidence_checks(d)} SELECT field_name, coalesce(defect, 'valid') AS verdict, count(*) AS n FROM checked GROUP BY field_name, coalesce(defect, 'valid')"),
    # joins and sets
    ("j06_chunk_pages", "Chunks with the page they stand on", lambda d: f"SELECT c.chunk_id, min(p.page_id) AS page_id FROM (SELECT DISTINCT chunk_id, document_id, page_number FROM {d.t('evidence_chunks')}) c JOIN (SELECT DISTINCT page_id, document_id, page_number FROM {d.t('page_text')}) p ON p.document_id = c.document_id AND p.page_number = c.page_number GROUP BY c.chunk_id"),
    ("j11_document_pairs", "Unordered pairs of the two to five documents of one policy number", lambda d: f"WITH x AS (SELECT DISTINCT document_id, numero_apolice FROM {d.t('policy_extraction')} WHERE numero_apolice IS NOT NULL AND numero_apolice <> {MISSING}), g AS (SELECT numero_apolice FROM x GROUP BY numero_apolice HAVING count(DISTINCT document_id) BETWEEN 2 AND 5), y AS (SELECT DISTINCT x.document_id, x.numero_apolice FROM x JOIN g ON g.numero_apolice = x.numero_apolice) SELECT a.document_id AS document_a, b.document_id AS document_b FROM y a JOIN y b ON b.numero_apolice = a.numero_apolice AND a.document_id < b.document_id"),
    ("j14_truth_mismatches", "Evidence beside the extraction's value of the same field, and how many differ", lambda d: f"WITH t AS (SELECT DISTINCT document_id, extraction_id, {d.array(*(f'{Q}{f}{Q}' for f in ('moeda', 'premio', 'seguradora')))} AS names, {d.array('moeda', 'premio', 'seguradora')} AS vals FROM {d.t('policy_extraction')}), u AS (SELECT document_id, {d.pick('n', 'n')} AS field_name, v FROM {d.pick('t LATERAL VIEW posexplode(arrays_zip(names, vals)) x AS pos, z LATERAL VIEW explode(array(z.names)) y AS n LATERAL VIEW explode(array(z.vals)) w AS v', '(SELECT document_id, unnest(names) AS n, unnest(vals) AS v FROM t)')}), b AS (SELECT DISTINCT evidence_id, document_id, field_name, valor FROM {d.t('field_evidence')}) SELECT b.field_name, count(*) AS n, {d.n_if('b.valor IS DISTINCT FROM u.v')} AS mismatches FROM b JOIN u ON u.document_id = b.document_id AND u.field_name = b.field_name GROUP BY b.field_name"),
    ("o10_ordered_distinct", "Fields of a document by first appearance, once each", lambda d: f"WITH f AS (SELECT document_id, field_name, min(evidence_id) AS first_id FROM {d.t('field_evidence')} GROUP BY document_id, field_name) SELECT document_id, {d.pick('array_join(transform(array_sort(collect_list(struct(first_id, field_name))), x -> x.field_name), ' + Q + '+' + Q + ')', 'string_agg(field_name, ' + Q + '+' + Q + ' ORDER BY first_id, field_name)')} AS fields FROM f GROUP BY document_id"),
    ("o02_newest_first", "Deliveries newer than each within its day, and how many came on later days: the place in the order, newest first", lambda d: f"WITH x AS (SELECT DISTINCT delivery_id, source_name, stored_at, CAST(stored_at AS DATE) AS day FROM {d.t('processed_documents')}), n AS (SELECT source_name, day, count(*) AS n FROM x GROUP BY source_name, day), b AS (SELECT source_name, day, coalesce(sum(n) OVER (PARTITION BY source_name ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT x.delivery_id, CAST(b.before + row_number() OVER (PARTITION BY x.source_name, x.day ORDER BY x.stored_at DESC, x.delivery_id) AS BIGINT) AS pos FROM x JOIN b ON b.source_name IS NOT DISTINCT FROM x.source_name AND b.day = x.day"),
    ("u04_field_set_equality", "Whether a document has exactly the expected fields, none twice", lambda d: f"SELECT document_id, {d.sorted_set('field_name', ',')} = '{','.join(FIELDS_12)}' AND count(*) = count(DISTINCT field_name) AS same FROM (SELECT DISTINCT evidence_id, document_id, field_name FROM {d.t('field_evidence')}) GROUP BY document_id"),
    ("u05_content_dedup", "First delivery of each content, its name made unique where it clashes", lambda d: f"WITH f AS (SELECT sha256, min(delivery_id) AS delivery_id, count(DISTINCT delivery_id) AS n, min(file_name) AS file_name FROM {d.t('processed_documents')} GROUP BY sha256) SELECT sha256, delivery_id, n, CASE WHEN row_number() OVER (PARTITION BY file_name ORDER BY delivery_id) = 1 THEN file_name ELSE concat(file_name, ' (', {d.text('row_number() OVER (PARTITION BY file_name ORDER BY delivery_id)')}, ')') END AS name FROM f"),
    ("u08_new_promotions", "Promotions of a run, role and model that no earlier request had", lambda d: f"WITH {requests(d)} SELECT run_id, role, model, min(event_id) AS first_event FROM req WHERE fallback_level = 2 GROUP BY run_id, role, model"),
    # telemetry
    ("a05_event_dedup", "Last request of each identity: by response, request, reservation or attempt, else by itself", lambda d: f"WITH {requests(d)}, i AS (SELECT *, CASE WHEN k % 4 = 0 THEN concat('response_id:', {d.text('k')}, ':', {d.text('run_id')}) WHEN k % 4 = 1 THEN concat('request_id:', {d.text('k')}, ':', {d.text('run_id')}) WHEN k % 4 = 2 THEN concat('attempt:', {d.text('run_id')}, ':', {d.text('step')}, ':', model) ELSE concat({d.text('run_id')}, ':event:', {d.text('event_id')}) END AS identity FROM req) SELECT identity, max(event_id) AS event_id, count(*) AS n FROM i GROUP BY identity"),
    ("a08_request_summary", "Requests, share of fallbacks, and failures by category of each model", lambda d: f"WITH {kinds(d)} SELECT model, count(*) AS requests, {bits(d)} AS fallback_percent, {d.n_if(f'kind IN {TRANSPORT}')} AS transport, {d.n_if(f'kind IN {CONTRACT}')} AS contract, {d.n_if(f'failed AND kind NOT IN {TRANSPORT} AND kind NOT IN {CONTRACT}')} AS others FROM kinded GROUP BY model"),
    ("a18_compatibility", "Compatibility of pairs by branch, company, currency, kind of document, product and dates", compatibility),
    ("a19_usage_properties", "Usage of each run, unknown where a part is, beside the known part", lambda d: f"WITH {requests(d)} SELECT run_id, {', '.join(f'{total(c)} AS {c}, {known(c)} AS known_{c}' for c in ('input_tokens', 'cached_tokens', 'output_tokens'))} FROM req GROUP BY run_id"),
    ("a21_execution_metrics", "Per run: calls by route, failed steps, time in requests and time beside them", lambda d: f"WITH {kinds(d)} SELECT run_id, count(*) AS attempts, {d.n_if('fallback_level = 0')} AS primary_calls, {d.n_if('fallback_level = 1')} AS fallback_calls, {d.n_if('fallback_level = 2')} AS escalations, {d.sorted_set(d.text('step'), ',', 'failed')} AS failed_steps, round(CAST(sum(CAST(latency AS DECIMAL(18, 4))) AS DOUBLE), 4) AS llm_seconds, round(greatest(0, 86400 - CAST(sum(CAST(latency AS DECIMAL(18, 4))) AS DOUBLE)), 4) AS local_seconds FROM kinded GROUP BY run_id"),
    ("a22_field_sets", "Steps of a run solved at first, needing a fallback, and sent on to the strongest model", lambda d: f"WITH {requests(d)} SELECT run_id, {d.sorted_set(d.text('step'), ',', 'fallback_level = 0 AND NOT failed')} AS solved, {d.sorted_set(d.text('step'), ',', 'fallback_level = 1')} AS fallback, {d.sorted_set(d.text('step'), ',', 'fallback_level = 2')} AS strongest FROM req GROUP BY run_id"),
    ("a23_reconciliation", "Ledger, receipts and stored results of each document: reserved, sent, completed, uncertain, unmerged", lambda d: f"WITH l AS (SELECT sha256 AS document_id, count(DISTINCT delivery_id) AS reserved, count(DISTINCT CASE WHEN stored_at IS NOT NULL THEN delivery_id END) AS sent FROM {d.t('processed_documents')} GROUP BY sha256), r AS (SELECT document_id, count(DISTINCT extraction_id) AS completed FROM {d.t('policy_extraction')} GROUP BY document_id), s AS (SELECT document_id, count(DISTINCT evidence_id) AS stored FROM {d.t('field_evidence')} GROUP BY document_id), m AS (SELECT coalesce(l.document_id, r.document_id) AS document_id, coalesce(reserved, 0) AS reserved, coalesce(sent, 0) AS sent, coalesce(completed, 0) AS completed FROM l FULL OUTER JOIN r ON r.document_id = l.document_id) SELECT m.document_id, reserved, sent, completed, greatest(sent - completed, 0) AS uncertain, CASE WHEN completed > 0 AND coalesce(stored, 0) = 0 THEN completed ELSE 0 END AS unmerged FROM m LEFT JOIN s ON s.document_id = m.document_id"),
    # admission
    ("x02_two_attempts", "Admission of each request: two attempts a step, no model and no fingerprint twice", lambda d: f"WITH {requests(d)}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY event_id) AS attempt, row_number() OVER (PARTITION BY run_id, step, model ORDER BY event_id) AS same_model, row_number() OVER (PARTITION BY run_id, step, model, k ORDER BY event_id) AS same_print FROM req) SELECT event_id, CASE WHEN attempt > 2 THEN 'max_model_attempts_per_logical_step' WHEN same_model > 1 THEN 'same_model_retry_disabled' WHEN same_print > 1 THEN 'identical_same_model_request_disabled' ELSE 'admitted' END AS decision FROM n"),
    ("x03_circuit_breaker", "Requests admitted, opening the circuit, or refused behind it: fatal kinds, three transport failures in a row, two of a full last ten", breaker),
    ("x04_failure_category", "Category of each failure by its kind, else by the status of the evidence", lambda d: f"WITH {kinds(d)} SELECT event_id, kind, {CATEGORY} AS category FROM kinded WHERE failed UNION ALL SELECT DISTINCT evidence_id, status, CASE WHEN status IN {SEMANTIC} THEN 'SEMANTIC_QUALITY_FAILURE' END FROM {d.t('field_evidence')}"),
    ("x05_error_kind", "Kind of each error by ordered rules over status, code and message", lambda d: f"WITH {kinds(d)} SELECT event_id, kind FROM kinded WHERE failed"),
    ("x06_retry_after", "Seconds to wait: a number, an HTTP date, or milliseconds", lambda d: f"WITH {requests(d)}, h AS (SELECT event_id, CASE k % 4 WHEN 0 THEN {d.text('k')} WHEN 1 THEN 'Wed, 21 Oct 2026 07:28:00 GMT' WHEN 2 THEN 'soon' END AS header, CASE WHEN k % 4 > 1 THEN {d.text('k * 100')} END AS millis FROM req WHERE failed) SELECT event_id, CASE WHEN {d.matches('header', '^-?[0-9]+([.][0-9]+)?$')} THEN greatest(0, CAST(header AS DOUBLE)) WHEN {d.matches('header', '^[A-Z][a-z]{2}, [0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8} GMT$')} THEN greatest(0, CAST({d.pick('unix_timestamp(to_timestamp(substring(header, 6, 20), ' + Q + 'dd MMM yyyy HH:mm:ss' + Q + ')) - unix_timestamp(TIMESTAMP ' + Q + '2026-10-21 07:00:00' + Q + ')', 'epoch(strptime(substring(header, 6, 20), ' + Q + '%d %b %Y %H:%M:%S' + Q + ')) - epoch(TIMESTAMP ' + Q + '2026-10-21 07:00:00' + Q + ')')} AS DOUBLE)) WHEN {d.matches('millis', '^[0-9]+$')} THEN CAST(millis AS DOUBLE) / 1000 END AS seconds FROM h"),
    ("x07_route", "Model of each attempt by role: the first, then the first fallback that is another, then the escalation", lambda d: f"WITH {requests(d)}, routes(role, first, second, third) AS (VALUES ('extraction', 'click', 'view', 'purchase'), ('verifier', 'purchase', 'view', 'purchase'), ('auxiliary', 'view', 'click', 'click')) SELECT e.event_id, CASE WHEN e.fallback_level = 0 THEN r.first WHEN e.fallback_level = 1 THEN CASE WHEN r.second <> e.model THEN r.second WHEN r.third <> e.model THEN r.third END ELSE r.third END AS route FROM req e JOIN routes r ON r.role = e.role"),
    ("x08_unsafe_runs", "Runs that took attempts and did not complete, or have outcomes nobody knows", lambda d: f"WITH {requests(d)}, last AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) AS rn FROM req) SELECT run_id, count(*) AS attempts, {d.n_if('input_tokens IS NULL')} AS uncertain, max(CASE WHEN rn = 1 THEN model END) AS last_status FROM last GROUP BY run_id HAVING max(CASE WHEN rn = 1 THEN model END) <> 'purchase' OR {d.n_if('input_tokens IS NULL')} > 0"),
    ("x09_operation_limiter", "Logical operations of a run, the first twenty of which are admitted", lambda d: f"WITH {requests(d)}, o AS (SELECT run_id, step, role, min(event_id) AS first_event FROM req GROUP BY run_id, step, role) SELECT run_id, step, role, row_number() OVER (PARTITION BY run_id ORDER BY first_event) <= 20 AS admitted FROM o"),
    ("c09_oversize_guard", "Evidence too long to be compared in one step", lambda d: f"SELECT DISTINCT evidence_id, length(coalesce(trecho_origem, '')) > 1600 OR length(coalesce(valor, '')) > 800 AS oversize FROM {d.t('field_evidence')}"),
    # sources and sinks
    ("s05_ocr_routing", "Pages whose native text is too short and go to recognition", lambda d: f"SELECT DISTINCT page_id, CASE WHEN length(trim(coalesce(text, ''))) < 40 THEN 'tesseract' ELSE 'native' END AS route FROM {d.t('page_text')}"),
    ("s08_safe_names", "Safe file names: no path, reserved signs or device names, at most 150 characters and the suffix", lambda d: f"WITH {file_names(d)}"),
    ("s13_catalog_lookup", "Deliveries with the entry of a curated catalogue of sources, by media type", lambda d: f"WITH catalog(media_type, title, accepted) AS (VALUES ('application/pdf', 'Documento PDF', true), ('image/png', 'Imagem PNG', true), ('image/tiff', 'Imagem TIFF', true), ('text/html', 'Página', false)) SELECT DISTINCT p.delivery_id, c.title, coalesce(c.accepted, false) AS accepted FROM {d.t('processed_documents')} p LEFT JOIN catalog c ON c.media_type = p.media_type"),
    ("s14_dataset_integrity", "Documents whose pages are not numbered without gaps, or whose delivery states another number of pages", lambda d: f"WITH p AS (SELECT document_id, count(DISTINCT page_number) AS n, max(page_number) AS last FROM {d.t('page_text')} GROUP BY document_id), x AS (SELECT sha256, max(page_count) AS stated FROM {d.t('processed_documents')} GROUP BY sha256) SELECT p.document_id, p.n = p.last AS contiguous, x.stated IS NOT NULL AND x.stated = p.last AS as_stated FROM p LEFT JOIN x ON x.sha256 = p.document_id"),
    ("s15_point_scan", "Chunks of every document in reading order, with their place", lambda d: f"SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, clause_id, chunk_index, chunk_id) AS place FROM (SELECT DISTINCT document_id, chunk_id, page_number, clause_id, chunk_index FROM {d.t('evidence_chunks')})"),
    ("s12_cache_lookup", "Deliveries served from an earlier capture of the same content, and captures to make", lambda d: f"WITH x AS (SELECT DISTINCT delivery_id, sha256, cache_key FROM {d.t('processed_documents')}), c AS (SELECT sha256, min(delivery_id) AS first_id FROM x WHERE cache_key IS NOT NULL GROUP BY sha256) SELECT x.delivery_id, CASE WHEN c.first_id IS NULL THEN 'miss' WHEN c.first_id < x.delivery_id THEN 'hit' ELSE 'capture' END AS lookup FROM x LEFT JOIN c ON c.sha256 = x.sha256"),
    ("k06_review_json", "Reviews as one JSON object a document", lambda d: f"SELECT DISTINCT document_id, {braces(d, json_pairs(('document_id', 'document_id'), ('review', Q.join(('CASE WHEN side_a = ', 'sim', ' THEN ', 'Confirmado', ' ELSE ', 'Não revisado', ' END')))))} AS review FROM {d.t('policy_extraction')}"),
    ("k07_report", "Report of a document: a heading, one Markdown row a field with its citation, in order", lambda d: f"WITH {best(d)}, l AS (SELECT document_id, field_name, concat('| ', field_name, ' | ', valor, ' | ', CASE WHEN pagina IS NULL THEN 'sem página' ELSE concat('p. ', {d.text('pagina')}) END, ' |') AS line FROM best) SELECT document_id, concat('# ', document_id, chr(10), {d.pick('array_join(transform(array_sort(collect_list(struct(field_name, line))), x -> x.line), chr(10))', 'string_agg(line, chr(10) ORDER BY field_name, line)')}) AS report FROM l GROUP BY document_id"),
])

QUERIES = {name: plan(name, spark, doc) for name, doc, spark, _ in ENTRIES}
ORACLES = {name: duck for name, _, _, duck in ENTRIES}
