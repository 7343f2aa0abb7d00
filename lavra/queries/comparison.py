"""Comparison of a reference document with its candidates, field by field.

The evidence of a field is its row of highest confidence.  Quotations enter as the few values that the rules need - a
key of their normal form, their currency and their numbers - taken before duplicates go, so that no text is shuffled.
"""

from __future__ import annotations

from uuid import uuid4

from lavra.functions import dims
from lavra.plans.dialect import SPARK, Dialect, entries
from lavra.plans.sql import plan
from lavra.session import cut

#: Stands for the written table of decided pairs in Spark texts.
STEPPED = "<stepped>"

MISSING = "'nao_localizado'"
MONEY = "('limite_maximo_garantia', 'retencao_franquia', 'premio', 'sublimites')"
RANKED = "('limite_maximo_garantia', 'retencao_franquia', 'premio')"
DATES = "('vigencia_inicio', 'vigencia_fim', 'data_retroativa')"
IDENTITY = "('seguradora', 'numero_apolice', 'tomador_segurado', 'moeda')"
#: Fields in which no side can have an advantage.
NO_ADVANTAGE = "('seguradora', 'numero_apolice', 'tomador_segurado', 'moeda', 'vigencia_inicio', 'vigencia_fim')"
UNSURE = "('AMBIGUOUS', 'NOT_RETRIEVED', 'TECHNICAL_UNAVAILABLE')"
#: Longest quotation and value that a pair may have to be compared in one step.
LONG_QUOTE, LONG_VALUE = 1600, 800
# Order in which differences matter.
PRIORITY = (
    "limite_maximo_garantia", "premio", "retencao_franquia", "custos_defesa", "data_retroativa", "territorialidade",
    "periodo_estendido_notificacao", "exclusoes", "side_a", "side_b", "side_c", "extensoes_cobertura",
)
# Why a field matters.
RELEVANCE = {
    "limite_maximo_garantia": "Indica o teto financeiro, sujeito aos sublimites e à base de aplicação.",
    "premio": "Muda o custo da proposta; o preço sozinho não determina sua adequação.",
    "retencao_franquia": "Muda a parcela suportada pelo segurado quando a retenção é aplicável.",
    "custos_defesa": "Pode alterar o pagamento da defesa e o consumo do limite disponível.",
    "data_retroativa": "Delimita a data dos atos que podem ser considerados, junto às demais condições.",
    "territorialidade": "Delimita onde atos ou reclamações podem estar abrangidos, sujeito à jurisdição.",
    "periodo_estendido_notificacao": "Pode mudar o tempo para notificar reclamações após o término, conforme os requisitos.",
    "exclusoes": "Delimita situações excluídas e suas exceções; confira o alcance completo.",
    "side_a": "Trata da proteção da pessoa segurada quando a sociedade não a indeniza.",
    "side_b": "Trata do reembolso à sociedade quando ela indeniza a pessoa segurada.",
    "side_c": "A cobertura da própria sociedade depende do escopo expressamente previsto.",
}
RELEVANCE_ELSE = "Esta condição pode mudar a aplicação da cobertura; confira definições, limites e exceções."
GRP = dims.values_sql(dims.group_rows(dims.GROUPS), "grp", "group_id, field_name, field_order")


def evidence(d: Dialect) -> str:
    """``ev``: evidence once each, with what the rules need of its quotation."""
    key = d.pick(f"xxhash64({d.norm('trecho_origem')})", f"hash({d.norm('trecho_origem')})")
    numbers = lambda x: f"CASE WHEN field_name IN {MONEY} THEN {d.amounts(x)} END"
    return f"""ev AS (SELECT DISTINCT evidence_id, document_id, field_name, pagina, confianca, coalesce(valor, {MISSING}) AS valor, coalesce(status, 'FOUND') AS status,
  length(coalesce(trecho_origem, '')) AS quote_length, coalesce(trecho_origem, '') IN ('', {MISSING}) AS no_quote,
  {key} AS quote_key, {d.norm('valor')} AS value_norm, {d.currency(d.fold('valor'))} AS value_currency, {d.currency(d.fold('trecho_origem'))} AS quote_currency,
  CASE WHEN field_name IN {DATES} THEN {d.date(d.fold('valor'))} END AS value_day, {numbers('valor')} AS value_numbers, {numbers('trecho_origem')} AS quote_numbers, contains(valor, '%') AS percent
  FROM {d.t('field_evidence')})"""


def best(d: Dialect) -> str:
    """``best``: the evidence of highest confidence of each field, whether its values conflict, and the policy's currency."""
    some = f"CASE WHEN valor <> {MISSING} THEN value_norm END"
    return f"""{evidence(d)},
ranked_ev AS (SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY confianca DESC NULLS LAST, evidence_id) AS rn,
  coalesce(min({some}) OVER (PARTITION BY document_id, field_name) <> max({some}) OVER (PARTITION BY document_id, field_name), false) AS conflict FROM ev),
best AS (SELECT *, max(CASE WHEN field_name = 'moeda' THEN value_currency END) OVER (PARTITION BY document_id) AS policy_currency FROM ranked_ev WHERE rn = 1)"""


def pairs(d: Dialect) -> str:
    """``pairs``: one reference per insurer, the first document, with all others as its candidates."""
    return f"""named AS (SELECT DISTINCT document_id, seguradora FROM {d.t('policy_extraction')} WHERE seguradora IS NOT NULL AND seguradora <> {MISSING}),
refs AS (SELECT seguradora, min(document_id) AS ref_id FROM named GROUP BY seguradora),
pairs AS (SELECT DISTINCT r.ref_id, e.document_id AS cand_id FROM named e JOIN refs r ON r.seguradora = e.seguradora WHERE e.document_id <> r.ref_id)"""


def both_sides(d: Dialect) -> str:
    """``sides``: every field that either side of a pair has (a full outer join), with both sides' evidence."""
    columns = "pagina confianca quote_length no_quote quote_key value_norm value_currency quote_currency value_day value_numbers quote_numbers percent policy_currency".split()
    each = ", ".join(f"a.{c} AS {c}_a, b.{c} AS {c}_b" for c in columns)
    return f"""{best(d)},
{pairs(d)},
fields AS (SELECT p.ref_id, p.cand_id, x.field_name FROM pairs p JOIN best x ON x.document_id = p.ref_id UNION SELECT p.ref_id, p.cand_id, x.field_name FROM pairs p JOIN best x ON x.document_id = p.cand_id),
sides AS (SELECT f.ref_id, f.cand_id, f.field_name, coalesce(a.valor, {MISSING}) AS value_a, coalesce(b.valor, {MISSING}) AS value_b,
  coalesce(a.status, 'NOT_FOUND') AS status_a, coalesce(b.status, 'NOT_FOUND') AS status_b, coalesce(a.conflict, false) OR coalesce(b.conflict, false) AS conflict, {each}
  FROM fields f LEFT JOIN best a ON a.document_id = f.ref_id AND a.field_name = f.field_name LEFT JOIN best b ON b.document_id = f.cand_id AND b.field_name = f.field_name)"""


def money(d: Dialect) -> list[tuple[str, str, str]]:
    """(condition, class, reason) of the decision on two amounts; the first that holds counts."""
    cur = lambda s: f"coalesce(value_currency_{s}, policy_currency_{s})"
    one = lambda s: d.at(f"value_numbers_{s}", 1)
    either = lambda make: "(" + " OR ".join(make(s) for s in "ab") + ")"
    differ = "diferente_nao_comparavel"
    size = lambda s: d.size(f"value_numbers_{s}")
    larger = f"({one('a')} > {one('b')}) = (field_name = 'limite_maximo_garantia')"
    return [
        (either(lambda s: f"coalesce(value_currency_{s} <> policy_currency_{s}, false)"), differ, "moeda_inconsistente_com_a_apolice"),
        (either(lambda s: f"coalesce(quote_currency_{s} <> {cur(s)}, false)"), differ, "moeda_fora_da_evidencia"),
        ("percent_a <> percent_b", differ, "unidades_diferem"),
        (f"NOT percent_a AND {either(lambda s: f'{cur(s)} IS NULL')}", differ, "moeda_nao_identificada"),
        (f"NOT percent_a AND {cur('a')} <> {cur('b')}", differ, "moedas_diferem"),
        (either(lambda s: f"{size(s)} <> 1"), differ, "numero_multiplo_ou_ambiguo"),
        (either(lambda s: f"{one(s)} < 0"), differ, "numero_negativo"),
        (either(lambda s: f"NOT coalesce({d.has(f'quote_numbers_{s}', one(s))}, false)"), differ, "numero_fora_da_evidencia"),
        (f"{one('a')} = {one('b')}", "igual", "mesmo_valor"),
        ("percent_a", differ, "percentuais_distintos"),
        (f"field_name NOT IN {RANKED}", differ, "sem_regra_de_vantagem"),
        (larger, "mais_favoravel_A", "vantagem_nominal"),
        ("true", "mais_favoravel_B", "vantagem_nominal"),
    ]


def cascade(d: Dialect) -> list[tuple[str, str, str]]:
    """(condition, class, reason) of any field; the first that holds counts."""
    same = "coalesce(value_norm_a = value_norm_b, false)"
    differ, is_date = "diferente_nao_comparavel", f"field_name IN {DATES}"
    return [
        (f"value_a = {MISSING} AND value_b = {MISSING} AND status_a NOT IN {UNSURE} AND status_b NOT IN {UNSURE}", "nao_localizado_em_ambos", "ausente_em_ambos"),
        ("status_a = 'TECHNICAL_UNAVAILABLE' OR status_b = 'TECHNICAL_UNAVAILABLE'", differ, "tecnicamente_indisponivel"),
        (f"status_a IN {UNSURE} OR status_b IN {UNSURE}", differ, "evidencia_incerta"),
        (f"value_a = {MISSING} OR value_b = {MISSING}", "ausente_em_um", "ausente_em_um"),
        ("conflict", differ, "valores_conflitantes"),
        *[(f"field_name IN {MONEY} AND ({condition})", kind, reason) for condition, kind, reason in money(d)],
        (f"{is_date} AND value_day_a = value_day_b", "igual", "mesma_data"),
        (is_date, differ, "datas_distintas"),
        (f"{same} AND quote_key_a = quote_key_b", "igual", "mesmo_texto"),
        (f"field_name IN {IDENTITY} AND {same}", "igual", "mesma_identificacao"),
        (f"field_name IN {IDENTITY}", differ, "identificacoes_distintas"),
        (f"greatest(quote_length_a, quote_length_b) > {LONG_QUOTE} OR greatest(length(value_a), length(value_b)) > {LONG_VALUE}", differ, "texto_extenso"),
        ("true", differ, "aguarda_comparacao_dos_excertos"),
    ]


def stepped(d: Dialect) -> str:
    """``stepped``: every field of every pair with the number of the rule that decides it."""
    step = "CASE " + " ".join(f"WHEN {condition} THEN {k}" for k, (condition, _, _) in enumerate(cascade(d))) + " END"
    return f"{both_sides(d)}, stepped AS (SELECT *, {step} AS rule FROM sides)"


def compared(d: Dialect) -> str:
    """``compared``: class and reason of every field of every pair; ``cells``: the state of each.

    In Spark the rules are decided once and kept: as one expression they would repeat in every filter and column above.
    """
    rules = cascade(d)
    take = lambda i: "CASE rule " + " ".join(f"WHEN {k} THEN '{rule[i]}'" for k, rule in enumerate(rules)) + " END"
    weak = lambda s: f"value_{s} = {MISSING} OR status_{s} IN ('NOT_RETRIEVED', 'AMBIGUOUS', 'TECHNICAL_UNAVAILABLE', 'NOT_FOUND') OR pagina_{s} IS NULL OR coalesce(no_quote_{s}, true)"
    kept = "ref_id cand_id field_name value_a value_b status_a status_b pagina_a pagina_b no_quote_a no_quote_b rule".replace(" ", ", ")
    return f"""{d.pick(f'stepped AS (SELECT {kept} FROM {STEPPED})', stepped(d))},
compared AS (SELECT *, {take(1)} AS class, {take(2)} AS reason FROM stepped),
cells AS (SELECT *, CASE WHEN {weak('a')} OR {weak('b')} THEN 'insufficient' WHEN reason = 'texto_extenso' THEN 'insufficient' WHEN class = 'igual' THEN 'equivalent'
  WHEN class IN ('mais_favoravel_A', 'mais_favoravel_B', 'diferente_nao_comparavel') AND value_a <> value_b THEN 'different' ELSE 'insufficient' END AS state FROM compared)"""


def run(name: str, text: str, doc: str):
    """A query over the decided pairs, which are written once before it."""

    def query(spark, sf_dir):
        view = f"stepped_{uuid4().hex}"
        cut(plan(name, f"WITH {stepped(SPARK)} SELECT * FROM stepped", doc)(spark, sf_dir)).createOrReplaceTempView(view)
        return plan(name, text.replace(STEPPED, view), doc)(spark, sf_dir)

    query.__name__, query.__doc__ = name, doc
    return query


def over(select: str):
    return lambda d: f"WITH {compared(d)} {select}"


def value_text(s: str) -> str:
    return (
        f"CASE WHEN status_{s} = 'TECHNICAL_UNAVAILABLE' THEN 'Não foi possível analisar' WHEN status_{s} = 'NOT_RETRIEVED' THEN 'Não localizado com segurança'"
        f" WHEN status_{s} = 'AMBIGUOUS' THEN CASE WHEN value_{s} = {MISSING} THEN 'Requer confirmação' ELSE concat(value_{s}, ' · requer confirmação') END"
        f" WHEN value_{s} = {MISSING} OR status_{s} = 'NOT_FOUND' THEN 'Não localizado com segurança' ELSE value_{s} END"
    )


CLASS_TEXT = (
    "CASE WHEN state = 'insufficient' THEN 'Informação insuficiente' WHEN state = 'equivalent' THEN 'Equivalente neste item' WHEN class = 'mais_favoravel_A' THEN 'Mais favorável à referência neste aspecto'"
    " WHEN class = 'mais_favoravel_B' THEN 'Mais favorável ao candidato neste aspecto' ELSE 'Diferente sem direção segura' END"
)
FIELDS = (
    "seguradora", "numero_apolice", "tomador_segurado", "vigencia_inicio", "vigencia_fim", "moeda", "limite_maximo_garantia", "retencao_franquia", "premio", "side_a", "base_cobertura", "data_retroativa",
)
REVERSED = "CASE class WHEN 'mais_favoravel_A' THEN 'mais_favoravel_B' WHEN 'mais_favoravel_B' THEN 'mais_favoravel_A' ELSE class END"
#: Reviews are kept by reference, candidate and field; documents with a confirmed side A stand for reviewed ones.
REVIEWS = "reviews AS (SELECT DISTINCT document_id AS cand_id, 'Confirmado' AS review FROM {0} WHERE side_a = 'sim')"


def counts(d: Dialect, *pairs_: tuple[str, str]) -> str:
    return ", ".join(f"{d.n_if(condition)} AS {name}" for name, condition in pairs_)


ENTRIES = entries([
    ("n05_money_decision", "Decision on two amounts with its reason: currencies, units, numbers, evidence, direction", over(f"SELECT ref_id, cand_id, field_name, class, reason FROM compared WHERE field_name IN {RANKED}")),
    ("j01_field_pairs", "All fields of a reference beside those of its candidates, also those only one has", lambda d: f"WITH {both_sides(d)} SELECT ref_id, cand_id, field_name, value_a, value_b, status_a, status_b FROM sides"),
    ("c01_classification", "Class and reason of each field of a pair, in order of precedence", over("SELECT ref_id, cand_id, field_name, class, reason FROM compared WHERE class <> 'nao_localizado_em_ambos'")),
    ("a10_class_counts", "Differences of a pair by class", over("SELECT ref_id, cand_id, class, count(*) AS n FROM compared WHERE class <> 'igual' GROUP BY ref_id, cand_id, class")),
    ("c02_summary", "Differences of a pair counted and told in a sentence, and the fields to look at", lambda d: f"""WITH {compared(d)}, n AS (SELECT ref_id, cand_id, {counts(d, ('differences', "class NOT IN ('igual', 'nao_localizado_em_ambos')"), ('for_a', "class = 'mais_favoravel_A'"), ('for_b', "class = 'mais_favoravel_B'"), ('missing', "class = 'ausente_em_um'"), ('unordered', "class = 'diferente_nao_comparavel'"), ('both_missing', "value_a = 'nao_localizado' AND value_b = 'nao_localizado'"))},
        {d.sorted_set('field_name', where="class IN ('ausente_em_um', 'diferente_nao_comparavel')")} AS risks FROM compared GROUP BY ref_id, cand_id)
        SELECT ref_id, cand_id, concat('Foram identificadas ', {d.text('differences')}, ' diferenças nos campos estruturados: ', {d.text('for_a')}, ' com vantagem pontual para A, ', {d.text('for_b')}, ' para B, ', {d.text('missing')}, ' com informação ausente em uma fonte e ', {d.text('unordered')}, ' sem ordenação segura. ', {d.text('both_missing')}, ' campos não foram localizados em ambas as fontes.') AS summary, risks FROM n"""),
    ("c03_orchestration", "Candidates of each reference in order, with whether all documents are distinct", lambda d: f"WITH {pairs(d)} SELECT ref_id, cand_id, row_number() OVER (PARTITION BY ref_id ORDER BY cand_id) AS place, ref_id <> cand_id AND count(*) OVER (PARTITION BY ref_id, cand_id) = 1 AS distinct_documents FROM pairs"),
    ("c04_matrix", "Matrix of fields and candidates with group, class and review", lambda d: f"WITH {compared(d)}, {GRP}, {REVIEWS.format(d.t('policy_extraction'))} SELECT c.ref_id, c.cand_id, c.field_name, coalesce(g.group_id, 'OTHER') AS group_id, CASE WHEN c.status_a IN {UNSURE} OR c.status_b IN {UNSURE} THEN 'diferente_nao_comparavel' ELSE c.class END AS class, concat(c.ref_id, ':', c.cand_id, ':', c.field_name) AS review_key, coalesce(r.review, 'Não revisado') AS review FROM compared c LEFT JOIN grp g ON g.field_name = c.field_name LEFT JOIN reviews r ON r.cand_id = c.cand_id"),
    ("c05_pair_state", "State of each cell: insufficient, equivalent or different", over("SELECT ref_id, cand_id, field_name, state FROM cells")),
    ("c06_wording", "Values and classes in words", over(f"SELECT ref_id, cand_id, field_name, {value_text('a')} AS text_a, {value_text('b')} AS text_b, {CLASS_TEXT} AS conclusion FROM cells")),
    ("c07_wide_rows", "One row a pair with the value and class of every field", over("SELECT ref_id, cand_id, " + ", ".join(f"max(CASE WHEN field_name = '{f}' THEN concat(value_b, ' | ', class) END) AS {f}" for f in FIELDS) + " FROM compared GROUP BY ref_id, cand_id")),
    ("c08_reversal", "Pairs with reference and candidate swapped, values and directions with them", over(f"SELECT cand_id AS ref_id, ref_id AS cand_id, field_name, value_b AS value_a, value_a AS value_b, {REVERSED} AS class FROM compared")),
    ("c10_relevance", "Why each differing field matters, with a default", lambda d: f"WITH {compared(d)}, {dims.values_sql(list(RELEVANCE.items()), 'relevance', 'field_name, why')} SELECT c.ref_id, c.cand_id, c.field_name, coalesce(r.why, '{RELEVANCE_ELSE}') AS why FROM cells c LEFT JOIN relevance r ON r.field_name = c.field_name WHERE c.state = 'different'"),
    ("a11_executive_metrics", "Per pair: differences, those that favour either side, unordered ones, and reviews", lambda d: f"""WITH {compared(d)}, {REVIEWS.format(d.t('policy_extraction'))}, x AS (SELECT c.*, r.review FROM compared c LEFT JOIN reviews r ON r.cand_id = c.cand_id WHERE class NOT IN ('igual', 'nao_localizado_em_ambos'))
        SELECT ref_id, cand_id, count(*) AS differences, {counts(d, ('favorable_candidate', f"class = 'mais_favoravel_B' AND field_name NOT IN {NO_ADVANTAGE}"), ('restrictive_candidate', f"class = 'mais_favoravel_A' AND field_name NOT IN {NO_ADVANTAGE}"), ('non_comparable', "class IN ('diferente_nao_comparavel', 'ausente_em_um')"), ('review_needed', 'review IS NULL'), ('reviewed', 'review IS NOT NULL'))} FROM x GROUP BY ref_id, cand_id"""),
    ("a12_business_counts", "Cells of a reference by state, without identity fields", lambda d: f"WITH {compared(d)} SELECT ref_id, {counts(d, ('differences', chr(39).join(('state = ', 'different', ''))), ('equivalent', chr(39).join(('state = ', 'equivalent', ''))), ('insufficient', chr(39).join(('state = ', 'insufficient', ''))))} FROM cells WHERE field_name NOT IN {NO_ADVANTAGE} GROUP BY ref_id"),
    ("o05_top_differences", "The first five important differences of a pair, in order of priority", lambda d: f"WITH {compared(d)}, {dims.values_sql([(f, k) for k, f in enumerate(PRIORITY)], 'priority', 'field_name, place')}, o AS (SELECT c.ref_id, c.cand_id, c.field_name, row_number() OVER (PARTITION BY c.ref_id, c.cand_id ORDER BY coalesce(p.place, 999), c.field_name) AS pos FROM cells c LEFT JOIN priority p ON p.field_name = c.field_name WHERE c.state = 'different' AND c.field_name NOT IN {NO_ADVANTAGE}) SELECT * FROM o WHERE pos <= 5"),
    ("check_p11_matrix_filter", "Fields that differ, or are inconclusive, for any candidate of a reference", lambda d: f"WITH {compared(d)} SELECT ref_id, field_name, max(CASE WHEN class NOT IN ('igual', 'nao_localizado_em_ambos') THEN 1 ELSE 0 END) AS differences, max(CASE WHEN state = 'insufficient' THEN 1 ELSE 0 END) AS inconclusive FROM cells GROUP BY ref_id, field_name"),
    ("j12_pair_membership", "Attempts whose document, or ordered pair of documents in either order, is among the selected ones", lambda d: f"WITH {pairs(d)}, known AS (SELECT ref_id AS subject FROM pairs UNION SELECT cand_id FROM pairs UNION SELECT {d.sha(chr(39).join(('concat(ref_id, ', ':', ', cand_id)')))} FROM pairs UNION SELECT {d.sha(chr(39).join(('concat(cand_id, ', ':', ', ref_id)')))} FROM pairs), ledger AS (SELECT delivery_id, sha256 AS subject FROM {d.t('processed_documents')} UNION SELECT delivery_id, {d.sha(chr(39).join(('concat(sha256, ', ':', ', cache_key)')))} FROM {d.t('processed_documents')}) SELECT DISTINCT l.delivery_id FROM ledger l LEFT SEMI JOIN known k ON k.subject = l.subject".replace("LEFT SEMI", d.pick("LEFT SEMI", "SEMI"))),
    ("check_p13_document_gate", "References with the number of their documents, and whether two to five can be compared at once", lambda d: f"WITH {pairs(d)} SELECT ref_id, count(*) + 1 AS n_documents, count(*) + 1 BETWEEN 2 AND 5 AS admitted FROM pairs GROUP BY ref_id"),
    ("t20_without_telemetry", "Hash of a document's fields without confidences, statuses and times", lambda d: f"WITH {best(d)} SELECT document_id, {d.sha(d.pick(chr(39).join(('array_join(transform(array_sort(collect_list(struct(field_name, valor))), x -> concat(x.field_name, ', '=', ', x.valor)), ', '|', ')')), chr(39).join(('string_agg(field_name || ', '=', ' || valor, ', '|', ' ORDER BY field_name, valor)'))))} AS digest FROM best GROUP BY document_id"),
])

QUERIES = {name: (run if STEPPED in spark else plan)(name, spark, doc) for name, doc, spark, _ in ENTRIES}
ORACLES = {name: duck for name, _, _, duck in ENTRIES}
