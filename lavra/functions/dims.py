"""Dimension tables: fields, their groups, search phrases and labels.

All values are fixed values of the domain; they are small by construction and safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MISSING = "nao_localizado"

# Search phrases of each field, in plain lower-case letters.
ALIASES = {
    "seguradora": ("seguradora", "companhia de seguros", "seguros", "susep", "processo susep"),
    "numero_apolice": ("numero da apolice", "numero apolice", "apolice numero", "apolice n"),
    "tomador_segurado": ("tomador", "segurado", "sociedade", "contratante"),
    "vigencia_inicio": ("inicio de vigencia", "inicio da vigencia", "vigencia", "periodo de vigencia"),
    "vigencia_fim": ("fim de vigencia", "termino de vigencia", "vigencia", "periodo de vigencia"),
    "moeda": ("moeda", "real brasileiro", "reais", "brl", "usd", "eur", "dolares"),
    "premio": ("premio", "pagamento do premio", "premio total"),
    "limite_maximo_garantia": ("limite maximo de garantia", "limite maximo de responsabilidade", "limite de responsabilidade", "lmg", "lmi", "limite agregado"),
    "sublimites": ("sublimite", "sublimites", "sub limite", "sub limites"),
    "retencao_franquia": ("franquia", "retencao", "participacao obrigatoria", "pos"),
    "side_a": ("side a", "cobertura a", "indenizacao ou reembolso ao segurado", "perdas nao indenizaveis", "nao indenizaveis"),
    "side_b": ("side b", "cobertura b", "reembolso a sociedade", "reembolso a empresa", "indenizacao a sociedade"),
    "side_c": ("side c", "cobertura c", "valores mobiliarios", "mercado de capitais", "mercados de capitais", "reclamacoes contra a sociedade"),
    "custos_defesa": ("custos de defesa", "custo de defesa", "despesas de defesa", "honorarios advocaticios"),
    "controle_defesa": ("controle da defesa", "controle de defesa", "conducao da defesa", "defesa", "advogados"),
    "consentimento_acordo": ("consentimento", "acordo", "anuencia", "autorizacao previa"),
    "rateio": ("rateio", "alocacao", "perdas cobertas e nao cobertas"),
    "base_cobertura": ("base de reclamacoes", "base de reclamacao", "claims made", "notificacao", "fato gerador"),
    "data_retroativa": ("data retroativa", "data limite de retroatividade", "retroatividade", "periodo de retroatividade"),
    "periodo_estendido_notificacao": ("prazo complementar", "prazo suplementar", "periodo complementar", "periodo suplementar", "prazo adicional"),
    "prazo_aviso_sinistro": ("aviso de sinistro", "notificacao de reclamacao", "comunicacao de sinistro", "reclamacao e caracterizacao do sinistro", "aviso", "notificacao"),
    "jurisdicao_lei": ("jurisdicao", "foro", "legislacao aplicavel", "lei aplicavel", "domicilio do segurado"),
    "territorialidade": ("territorialidade", "ambito geografico", "territorio", "qualquer lugar", "mundial"),
    "exclusoes": ("exclusoes", "riscos excluidos", "excluido", "excluidos", "atos dolosos", "poluicao", "nao cobre"),
    "extensoes_cobertura": ("extensoes de cobertura", "extensao de cobertura", "cobertura adicional", "coberturas adicionais", "condicao particular", "condicoes particulares"),
    "cancelamento_renovacao": ("cancelamento", "renovacao", "rescisao", "nao renovacao"),
    "definicoes_relevantes": ("definicoes", "glossario", "conceitos", "definicao"),
}
# Further phrases of the last stage of retrieval.
FALLBACK = {
    "seguradora": ("contrato de seguro", "disposicoes preliminares", "apresentacao"),
    "side_a": ("responsabilidade dos administradores", "nao reembolsaveis", "indenizacao ao segurado"),
    "side_b": ("reembolsar a sociedade", "reembolsar a empresa", "ressarcimento a sociedade"),
    "side_c": ("titulos e valores", "securities", "companhias abertas", "entidade segurada"),
    "custos_defesa": ("assistencia juridica", "custeio de defesa", "custas judiciais", "defesa do segurado"),
    "controle_defesa": ("escolha de advogado", "nomeacao de advogado", "assumir a defesa"),
    "retencao_franquia": ("participacoes obrigatorias", "dedutivel", "participacao do segurado"),
    "sublimites": ("limite adicional", "limites adicionais", "limite por cobertura", "limites por cobertura"),
    "territorialidade": ("cobertura territorial", "fora do brasil", "exterior", "todo o mundo"),
    "jurisdicao_lei": ("tribunais", "arbitragem", "legislacao brasileira", "foro competente"),
    "data_retroativa": ("anterior a vigencia", "antes da vigencia", "data retro", "retroativa"),
    "exclusoes": ("nao se aplica", "nao sera responsavel", "nao estao cobertas", "exclusao"),
    "numero_apolice": ("apolice",),
    "vigencia_inicio": ("inicio", "vigente", "comercializados"),
    "vigencia_fim": ("termino", "vencimento", "encerramento"),
}
# Words that are no query terms, fields with a larger quota, and the groups of fields.
STOP_WORDS = ("a", "o", "os", "as", "um", "uma", "de", "do", "da", "dos", "das", "e", "ou", "para", "por", "no", "na", "nos", "nas", "ao", "aos", "com", "em", "que", "se", "esta", "este", "seu", "sua", "suas", "seus")
CRITICAL = ("limite_maximo_garantia", "sublimites", "retencao_franquia", "side_a", "side_b", "side_c", "custos_defesa", "data_retroativa", "territorialidade", "jurisdicao_lei", "exclusoes")
GROUPS = {
    "IDENTIFICATION": ("seguradora", "numero_apolice", "tomador_segurado", "vigencia_inicio", "vigencia_fim", "moeda", "premio"),
    "LIMITS": ("limite_maximo_garantia", "sublimites", "retencao_franquia"),
    "CORE_COVERAGES": ("side_a", "side_b", "side_c", "custos_defesa", "controle_defesa", "consentimento_acordo", "rateio"),
    "TEMPORAL": ("base_cobertura", "data_retroativa", "periodo_estendido_notificacao", "prazo_aviso_sinistro"),
    "SCOPE": ("jurisdicao_lei", "territorialidade"),
    "EXCLUSIONS": ("exclusoes",),
    "EXTENSIONS_DEFINITIONS": ("extensoes_cobertura", "cancelamento_renovacao", "definicoes_relevantes"),
}
FINER_GROUPS = {
    "LIMITS_SUBLIMITS": ("limite_maximo_garantia", "sublimites"),
    "RETENTIONS_DEDUCTIBLES": ("retencao_franquia",),
    "SIDE_COVERAGES": ("side_a", "side_b", "side_c"),
    "DEFENSE_COSTS": ("custos_defesa", "controle_defesa"),
    "TERRITORY": ("territorialidade",),
    "JURISDICTION": ("jurisdicao_lei",),
    "EXCLUSIONS": ("exclusoes",),
    "TEMPORAL": ("base_cobertura", "data_retroativa", "periodo_estendido_notificacao", "prazo_aviso_sinistro"),
    "IDENTIFICATION": ("seguradora", "numero_apolice", "tomador_segurado", "vigencia_inicio", "vigencia_fim", "moeda", "premio"),
    "CONSENT": ("consentimento_acordo",),
    "ALLOCATION": ("rateio",),
    "EXTENSIONS": ("extensoes_cobertura",),
    "CANCELLATION_RENEWAL": ("cancelamento_renovacao",),
    "DEFINITIONS": ("definicoes_relevantes",),
}


def phrases(field: str, fallback: bool = False) -> tuple[str, ...]:
    return ALIASES[field] + (FALLBACK.get(field, ()) if fallback else ())


def alias_rows(fallback: bool = False) -> list[tuple[str, str, int]]:
    return [(field, alias, k) for field in ALIASES for k, alias in enumerate(phrases(field, fallback))]


def term_rows(fallback: bool = False) -> list[tuple[str, str, int]]:
    """(field, term, number of terms of the field): words of the phrases without stop words."""
    sets = {f: sorted({w for a in phrases(f, fallback) for w in a.split() if w not in STOP_WORDS}) for f in ALIASES}
    return [(f, w, len(ws)) for f, ws in sets.items() for w in ws]


def group_rows(groups: dict[str, tuple[str, ...]]) -> list[tuple[str, str, int]]:
    return [(g, f, k) for g, fields in groups.items() for k, f in enumerate(fields)]


def aliases(spark: SparkSession, fallback: bool = False) -> DataFrame:
    return spark.createDataFrame(alias_rows(fallback), "field_name string, alias string, alias_order int")


def terms(spark: SparkSession, fallback: bool = False) -> DataFrame:
    return spark.createDataFrame(term_rows(fallback), "field_name string, term string, n_terms int")


def groups(spark: SparkSession, which: dict[str, tuple[str, ...]] = GROUPS) -> DataFrame:
    return spark.createDataFrame(group_rows(which), "group_id string, field_name string, field_order int")


def values_sql(rows: list[tuple], name: str, columns: str) -> str:
    """A dimension as a SQL common table."""
    quote = lambda x: str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)})"
