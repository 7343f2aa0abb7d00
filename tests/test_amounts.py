"""Problem 3: parsing on small cases with known results, and defined results of hard inputs."""

from decimal import Decimal

import pytest

from lavra.functions.matching import fuzzy_map, weighted_distance
from lavra.operators import amounts as A

RATES = [("BRL", Decimal("1.00")), ("USD", Decimal("5.25")), ("EUR", Decimal("5.80"))]
SCHEMA = "extraction_id long, document_id string, moeda string, limite_maximo_garantia string, retencao_franquia string, premio string, brl_cents string, unit string"


def run(spark, rows, langs=(("d", None),)):
    ex = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    rates = spark.createDataFrame(RATES, "currency string, brl_per_unit decimal(10,2)")
    languages = spark.createDataFrame(list(langs), "document_id string, lang string")
    return {(r[0], r[1]): r[2] for r in A.convert_amounts(ex, languages, rates).collect()}


def test_forms(spark):
    cases = [
        ("R$ 1.500.000,50", "BRL", None, 150000050),
        ("US$ 25,000.00", "USD", "en", 13125000),
        ("BRL 2MM", None, None, 200000000),
        ("€ 62,5k", None, "pt", 36250000),
        ("cinco milhões de reais", "usd", None, 500000000),
        ("setenta e cinco mil dólares", None, None, 39375000),
        ("10.070.000.000 centavos de real", None, None, 10070000000),
        ("10 x R$22.400,00", None, None, 22400000),
        ("2 instalments of USD 60,456.00", None, "en", 63478800),
        ("R$ 60.000,00 (sessenta mil reais)", None, None, 6000000),
        ("15", "em milhares de dólares", None, 7875000),
        ("1,5", "milhões de reais", None, 150000000),
        ("50", "R$ '000", None, 5000000),
        ("200.000", "nao_localizado", None, None),
        ("conforme apólice anterior", "BRL", None, None),
        ("10 a 20 mil reais", "BRL", None, None),
        ("10 xyz", "BRL", None, None),
        (None, "BRL", None, None),
        ("", "BRL", None, None),
        ("9" * 5000, "BRL", None, None),
    ]
    rows = [(k, f"d{k}", m, v, None, None) for k, (v, m, _, _) in enumerate(cases)]
    got = run(spark, rows + rows, [(f"d{k}", c[2]) for k, c in enumerate(cases)])
    for k, (value, moeda, lang, cents) in enumerate(cases):
        assert got.get((k, "limite_maximo_garantia")) == cents, value


def test_percentage_of_own_limit(spark):
    got = run(spark, [(1, "d", "BRL", "R$ 1.000,10", "5% do LMG", None), (2, "d", "BRL", "a definir", "3 por cento do limite máximo de garantia", None), (3, "d", "BRL", "0,10", "5%", "2%")])
    assert got[(1, "retencao_franquia")] == 5001  # 50.005 rounds half up
    assert (2, "retencao_franquia") not in got
    assert got[(3, "retencao_franquia")] == 1 and got[(3, "premio")] == 0


def test_empty_tables(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize(("a", "b", "most"), [("milhoes", "milhoes", 0), ("milhoess", "milhoes", 0.5), ("dolares", "dolores", 0.6), ("reias", "reais", 0.7)])
def test_weighted_distance(a, b, most):
    assert weighted_distance(a, b) <= most and weighted_distance(b, a) == weighted_distance(a, b)


def test_fuzzy_map_finds_what_brute_force_finds(spark):
    lexicon = [("thousand", "k"), ("milhares", "k"), ("dolares", "usd"), ("millones", "m")]
    words = ["thousand", "tousand", "thousnad", "milhares", "milhrases", "dolaress", "xyz", "mil", "milones"]
    got = {r[0]: r[1] for r in fuzzy_map(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(lexicon, "word string, meaning string")).collect()}
    for w in words:
        near = [(weighted_distance(w, e), m) for e, m in lexicon if w == e or len(w) >= 5 and weighted_distance(w, e) <= 0.25 * len(e)]
        assert got.get(w) == (min(near)[1] if near else None), w
