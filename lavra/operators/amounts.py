"""Problem 3: amounts in several currencies, scales and wordings, in hundredths of one currency.

An amount is taken apart in the JVM into a number, instalments or a percentage,
and unit text.  The distinct words of all unit texts are mapped onto a lexicon
of currencies and scales (n-gram inverted index, weighted edit distance); the
resulting alias dictionary is joined back to every row.  Words no entry
explains make an amount unreadable, as they may change its meaning.

Defined results: null, vague and missing values, and amounts whose unit text
holds an unknown word, have no row; repeated rows give one; an amount with a
scale but no currency takes the currency of ``moeda`` and not its scale; a
percentage needs a readable limit that is none itself; separators that cannot
stand in the document's notation make a number unreadable.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lavra.functions.matching import fuzzy_map, plain, plain_column
from lavra.session import broadcast_if_small, cut

FIELDS = ("limite_maximo_garantia", "retencao_franquia", "premio")

# Words of units.  A meaning is a currency code, a scale, or nothing.
CURRENCIES = {
    "BRL": "brl r$ real reais reales brazilian brasileiro brasileiros",
    "USD": "usd us$ u$ us dolar dolares dollar dollars americanos estadounidenses",
    "EUR": "eur € euro euros",
}
SCALES = {
    "0.01": "cent cents centavo centavos centimo centimos ¢",
    "1000": "k mil miles milhar milhares thousand thousands '000 000 1.000 1,000 1000",
    "1000000": "m mi mm mio milhao milhoes millon millones million millions",
    "1000000000": "bi bilhao bilhoes billion billions",
}
FILLERS = "de del do da em en in of e x por ( )"

# Number words.
NUMBER_WORDS = {
    "um": 1, "uma": 1, "un": 1, "uno": 1, "one": 1, "dois": 2, "duas": 2, "dos": 2, "two": 2, "tres": 3, "three": 3,
    "quatro": 4, "cuatro": 4, "four": 4, "cinco": 5, "five": 5, "seis": 6, "six": 6, "sete": 7, "siete": 7, "seven": 7,
    "oito": 8, "ocho": 8, "eight": 8, "nove": 9, "nueve": 9, "nine": 9, "dez": 10, "diez": 10, "ten": 10,
    "onze": 11, "once": 11, "eleven": 11, "doze": 12, "doce": 12, "twelve": 12, "treze": 13, "trece": 13, "thirteen": 13,
    "quatorze": 14, "catorze": 14, "catorce": 14, "fourteen": 14, "quinze": 15, "quince": 15, "fifteen": 15,
    "dezesseis": 16, "dieciseis": 16, "sixteen": 16, "dezessete": 17, "diecisiete": 17, "seventeen": 17,
    "dezoito": 18, "dieciocho": 18, "eighteen": 18, "dezenove": 19, "diecinueve": 19, "nineteen": 19,
    "vinte": 20, "veinte": 20, "twenty": 20, "veinticinco": 25, "trinta": 30, "treinta": 30, "thirty": 30,
    "quarenta": 40, "cuarenta": 40, "forty": 40, "cinquenta": 50, "cincuenta": 50, "fifty": 50,
    "sessenta": 60, "sesenta": 60, "sixty": 60, "setenta": 70, "seventy": 70, "oitenta": 80, "ochenta": 80, "eighty": 80,
    "noventa": 90, "ninety": 90, "cem": 100, "cento": 100, "cien": 100, "ciento": 100,
    "duzentos": 200, "doscientos": 200, "trezentos": 300, "trescientos": 300, "quatrocentos": 400, "cuatrocientos": 400,
    "quinhentos": 500, "quinientos": 500, "seiscentos": 600, "seiscientos": 600, "setecentos": 700, "setecientos": 700,
    "oitocentos": 800, "ochocientos": 800, "novecentos": 900, "novecientos": 900,
}

_NUMBER = r"[0-9][0-9.,]*[0-9]|[0-9]"
_PERCENT = r"(?:%|por cento|por ciento|per cent|percent)"
_TIMES = r"^\s*([0-9]+)\s*(?:x|parcelas?\s+(?:mensais\s+)?de|cuotas?\s+de|prestac(?:oes|iones)\s+de|instal+ments?\s+of|payments?\s+of|pagos?\s+de)\s+?(?=\D*[0-9])"


def unit_lexicon(spark) -> DataFrame:
    """The lexicon as (word, meaning): 'c:BRL', 's:1000' or ''."""
    rows = [(w, f"c:{code}") for code, words in CURRENCIES.items() for w in words.split()]
    rows += [(w, f"s:{scale}") for scale, words in SCALES.items() for w in words.split()]
    rows += [(w, "") for w in FILLERS.split()]
    return spark.createDataFrame(rows, "word string, meaning string")


def unit_words(text: Column) -> Column:
    """Words of a unit text; signs and letters part, as in ``us$k``."""
    return F.regexp_extract_all(text, F.lit(r"(?:r|us|u)\$|€|¢|'?[0-9][0-9.,]*|[a-z]+|[^\s\w()]"), F.lit(0))


def spelled_number(text: str | None) -> tuple[str | None, str | None]:
    """(number, unit text) of an amount in words: ``cinco milhoes de reais`` is 5000000 and ``reais``."""
    words = re.findall(r"[a-z]+|[^\sa-z]+", plain(text or ""))
    total, part, seen, k = 0, 0, False, 0
    hundreds = {"hundred": 100}
    thousands = {w: int(s) for s, ws in SCALES.items() if s != "0.01" for w in ws.split() if len(w) > 2 and w.isalpha()}
    for k, w in enumerate(words):
        if w in NUMBER_WORDS:
            part, seen = part + NUMBER_WORDS[w], True
        elif w in hundreds and seen:
            part = max(part, 1) * 100
        elif w in thousands and (seen or w == "mil"):
            total, part, seen = total + max(part, 1) * thousands[w], 0, True
        elif not (seen and w in ("e", "y", "and", "de")):
            break
    else:
        k = len(words)
    return (str(total + part), " ".join(words[k:])) if seen else (None, None)


def _spelled_udf():
    @F.pandas_udf("struct<number:string,unit:string>")
    def spelled(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([spelled_number(t) for t in texts], columns=["number", "unit"])

    return spelled


def _decimal(number: Column, lang: Column) -> Column:
    """A number in the notation of its language, or null where it cannot be one."""
    english = lang.eqNullSafe("en")
    point = F.when(english, F.regexp_replace(number, ",", "")).otherwise(F.translate(F.regexp_replace(number, r"\.", ""), ",", "."))
    fits = F.when(english, number.rlike(r"^(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?$")).otherwise(
        number.rlike(r"^(?:[0-9]+|[0-9]{1,3}(?:\.[0-9]{3})+)(?:,[0-9]+)?$")
    )
    return F.when(fits, point.try_cast("decimal(24,4)"))


def parse_amounts(values: DataFrame) -> DataFrame:
    """``values`` (with ``value`` and ``lang``) taken apart: number, times, percent, unit."""
    low = F.trim(plain_column(F.col("value")))
    digits = low.rlike("[0-9]")
    spelled = _spelled_udf()(F.when(~digits, low))
    df = values.withColumn("_low", F.when(digits, F.regexp_replace(low, r"\([^()]*\)\s*$", ""))).withColumn("_w", spelled)
    times = F.regexp_extract("_low", _TIMES, 1)
    df = df.withColumn("times", F.when(times != "", times.try_cast("bigint")).otherwise(F.when(digits | F.col("_w.number").isNotNull(), F.lit(1).cast("bigint"))))
    df = df.withColumn("_low", F.regexp_replace("_low", _TIMES, ""))
    percent = F.col("_low").rlike(rf"^\s*(?:{_NUMBER})\s*{_PERCENT}")
    number = F.regexp_extract("_low", _NUMBER, 0)
    single = F.size(F.regexp_extract_all("_low", F.lit(_NUMBER), F.lit(0))) == 1
    unit = F.regexp_replace("_low", _NUMBER, " ")
    return (
        df.withColumn("percent", F.coalesce(percent, F.lit(False)))
        .withColumn("number", F.when(F.col("_low").isNotNull(), F.when(single, _decimal(number, F.col("lang")))).otherwise(F.col("_w.number").try_cast("decimal(24,4)")))
        .withColumn("unit", F.trim(F.when(F.col("_low").isNotNull(), unit).otherwise(F.col("_w.unit"))))
        .drop("_low", "_w")
    )


def alias_dictionary(texts: DataFrame) -> DataFrame:
    """(unit, currency, scale, known) of each distinct unit text of column ``unit``.

    ``known`` is false where a word has no meaning, or words contradict each other.
    """
    spark = texts.sparkSession
    distinct = texts.where(F.col("unit").isNotNull()).select("unit").distinct()
    words = distinct.select("unit", F.explode_outer(unit_words(F.col("unit"))).alias("word"))
    meanings = fuzzy_map(words.select("word").where("word is not null").distinct(), unit_lexicon(spark))
    met = words.join(broadcast_if_small(meanings), "word", "left")
    meaning = F.col("meaning")
    code = F.when(meaning.startswith("c:"), F.substring(meaning, 3, 9))
    scale = F.when(meaning.startswith("s:"), F.substring(meaning, 3, 12).cast("decimal(12,2)"))
    return (
        met.groupBy("unit")
        .agg(
            F.min(code).alias("currency"),
            F.countDistinct(code).alias("_codes"),
            F.min(scale).alias("scale"),
            F.countDistinct(scale).alias("_scales"),
            F.count_if(F.col("word").isNotNull() & meaning.isNull()).alias("_unknown"),
        )
        .select("unit", "currency", "scale", ((F.col("_unknown") == 0) & (F.col("_codes") <= 1) & (F.col("_scales") <= 1)).alias("known"))
    )


def convert_amounts(extractions: DataFrame, languages: DataFrame, rates: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(extraction_id, field_name, brl_cents) of every readable amount.

    ``languages`` has (document_id, lang), one row a document; ``rates`` is the
    table of exchange rates, one row a currency.
    """
    base = extractions.select(F.col("extraction_id").cast("bigint").alias("extraction_id"), "document_id", "moeda", *fields).distinct().join(languages, "document_id", "left")
    long = base.select("extraction_id", "lang", "moeda", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("f"))
    parsed = parse_amounts(long.select("extraction_id", "lang", F.trim(plain_column(F.col("moeda"))).alias("moeda"), "f.field_name", "f.value").where("value is not null"))
    # read for the dictionary, the amounts and the shares: taken apart once and kept
    parsed = cut(parsed.where(F.col("number").isNotNull()).select("extraction_id", "field_name", "moeda", "number", "times", "percent", "unit"))
    texts = parsed.select(F.explode(F.array(F.when(~F.col("percent"), F.col("unit")), F.col("moeda"))).alias("unit")).distinct()
    aliases = broadcast_if_small(alias_dictionary(texts))
    own = aliases.select("unit", F.col("currency").alias("own_currency"), F.col("scale").alias("own_scale"), F.col("known").alias("own_known"))
    shared = aliases.select(F.col("unit").alias("moeda"), F.col("currency").alias("moeda_currency"), F.col("scale").alias("moeda_scale"), F.col("known").alias("moeda_known"))
    joined = parsed.join(own, "unit", "left").join(shared, "moeda", "left")
    bare = F.col("own_currency").isNull() & F.col("own_scale").isNull()
    from_moeda = F.when(F.col("moeda_known"), F.col("moeda_currency"))
    one = F.lit(1).cast("decimal(12,2)")
    currency = F.coalesce("own_currency", from_moeda)
    scale = F.when(bare, F.coalesce("moeda_scale", one)).otherwise(F.coalesce("own_scale", one))
    price = rates.select(F.col("currency").alias("_code"), "brl_per_unit").distinct()
    amounts = (
        joined.where(~F.col("percent") & F.col("own_known"))
        .withColumn("_code", currency)
        .withColumn("_scale", scale)
        .join(price, "_code")
        .withColumn("brl", (F.col("number") * F.col("_scale") * F.col("times")).cast("decimal(30,6)") * F.col("brl_per_unit").cast("decimal(8,2)"))
        .select("extraction_id", "field_name", "brl")
    )
    limit = amounts.where(F.col("field_name") == fields[0]).select("extraction_id", F.col("brl").alias("limit_brl"))
    shares = (
        parsed.where(F.col("percent") & (F.col("field_name") != fields[0]))
        .join(limit, "extraction_id")
        .select("extraction_id", "field_name", (F.col("limit_brl").cast("decimal(24,6)") * (F.col("number") / 100).cast("decimal(12,6)")).alias("brl"))
    )
    both = amounts.select("extraction_id", "field_name", F.col("brl").cast("decimal(38,8)")).unionByName(shares.select("extraction_id", "field_name", F.col("brl").cast("decimal(38,8)")))
    return both.select("extraction_id", "field_name", F.round(F.col("brl") * 100, 0).cast("bigint").alias("brl_cents")).distinct()
