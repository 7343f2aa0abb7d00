"""Fuzzy mapping of a set of spellings onto a lexicon: n-gram index, then weighted edit distance."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(ch))


#: Accented letters of Portuguese, Spanish and English texts and their plain letters.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyaaaaaaeeeeiiiiooooouuuucny"


def plain_column(text: Column) -> Column:
    """Lower case without the accents of ``ACCENTED``, in the JVM."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def weighted_distance(a: str, b: str) -> float:
    """Edit distance with cheap vowel swaps, doubled letters and transpositions."""
    vowels = set("aeiou")
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else 0.6 if x in vowels and y in vowels else 1.0
            drop = 0.5 if i > 1 and a[i - 2] == x else 1.0
            add = 0.5 if j > 1 and b[j - 2] == y else 1.0
            cost = min(row[j - 1] + swap, row[j] + drop, new[j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                cost = min(cost, before[j - 2] + 0.7)
            new.append(cost)
        before, row = row, new
    return row[-1]


@F.pandas_udf(DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)])


def n_grams(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams of a text with one sign at either end."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, n)))


def fuzzy_map(spellings: DataFrame, lexicon: DataFrame, max_relative: float = 0.25, min_length: int = 5, n: int = 2) -> DataFrame:
    """(word, meaning, distance) of the spellings that are in, or close to a word of, the lexicon.

    ``spellings`` has distinct ``word``; ``lexicon`` has ``word`` and ``meaning``.
    Equal words map at distance 0.  Others meet the lexicon through an inverted
    index of n-grams, those sharing half of them are verified by
    ``weighted_distance`` and kept up to ``max_relative`` of the word's length.
    Ties go to the first lexicon word, then the first meaning.
    """
    index = lexicon.select(F.col("word").alias("entry"), "meaning", F.explode(n_grams(F.col("word"), n)).alias("gram"), F.size(n_grams(F.col("word"), n)).alias("m"))
    grams = n_grams(F.col("word"), n)
    exact = spellings.join(lexicon, "word").select("word", "meaning", F.lit(0.0).alias("distance"), F.col("word").alias("entry"))
    rest = spellings.join(lexicon.select("word"), "word", "left_anti").where(F.length("word") >= min_length)
    shared = (
        rest.select("word", F.size(grams).alias("g"), F.explode(grams).alias("gram"))
        .join(index, "gram")
        .groupBy("word", "entry", "meaning", "g", "m")
        .agg(F.count("*").alias("s"))
        .where(2 * F.col("s") >= F.greatest("g", "m") - n)
        .withColumn("distance", _distance("word", "entry"))
        .where(F.col("distance") <= max_relative * F.length("entry"))
        .select("word", "meaning", "distance", "entry")
    )
    best = F.min(F.struct("distance", "entry", "meaning")).alias("b")
    return exact.unionByName(shared).groupBy("word").agg(best).select("word", "b.meaning", "b.distance")
