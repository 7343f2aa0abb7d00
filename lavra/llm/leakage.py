"""Problem 9: evaluation passages inside a training corpus.

Wu-Manber search for many patterns.  Texts and quotes are folded to words
(lower case, no accents, canonical characters) joined by single spaces.  The
patterns are all runs of ``run`` words of every quote, and whole quotes of
fewer words, each with a space at both ends so that it meets whole words only.
A table gives, for the block of characters that ends at a position, how far the
search may skip; blocks in no pattern skip almost the length of the shortest
pattern.  Where the shift is zero, the bucket of that block holds the
candidates, and comparison with the text confirms them.

The tables are built on the driver from the evaluation items and broadcast.
Their size is that of a held-out set and not of the corpus; it is measured
first, and items whose quotes exceed ``BLOCK_CHARS`` characters together are
searched in blocks below it, one pass over the corpus each, with only one
block's tables alive at a time.  The corpus is not shuffled.

Defined results: null, empty and blank texts contain nothing; null quotes and
quotes without a word have no pattern; equal quotes of several items report each.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import defaultdict
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lavra.llm.lookalike import canonical
from lavra.session import cut

#: Fixed value of the problem: words in a row that make a leak.
RUN = 12
#: Characters of a block; long enough that ordinary text rarely meets a block of a quote.
BLOCK = 6
#: Characters of quotes that one pass searches for; more are searched in several passes.
BLOCK_CHARS = 4_000_000

_WORDS = re.compile(r"[^\W_]+")


def fold_words(text: str) -> str:
    """Words of a text without case, accents and punctuation, joined by spaces, with one at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", canonical(text).casefold())
        text = "".join(ch for ch in text if not unicodedata.combining(ch)) if not text.isascii() else text
    else:
        text = text.lower()
    return f" {' '.join(_WORDS.findall(text))} "


class WuManber:
    """Shift and bucket tables of a set of patterns, each carrying the items it stands for."""

    def __init__(self, quotes: list[tuple[int, str]], run: int = RUN, block: int = BLOCK):
        patterns: dict[str, set[int]] = defaultdict(set)
        for item, quote in quotes:
            words = fold_words(quote).split()
            for k in range(max(1, len(words) - run + 1) if words else 0):
                patterns[f" {' '.join(words[k : k + run])} "].add(item)
        self.items = {p: tuple(sorted(i)) for p, i in patterns.items()}
        self.width = min(map(len, patterns), default=0)
        self.block = min(block, self.width)
        self.default = self.width - self.block + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[str]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.width + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.default), self.width - end)
            self.bucket[p[self.width - self.block : self.width]].append(p)

    def search(self, folded: str) -> set[int]:
        """Items with a pattern in a folded text."""
        found: set[int] = set()
        if not self.items:
            return found
        size, width, default, shift, bucket = self.block, self.width, self.default, self.shift.get, self.bucket
        end, n = width, len(folded)
        while end <= n:
            b = folded[end - size : end]
            step = shift(b, default)
            if step:
                end += step
                continue
            for p in bucket[b]:
                if folded.startswith(p, end - width):
                    found.update(self.items[p])
            end += 1
        return found


def _searching(spark, documents: DataFrame, tables: WuManber) -> tuple[DataFrame, object]:
    """(doc_id, item_id) of one pass, not distinct, and its broadcast."""
    shared, name = spark.sparkContext.broadcast(pickle.dumps(tables, protocol=5)), uuid4().hex

    @F.pandas_udf("array<bigint>")
    def search(texts: pd.Series) -> pd.Series:
        loaded = _loaded(name, shared)
        return texts.map(lambda text: sorted(loaded.search(fold_words(text))) if text else [])

    return documents.select("doc_id", F.explode(search("text")).alias("item_id")), shared


_TABLES: dict[str, WuManber] = {}


def _loaded(name: str, shared) -> WuManber:
    """The tables, unpickled once in a Python worker."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = pickle.loads(shared.value)
    return _TABLES[name]


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) of every document that holds a run of words of an item's quote."""
    spark = documents.sparkSession
    texts = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    quotes = items.where(F.length("quote") > 0).select(F.col("item_id").cast("bigint").alias("item_id"), "quote").distinct()
    chars = quotes.agg(F.sum(F.length("quote"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    if blocks == 1:
        found, _ = _searching(spark, texts, WuManber([tuple(r) for r in quotes.collect()], run, block))
        return found.distinct()
    # items spread evenly by their hash, so a block holds about its share of the characters
    part = cut(quotes.withColumn("part", F.pmod(F.xxhash64("item_id", "quote"), F.lit(blocks))))
    passes = []
    for k in range(blocks):
        rows = [tuple(r) for r in part.where(F.col("part") == k).select("item_id", "quote").collect()]
        found, shared = _searching(spark, texts, WuManber(rows, run, block))
        passes.append(cut(found.distinct()))
        shared.destroy()
    return reduce(DataFrame.unionByName, passes).distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: its theme and in how many documents it leaked; items that did not leak have 0."""
    counts = found.groupBy("item_id").agg(F.count("*").alias("n_docs"))
    base = items.select("item_id", "field_name", "expected_theme").distinct()
    return base.join(counts, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("bigint")))
