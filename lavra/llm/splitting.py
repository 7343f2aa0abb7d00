"""Problem 6: pieces of oversized items, cut at natural boundaries.

Dynamic programming over boundary positions.  A cut costs by the kind of
boundary (paragraph < sentence < clause < word < none) and a piece by its
distance from an even share, so that the cheapest chain of pieces under the
limit has natural ends and similar sizes.  Each piece after the first starts at
the word start that gives the largest overlap within ``overlap`` characters of
the previous piece.

Only items over the limit cross to Python; all others are one piece made in the JVM.

Defined results: white space at both ends is not counted and not kept in
pieces; null texts have no piece; a stretch without any boundary is cut at
even steps; offsets count code points of the stored text.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Fixed values of the problem.
MAX_CHARS, OVERLAP = 1200, 150

#: Costs of a cut by the kind of boundary it stands at.
COSTS = {"paragraph": 0.0, "line": 0.05, "sentence": 0.1, "clause": 0.45, "word": 1.0, "none": 3.0}
_PIECES = "array<struct<start:int,end:int,text:string>>"
_BOUNDARY = re.compile(r"(\n[ \t]*\n\s*)|(\n\s*)|((?<=[.!?…])[\"”’)\]]*\s+)|((?<=[;:,])\s+)")
_KINDS = ("paragraph", "line", "sentence", "clause")
_WORD = re.compile(r"\s+")


def _boundaries(text: str, room: int) -> tuple[list[int], list[float], list[int]]:
    """Positions where a piece may end, with costs, and the starts of words.

    Word ends serve only where no better boundary lies within a quarter of
    ``room``; plain positions only where there is no word end either.
    """
    gap = max(1, room // 4)
    starts = [m.end() for m in _WORD.finditer(text)]
    good = {m.start(): COSTS[_KINDS[m.lastindex - 1]] for m in _BOUNDARY.finditer(text)}
    good.pop(0, None)
    good[len(text)] = 0.0
    cuts: dict[int, float] = {}
    at, word = 0, 0
    for end in sorted(good):
        while end - at > gap:
            word = max(word, bisect_left(starts, at + 1))
            k = bisect_left(starts, at + gap, word)
            # the last word end within the gap, else a plain position
            best = 0
            while k > word:
                k -= 1
                stop = len(text[at : starts[k]].rstrip()) + at
                if at < stop <= at + gap:
                    best = stop
                    break
            if best:
                cuts[best], at = COSTS["word"], best
            else:
                cuts[at + gap], at = COSTS["none"], at + gap
        cuts[end], at = good[end], end
    ordered = sorted(cuts)
    return ordered, [cuts[p] for p in ordered], starts


def spans(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text without white space at its ends."""
    n = len(text)
    if n <= max_chars:
        return [(0, n)] if n else []
    ends, costs, words = _boundaries(text, max_chars - overlap)
    begin = [0]
    for e in ends:
        k = bisect_left(words, e - overlap)
        s = words[k] if k < len(words) and words[k] < e else max(0, e - overlap)
        begin.append(s if overlap else bisect_and_skip(text, e))
    pieces = -(-(n - overlap) // (max_chars - overlap))
    even = (n + overlap * (pieces - 1)) / pieces
    best, came = [0.0], [-1]
    low = 0
    for i, e in enumerate(ends, 1):
        while e - begin[low] > max_chars:
            low += 1
        cost, src = float("inf"), low
        for j in range(low, i):
            length = e - begin[j]
            if length > max_chars or begin[j] >= e:
                continue
            c = best[j] + 0.3 + ((length - even) / max_chars) ** 2
            if c < cost:
                cost, src = c, j
        best.append(cost + costs[i - 1])
        came.append(src)
    chain, i = [], len(ends)
    while i > 0:
        chain.append((begin[came[i]], ends[i - 1]))
        i = came[i]
    return chain[::-1]


def bisect_and_skip(text: str, end: int) -> int:
    """First position at or after ``end`` that is no white space."""
    while end < len(text) and text[end].isspace():
        end += 1
    return end


def _split_udf(max_chars: int, overlap: int):
    @F.pandas_udf(_PIECES)
    def split(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            lead = len(text) - len(text.lstrip())
            body = text.strip()
            return [{"start": lead + s, "end": lead + e, "text": body[s:e]} for s, e in spans(body, max_chars, overlap)]

        return texts.map(one)

    return split


def split_items(items: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``items`` with ``pieces`` (start, end, text of each) and ``oversized`` (more than one piece)."""
    column = F.col(text)
    long = F.length(column) > max_chars
    space = r"[\t-\r\x1c-\x1f \x85\xa0  -     　]"
    short = F.regexp_replace(column, rf"^{space}+|{space}+\z", "")
    lead = F.length(F.regexp_extract(column, rf"^{space}*", 0))
    whole = F.when(
        F.length(short) > 0,
        F.array(F.struct(lead.cast("int").alias("start"), (lead + F.length(short)).cast("int").alias("end"), short.alias("text"))),
    ).otherwise(F.array().cast(_PIECES))
    pieces = F.when(long, _split_udf(max_chars, overlap)(F.when(long, column))).when(column.isNotNull(), whole)
    return items.withColumn("pieces", pieces).withColumn("oversized", F.size(F.coalesce("pieces", F.array().cast(_PIECES))) > 1)


def oversized(items: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The rows that come out in several pieces; shorter texts leave before Python sees them."""
    return split_items(items.where(F.length(text) > max_chars), text, max_chars, overlap).where("oversized")


def renumber(split: DataFrame) -> DataFrame:
    """Pieces of page-bound chunks as rows, with chunk_index from 0 within document, clause and page."""
    pieces = split.select("document_id", "clause_id", "page_number", "chunk_index", "chunk_id", F.posexplode("pieces").alias("k", "p"))
    order = Window.partitionBy("document_id", "clause_id", "page_number").orderBy("chunk_index", "chunk_id", "k")
    return pieces.select(
        "document_id", "clause_id", "page_number", (F.row_number().over(order) - 1).alias("chunk_index"), F.col("chunk_id").alias("from_chunk_id"), "p.text"
    )


def clause_pieces(clauses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pieces of clauses as rows, with the page on which each begins.

    A clause's text follows its chunks page by page, so the running sum of
    their lengths (``n``) tells the page of an offset; a clause without chunks
    lies on its first page.
    """
    key = ["document_id", "clause_id"]
    pages = chunks.groupBy(*key, "page_number").agg(F.sum("n").alias("n"))
    begins = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = pages.select(*key, F.struct(begins.alias("begin"), "page_number").alias("m")).groupBy(*key).agg(F.array_sort(F.collect_list("m")).alias("marks"))
    split = split_items(clauses).select(*key, "page_start", F.posexplode("pieces").alias("k", "p"))
    known = F.filter("marks", lambda m: m["begin"] <= F.col("p.start"))
    page = F.coalesce(F.try_element_at(known, F.lit(-1))["page_number"], F.col("page_start"))
    placed = split.join(marks, key, "left").select(*key, page.alias("page_number"), "k", F.col("p.text").alias("text"))
    order = Window.partitionBy(*key, "page_number").orderBy("k")
    return placed.select(*key, "page_number", (F.row_number().over(order) - 1).alias("chunk_index"), "text")
