"""Problem 5: lines repeated across one source's documents.

The state is two small tables per corpus:

* line counts ``(source_name, key_a, key_b, n_docs)``: in how many documents of a source a line stands,
* source sizes ``(source_name, n_docs)``.

A *delta* holds the same for documents not counted before.  Merging adds
counts, ``crossings`` compares the tables before and after, and ``clean_pages``
rebuilds only the documents that contain a line whose status changed.  One
full pass is one delta merged into empty tables.

A line's identity is its text in canonical form, lower case, without white
space, with each digit run replaced by one sign.  Identities are kept as a
128-bit hash in two columns, so no text is shuffled; a collision is implausible
at any corpus size.

Defined results: null and blank pages have no lines; documents without a
source are left out; repeated rows of a page or a delivery count once; a
document delivered by several sources counts in each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import unpack

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_128_digest

from lavra.llm.lookalike import SUSPECT, canonical
from lavra.session import broadcast_if_small, cut

#: Fixed values of the problem.
MIN_CHARS, MIN_DOCS, MIN_SHARE = 30, 4, 0.25


_SUSPECT = re.compile(SUSPECT)
_SPACE, _DIGITS = re.compile(r"[^\S\n]+"), re.compile(r"[0-9]+")
_KEYS = "page_id bigint, document_id string, line_no array<int>, key_a array<bigint>, key_b array<bigint>"


def line_keys(text: str, min_chars: int = MIN_CHARS) -> list[tuple[int, int, int]]:
    """(line_no, key_a, key_b) of the lines of a page that are long enough to be judged."""
    text = canonical(text) if _SUSPECT.search(text) else text
    lines = _SPACE.sub(" ", text).split("\n")
    keyed = _DIGITS.sub("#", text.lower()).replace(" ", "").split("\n")
    out = []
    for k, line in enumerate(lines):
        if len(line) >= min_chars and len(line.strip()) >= min_chars:
            key = keyed[k] if keyed[k].isascii() or not _SPACE.search(keyed[k]) else _SPACE.sub("", keyed[k])
            out.append((k + 1, *unpack("<qq", xxh3_128_digest(key.replace("\t", "").replace("\r", "")))))
    return out


def _keyer(min_chars: int):
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [list(zip(*line_keys(t, min_chars))) or [(), (), ()] for t in batch["text"]]
            yield pd.DataFrame(
                {"page_id": batch["page_id"], "document_id": batch["document_id"], "line_no": [list(f[0]) for f in found], "key_a": [list(f[1]) for f in found], "key_b": [list(f[2]) for f in found]}
            )

    return keys


def page_lines(pages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per page and judged line: page_id, document_id, line_no, key_a, key_b.

    The keys are made in one pass over the text and kept in the shared folder, one row a page: counting and finding the
    occurrences both read them there.
    """
    made = cut(pages.where(F.length("text") > 0).select(F.col("page_id").cast("bigint").alias("page_id"), "document_id", "text").mapInPandas(_keyer(min_chars), _KEYS))
    each = F.explode(F.arrays_zip("line_no", "key_a", "key_b")).alias("l")
    return made.select("page_id", "document_id", each).select("page_id", "document_id", "l.line_no", "l.key_a", "l.key_b")


def document_sources(deliveries: DataFrame) -> DataFrame:
    """Distinct (document_id, source_name), without deliveries of unknown source."""
    return (
        deliveries.where(F.col("source_name").isNotNull() & F.col("sha256").isNotNull())
        .select(F.col("sha256").alias("document_id"), "source_name")
        .distinct()
    )


def delta(lines: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line counts and source sizes of documents that are in no earlier delta.

    The inner ``distinct`` makes a line count once a document; both of its
    halves aggregate before the shuffle, on (source, line, document), so a
    source with a third of all rows spreads over every partition.
    """
    counts = (
        lines.join(sources, "document_id")
        .select("source_name", "key_a", "key_b", F.xxhash64("document_id").alias("doc"))
        .distinct()
        .groupBy("source_name", "key_a", "key_b")
        .agg(F.count("*").alias("n_docs"))
    )
    return counts, sources.groupBy("source_name").agg(F.count("*").alias("n_docs"))


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables of earlier deltas with a new one added; both sides hold one row a key."""
    keys = [c for c in old.columns if c != "n_docs"]
    return old.unionByName(new).groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"))


def repeated_keys(counts: DataFrame, sizes: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source_name, key_a, key_b) of the lines over both thresholds.

    At most ``lines per document / min_share`` lines of a source can pass, so
    the result grows with the number of sources only.
    """
    total = sizes.select("source_name", F.col("n_docs").alias("source_docs"))
    return (
        counts.where(F.col("n_docs") >= min_docs)
        .join(total, "source_name")
        .where(F.col("n_docs") >= min_share * F.col("source_docs"))
        .select("source_name", "key_a", "key_b")
    )


def crossings(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], **thresholds) -> DataFrame:
    """Lines whose status differs between two states: crossed = 1 newly repeated, -1 no longer."""
    before = repeated_keys(*old, **thresholds).withColumn("b", F.lit(1))
    after = repeated_keys(*new, **thresholds).withColumn("a", F.lit(1))
    change = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    keys = ["source_name", "key_a", "key_b"]
    return before.join(after, keys, "full_outer").withColumn("crossed", change).where("crossed <> 0").drop("a", "b")


def occurrences(lines: DataFrame, sources: DataFrame, repeated: DataFrame) -> DataFrame:
    """(page_id, document_id, line_no) of every occurrence of a repeated line, distinct."""
    return (
        lines.join(broadcast_if_small(repeated), ["key_a", "key_b"])
        .join(sources, ["document_id", "source_name"])
        .select(F.col("page_id").cast("bigint").alias("page_id"), "document_id", F.col("line_no").cast("bigint").alias("line_no"))
        .distinct()
    )


def clean_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages without their repeated lines; pages of untouched documents are not rebuilt or returned."""
    drop = found.groupBy("page_id").agg(F.collect_set("line_no").alias("_drop"))
    parts = F.split("text", "\n")
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("_drop", (i + 1).cast("bigint")), x)), lambda x: x.isNotNull())
    own = Window.partitionBy("page_id").orderBy(F.col("text").asc_nulls_last())
    touched = pages.join(drop, "page_id").withColumn("_k", F.row_number().over(own)).where("_k = 1")
    return touched.withColumn("text", F.array_join(kept, "\n")).drop("_drop", "_k")
