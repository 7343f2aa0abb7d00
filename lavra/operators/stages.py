"""The stage at which retrieval first selects each clause for each field, in one pass over whole documents.

Every stage of ``retrieval.select_stage`` looks at one document alone, and later stages keep what earlier ones took.  So
the clauses of a document, reduced to query words and phrases, travel once to one place, where both rankings and all
stages are worked out; nothing of a stage is shuffled or written.

Defined results: as in ``retrieval``; null pages come last and touch no other page; a clause that ends before it begins adds none
to the size of its section; of rows of one clause that differ, one counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lavra.functions import dims
from lavra.operators.retrieval import B, COVER_FIELD, K1, SECTION_PAGES, reduce_clauses

#: Candidates of a field at stage 0; critical fields have four at least.
LIMIT = 2
_FIRST = "document_id string, field_name string, clause_id string, stage int"
_CLAUSE = ("clause_id", "page_start", "page_end", "norm_title", "toc", "major", "length", "words", "in_text", "in_title")
_PLACES = Decimal("1e-8")


@lru_cache(maxsize=2)
def _dimensions(further: bool) -> tuple[dict[str, list[str]], dict[str, list[str]], dict[str, int]]:
    """Fields of each term and of each phrase, and the number of terms of each field."""
    of_term, of_phrase, n_terms = defaultdict(list), defaultdict(list), {}
    for field, term, n in dims.term_rows(further):
        of_term[term].append(field)
        n_terms[field] = n
    for field, phrase, _ in dims.alias_rows(further):
        of_phrase[phrase].append(field)
    return dict(of_term), dict(of_phrase), n_terms


def _rounded(x: float) -> float:
    """Eight decimals, halves up, as SQL rounds."""
    return float(Decimal(repr(x)).quantize(_PLACES, ROUND_HALF_UP))


def _ranked(clauses: list[dict], further: bool) -> dict[str, list[dict]]:
    """Candidates of each field, best first."""
    of_term, of_phrase, n_terms = _dimensions(further)
    scored: dict[str, list[tuple]] = defaultdict(list)
    for c in clauses:
        bm25, overlap, hits, headings = defaultdict(float), Counter(), Counter(), Counter()
        for term, weight in c["weights"].items():
            for field in of_term.get(term, ()):
                bm25[field] += weight
                overlap[field] += 1
        for phrases, count in ((c["in_text"], hits), (c["in_title"], headings)):
            for phrase in phrases:
                count.update(of_phrase.get(phrase, ()))
        start, end = c["page_start"], c["page_end"]
        for field in {*bm25, *hits, *headings}:
            if hits[field] or headings[field] or (overlap[field] >= min(2, n_terms[field]) and bm25[field] > 0):
                total = bm25[field] + 4 * hits[field] + 8 * headings[field]
                total *= 0.2 if c["running"] else 1
                total *= 0.25 if c["toc"] else 1
                # a null page leaves no score; nulls come last everywhere, as in the SQL
                score = None if start is None else _rounded(total + 0.01 / (1 + start))
                order = (score is None, -(score or 0), start is None, start or 0, end is None, end or 0, c["clause_id"])
                scored[field].append((order, c))
    return {field: [c for _, c in sorted(found, key=lambda x: x[0])] for field, found in scored.items()}


def _span(clauses: list[dict]) -> int:
    """Number of different pages of some clauses."""
    n, last = 0, None
    for start, end in sorted((c["page_start"], c["page_end"]) for c in clauses if c["paged"] and c["page_start"] <= c["page_end"]):
        if last is None or end > last:
            n += end - (start - 1 if last is None else max(start - 1, last))
            last = end
    return n


def first_in_document(clauses: list[dict], n_pages: int) -> dict[tuple[str, str], int]:
    """(field, clause) with the first stage that selects them, of the distinct clauses of one document."""
    lengths = [c["length"] for c in clauses]
    n, mean = len(clauses), sum(lengths) / len(clauses) or 1.0
    df = Counter(term for c in clauses for term in set(c["words"]))
    titles = Counter(c["norm_title"] for c in clauses)
    section, sections = 0, defaultdict(list)
    for c in sorted(clauses, key=lambda c: (c["page_start"] is None, c["page_start"] or 0, c["clause_id"] is None, c["clause_id"] or "")):
        c["running"] = c["norm_title"] is not None and titles[c["norm_title"]] >= max(3, n_pages // 2)
        c["paged"] = c["page_start"] is not None and c["page_end"] is not None
        section += c["major"] and not c["running"]
        c["section"] = section
        sections[section].append(c)
        norm = K1 * (1 - B + B * c["length"] / mean)
        c["weights"] = {t: log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(c["words"]).items()}
    named = [c for c in clauses if c["clause_id"] is not None]
    taken = {k: 0 < _span(own) <= SECTION_PAGES for k, own in sections.items()}
    paged = [c for c in named if c["paged"]]
    first: dict[tuple[str, str], int] = {}

    def take(field: str, chosen: list[dict], stage: int) -> None:
        for c in chosen:
            first.setdefault((field, c["clause_id"]), stage)

    plain, further = _ranked(named, False), _ranked(named, True)
    take(COVER_FIELD, [c for c in paged if c["page_start"] <= 1 <= c["page_end"]], 0)
    for field, ranked in plain.items():
        limit = max(LIMIT, 4) if field in dims.CRITICAL else LIMIT
        seeds = ranked[: 2 * limit]
        take(field, ranked[:limit], 0)
        take(field, seeds, 1)
        near = [(s["page_start"] - 1, s["page_end"] + 1) for s in seeds if s["paged"]]
        take(field, [c for c in paged if any(c["page_start"] <= end and c["page_end"] >= start for start, end in near)], 2)
        for k in {s["section"] for s in seeds}:
            if taken[k]:
                take(field, [c for c in sections[k] if c["clause_id"] is not None], 3)
    for field, ranked in further.items():
        take(field, ranked, 4)
    return first


def _once_each(clauses: list[dict]) -> list[dict]:
    """Clauses once each."""
    own: dict = {}
    for c in clauses:
        k = c["clause_id"]
        if k not in own or repr(c) < repr(own[k]):
            own[k] = c
    return list(own.values())


def _from_arrow(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(document, its clauses, its number of pages, the associations asked for) of every row."""
    lists = batch.column("clauses")
    columns = [x.to_pylist() for x in lists.flatten().flatten()]
    rows, asked = zip(*columns), batch.column("asked").to_pylist()
    for document, n, n_pages, pairs in zip(batch.column("document_id").to_pylist(), lists.value_lengths().to_pylist(), batch.column("n_pages").to_pylist(), asked):
        clauses = []
        for _, row in zip(range(n), rows):
            c = dict(zip(_CLAUSE, row))
            c["words"], c["in_text"], c["in_title"] = c["words"].split(), *(tuple(filter(None, c[x].split("|"))) for x in ("in_text", "in_title"))
            clauses.append(c)
        yield document, _once_each(clauses), n_pages, {(p["field_name"], p["clause_id"]) for p in pairs}


def _selector(only: bool):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for document, clauses, n_pages, asked in _from_arrow(batch):
                for (field, clause), stage in first_in_document(clauses, n_pages).items():
                    if not only or (field, clause) in asked:
                        for column, x in zip(out, (document, field, clause, stage)):
                            column.append(x)
                if len(out[0]) >= 50_000:
                    yield _batch(out)
                    out = ([], [], [], [])
            yield _batch(out)

    return select


def _batch(columns: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["document_id", "field_name", "clause_id", "stage"])


def first_stages(clauses: DataFrame, pages: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(document_id, field_name, clause_id, stage): the first of stages 0 to 4 that selects a clause for a field.

    With ``only`` (document_id, field_name, clause_id) of those associations alone.  The three tables meet in one shuffle
    by document.
    """
    joined = F.transform(F.array("r"), lambda r: F.struct(r["length"].alias("length"), F.array_join(r["words"], " ").alias("words"), F.array_join(r["in_text"], "|").alias("in_text"))).getItem(0)
    reduced = reduce_clauses(clauses).select("*", joined.alias("j"))
    kinds = {
        "c": reduced.select("document_id", F.struct("clause_id", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), "norm_title", "toc", "major", "j", F.array_join("in_title", "|").alias("in_title")).alias("c")),
        "page": pages.select("document_id", F.col("page_number").alias("page")),
    }
    if only is not None:
        kinds["pair"] = only.select("document_id", F.struct("field_name", "clause_id").alias("pair"))
    rows = None
    for own in kinds.values():
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    pairs = F.collect_set("pair") if only is not None else F.array().cast("array<struct<field_name:string,clause_id:string>>")
    documents = rows.where("document_id IS NOT NULL").groupBy("document_id").agg(F.collect_set("c").alias("c"), F.size(F.collect_set("page")).alias("n_pages"), pairs.alias("asked")).where("size(c) > 0")
    if only is not None:
        documents = documents.where("size(asked) > 0")
    flat = F.transform("c", lambda c: F.struct(*[(c["j"][x] if x in ("length", "words", "in_text") else c[x]).alias(x) for x in _CLAUSE]))
    return documents.select("document_id", flat.alias("clauses"), "n_pages", "asked").mapInArrow(_selector(only is not None), _FIRST)
