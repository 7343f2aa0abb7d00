"""Field-wise retrieval over the clauses of each document, in stages.

A document's clauses are its corpus, so statistics are per document.  ``prepare`` reads every text once and reduces it
to what ranking needs - the query words it holds, the phrases it holds, its length - before duplicates go, so that no
text is shuffled; all later steps partition by document.

Stages: 0 takes a quota of each field's ranking, 1 twice that (or a given limit), 2 adds the pages beside, 3 whole
sections of few pages, 4 ranks with further phrases and takes everything.

Defined results: null texts and titles hold nothing; repeated rows of a clause count once; a document without clauses
has no candidates; equal scores rank by page and clause; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lavra.functions import dims
from lavra.functions.matching import plain_column
from lavra.session import cut

K1, B = 1.5, 0.75
#: Pages of the largest section that is taken as a whole.
SECTION_PAGES = 8
#: The field whose candidates include the clauses of the first page.
COVER_FIELD = "seguradora"
_CLAUSE = ["document_id", "clause_id"]


def normalised(text: Column) -> Column:
    """Plain words of a text joined by single spaces."""
    low = F.replace(plain_column(text), F.lit("ß"), F.lit("ss"))
    return F.array_join(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), " ")


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: as a plain expression it would be repeated wherever the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def held_phrases(norm: Column) -> Column:
    """The search phrases, of all stages, that a normalised text holds as whole words."""
    every = F.array(*[F.lit(f" {a} ") for a in sorted({alias for _, alias, _ in dims.alias_rows(True)})])
    return _once(F.concat(F.lit(" "), norm, F.lit(" ")), lambda n: F.transform(F.filter(every, lambda a: F.contains(n, a)), lambda a: F.trim(a)))


def reduce_clauses(clauses: DataFrame) -> DataFrame:
    """Every row as the steps need it: length in words, query words and phrases of the text (``r``), phrases and flags of the title."""
    wanted = sorted({term for _, term, _ in dims.term_rows(True)})
    title, letters = F.coalesce(F.trim("title"), F.lit("")), F.regexp_replace(F.coalesce("title", F.lit("")), r"[^\p{L}]", "")
    norm_title = normalised(F.coalesce("title", F.lit("")))

    def read(n: Column) -> Column:
        words = F.filter(F.split(n, " "), lambda w: w != "")
        return F.struct(F.size(words).alias("length"), F.filter(words, lambda w: w.isin(wanted)).alias("words"), held_phrases(n).alias("in_text"))

    return clauses.select(
        *_CLAUSE, "page_start", "page_end", norm_title.alias("norm_title"), _once(normalised(F.coalesce("text", F.lit(""))), read).alias("r"), held_phrases(norm_title).alias("in_title"),
        F.coalesce(F.col("text").rlike(r"\.{3,}\s*\d+"), F.lit(False)).alias("toc"),
        (title.rlike(r"^[0-9]{1,2}[.)]?\s+[^0-9]") | ((F.length(letters) >= 8) & (letters == F.upper(letters)))).alias("major"),
    )


def prepare(clauses: DataFrame) -> DataFrame:
    """Clauses once each, reduced."""
    # the struct is kept whole until rows meet, so that it is computed once
    return cut(reduce_clauses(clauses).dropDuplicates(_CLAUSE).select(*_CLAUSE, "page_start", "page_end", "norm_title", "toc", "major", "r.length", "r.words", "r.in_text", "in_title"))


def document_frequency(clauses: DataFrame) -> DataFrame:
    """(document_id, term, df) of all words: in how many clauses of its document each stands."""
    words = F.array_distinct(F.split(normalised(F.coalesce("text", F.lit(""))), " "))
    return clauses.select(*_CLAUSE, F.explode(words).alias("term")).where("term <> ''").groupBy("document_id", "term").agg(F.countDistinct("clause_id").alias("df"))


def corpus_statistics(prepared: DataFrame) -> DataFrame:
    """Per document: number of clauses and their mean length in words (1 where all are empty)."""
    mean = F.avg("length")
    return prepared.groupBy("document_id").agg(F.count("*").alias("n_clauses"), F.when(mean == 0, 1.0).otherwise(mean).alias("mean_length"))


def bm25(prepared: DataFrame, fallback: bool = False) -> DataFrame:
    """(document_id, clause_id, field_name, n_terms, bm25, overlap) of clauses that hold a query term of the field.

    One shuffle by document serves the statistics, the frequencies and the sums.
    """
    own, of_term = Window.partitionBy("document_id"), Window.partitionBy("document_id", "term")
    mean = F.avg("length").over(own)
    sized = prepared.select(*_CLAUSE, "length", "words").repartition("document_id").select(
        *_CLAUSE, "length", "words", F.count("*").over(own).alias("n_clauses"), F.when(mean == 0, 1.0).otherwise(mean).alias("mean_length")
    )
    hits = sized.select(*_CLAUSE, "length", "n_clauses", "mean_length", F.explode("words").alias("term")).groupBy(*_CLAUSE, "length", "n_clauses", "mean_length", "term").agg(F.count("*").alias("tf"))
    counted = hits.withColumn("df", F.count("*").over(of_term))
    idf = F.log1p((F.col("n_clauses") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    terms = F.broadcast(dims.terms(prepared.sparkSession, fallback))
    return counted.join(terms, "term").groupBy(*_CLAUSE, "field_name", "n_terms").agg(F.sum(weight).alias("bm25"), F.count("*").alias("overlap"))


def phrase_hits(prepared: DataFrame, fallback: bool = False) -> DataFrame:
    """(document_id, clause_id, field_name, n_hits, n_headings, matched): phrases of the field in text and title."""
    dim = F.broadcast(dims.aliases(prepared.sparkSession, fallback))
    held = F.explode(F.array_union("in_text", "in_title")).alias("alias")
    each = prepared.select(*_CLAUSE, "in_text", "in_title", held).join(dim, "alias")
    inside = lambda c: F.sum(F.array_contains(c, F.col("alias")).cast("int"))
    return each.groupBy(*_CLAUSE, "field_name").agg(inside("in_text").alias("n_hits"), inside("in_title").alias("n_headings"), F.array_sort(F.collect_set("alias")).alias("matched"))


def repeated_titles(prepared: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, norm_title) of running titles: at least max(3, half the pages) clauses carry them."""
    n_pages = pages.groupBy("document_id").agg(F.countDistinct("page_number").alias("n_pages"))
    return (
        prepared.groupBy("document_id", "norm_title")
        .agg(F.count("*").alias("n"))
        .join(n_pages, "document_id", "left")
        .where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.coalesce("n_pages", F.lit(0)) / 2)))
        .select("document_id", "norm_title")
    )


def rank_fields(prepared: DataFrame, pages: DataFrame, fallback: bool = False) -> DataFrame:
    """Candidates of every field with composite score, methods, matched phrases and rank."""
    key = [*_CLAUSE, "field_name"]
    merged = bm25(prepared, fallback).join(phrase_hits(prepared, fallback), key, "full_outer").drop("n_terms")
    sizes = F.broadcast(dims.terms(prepared.sparkSession, fallback).select("field_name", "n_terms").distinct())
    running = repeated_titles(prepared, pages).withColumn("running", F.lit(True))
    base = prepared.select(*_CLAUSE, "page_start", "page_end", "norm_title", "toc").join(running, ["document_id", "norm_title"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = F.coalesce("bm25", F.lit(0.0))
    admitted = (zero("overlap") >= F.least(F.lit(2), F.col("n_terms"))) & (score > 0)
    total = score + 4 * zero("n_hits") + 8 * zero("n_headings")
    total = F.when(F.col("running"), total * 0.2).otherwise(total)
    total = F.when(F.col("toc"), total * 0.25).otherwise(total)
    total = F.round(total + 0.01 / (1 + F.col("page_start")), 8)
    methods = F.array_compact(
        F.array(
            F.when((zero("n_headings") > 0) & F.col("running").isNull(), "heading"), F.when(zero("n_hits") > 0, "keyword"), F.when(admitted, "bm25"), F.lit("fallback" if fallback else None).cast("string")
        )
    )
    out = merged.join(sizes, "field_name").where((zero("n_hits") > 0) | (zero("n_headings") > 0) | admitted).join(base, _CLAUSE)
    order = Window.partitionBy("document_id", "field_name").orderBy(F.desc("score"), "page_start", "page_end", "clause_id")
    matched = F.coalesce("matched", F.array().cast("array<string>"))
    return (
        out.select(*key, "page_start", "page_end", total.alias("score"), F.array_join(methods, "+").alias("methods"), matched.alias("matched"))
        .withColumn("rank", F.row_number().over(order))
    )


def quota(limit: int, stage: int = 0, expanded: int | None = None) -> Column:
    """Candidates that a field may keep at a stage below 4; critical fields have four at least."""
    of = lambda n: F.when(F.col("field_name").isin(*dims.CRITICAL), max(n, 4)).otherwise(n)
    return of(expanded) if stage >= 1 and expanded is not None else of(limit) * (2 if stage >= 1 else 1)


def select_quota(ranked: DataFrame, limit: int = 2, stage: int = 0, expanded: int | None = None) -> DataFrame:
    """The best candidates of each field within its quota."""
    return ranked.where(F.col("rank") <= quota(limit, stage, expanded))


def _pages(df: DataFrame, *columns: str, wider: int = 0) -> DataFrame:
    return df.select(*columns, F.explode(F.sequence(F.col("page_start") - wider, F.col("page_end") + wider)).alias("page"))


def neighbours(selected: DataFrame, prepared: DataFrame) -> DataFrame:
    """(document_id, field_name, clause_id) of clauses on the pages of selected ones or next to them."""
    pages = _pages(selected, "document_id", "field_name", wider=1).distinct()
    return pages.join(_pages(prepared, *_CLAUSE), ["document_id", "page"]).select("document_id", "field_name", "clause_id").distinct()


def sections(prepared: DataFrame, running: DataFrame) -> DataFrame:
    """(document_id, clause_id, section, page_start, page_end): running number of the major, not repeated titles."""
    marked = prepared.join(running.withColumn("running", F.lit(True)), ["document_id", "norm_title"], "left")
    major = F.col("major") & F.col("running").isNull()
    order = Window.partitionBy("document_id").orderBy("page_start", "clause_id").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select(*_CLAUSE, "page_start", "page_end", F.sum(major.cast("int")).over(order).alias("section"))


def section_sizes(sections_: DataFrame) -> DataFrame:
    """(document_id, section, n_pages)."""
    return _pages(sections_, "document_id", "section").groupBy("document_id", "section").agg(F.countDistinct("page").alias("n_pages"))


def section_expansion(selected: DataFrame, sections_: DataFrame, max_pages: int = SECTION_PAGES) -> DataFrame:
    """(document_id, field_name, clause_id, overflow): all clauses in sections of selected ones; those of too many pages overflow instead."""
    sized = sections_.select(*_CLAUSE, "section").join(section_sizes(sections_), ["document_id", "section"])
    chosen = selected.select("document_id", "field_name", "clause_id").join(sized, _CLAUSE).select("document_id", "field_name", "section").distinct()
    return chosen.join(sized, ["document_id", "section"]).select("document_id", "field_name", "clause_id", (F.col("n_pages") > max_pages).alias("overflow")).distinct()


def select_stage(prepared: DataFrame, pages: DataFrame, ranked: DataFrame, stage: int, limit: int = 2, expanded: int | None = None) -> DataFrame:
    """(document_id, field_name, clause_id, page_start, page_end, score, methods, overflow) of every field at a stage.

    ``ranked`` is the ranking with further phrases at stage 4, else the plain one.  ``overflow`` tells that a section of
    the field was too long to be taken.
    """
    key = ["document_id", "field_name", "clause_id"]
    seeds = ranked if stage >= 4 else select_quota(ranked, limit, stage, expanded)
    none = F.array().cast("array<string>")
    parts = [seeds.select(*key, "score", F.split("methods", r"\+").alias("methods"))]
    tagged = lambda df, method: df.select(*key, F.lit(0.0).alias("score"), F.array(F.lit(method)).alias("methods"))
    parts.append(tagged(prepared.where("page_start <= 1 AND page_end >= 1").withColumn("field_name", F.lit(COVER_FIELD)), "document_cover"))
    over = None
    if stage in (2, 3):
        parts.append(tagged(neighbours(seeds, prepared), "page_neighbor"))
    if stage == 3:
        whole = section_expansion(seeds, sections(prepared, repeated_titles(prepared, pages)))
        parts.append(tagged(whole.where("NOT overflow"), "section"))
        over = whole.where("overflow").select("document_id", "field_name").distinct().withColumn("overflow", F.lit(True))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = union.groupBy(*key).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("methods", none))))), "+").alias("methods"))
    out = merged.join(prepared.select(*_CLAUSE, "page_start", "page_end"), _CLAUSE)
    out = out.join(over, ["document_id", "field_name"], "left") if over is not None else out.withColumn("overflow", F.lit(False))
    return out.select(*key, "page_start", "page_end", "score", "methods", F.coalesce("overflow", F.lit(False)).alias("overflow"))


def expand(previous: DataFrame, new: DataFrame) -> DataFrame:
    """A later selection that keeps all of an earlier one: rows of both, those of ``new`` first."""
    key = ["document_id", "field_name", "clause_id"]
    return new.unionByName(previous.join(new.select(*key), key, "left_anti"))


def merge_groups(selected: DataFrame) -> DataFrame:
    """Per group and clause: best score, and the fields it serves in the group's order, with the methods that found it."""
    dim = F.broadcast(dims.groups(selected.sparkSession))
    ordered = F.array_sort(F.collect_set(F.struct("field_order", "field_name")))
    methods = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("methods", r"\+")))))
    return (
        selected.join(dim, "field_name")
        .groupBy("document_id", "group_id", "clause_id", "page_start", "page_end")
        .agg(F.max("score").alias("score"), F.array_join(F.transform(ordered, lambda x: x["field_name"]), "+").alias("fields"), F.array_join(methods, "+").alias("methods"))
    )


def cap_round_robin(selected: DataFrame, cap: int) -> DataFrame:
    """(document_id, group_id, clause_id, place, kept): clauses of each document and group, taken field by field, rank by rank; the first ``cap`` are kept."""
    dim = F.broadcast(dims.groups(selected.sparkSession))
    first = selected.join(dim, "field_name").groupBy("document_id", "group_id", "clause_id").agg(F.min(F.struct("rank", "field_order")).alias("turn"))
    order = Window.partitionBy("document_id", "group_id").orderBy("turn.rank", "turn.field_order", "clause_id")
    return first.withColumn("place", F.row_number().over(order)).select("document_id", "group_id", "clause_id", "place", (F.col("place") <= cap).alias("kept"))


def group_plan(selected: DataFrame) -> DataFrame:
    """The clauses of each document and group in reading order."""
    order = Window.partitionBy("document_id", "group_id").orderBy("page_start", "page_end", "clause_id")
    return merge_groups(selected).withColumn("place", F.row_number().over(order))


def routed_seeds(ranked: DataFrame, ranked_further: DataFrame) -> DataFrame:
    """(document_id, field_name, clause_id): the plain quota of each field and the first two of the ranking with further phrases."""
    key = ["document_id", "field_name", "clause_id"]
    first = F.when(F.col("field_name").isin(*dims.CRITICAL, "cancelamento_renovacao"), 4).otherwise(2)
    return ranked.where(F.col("rank") <= first).select(*key).union(ranked_further.where("rank <= 2").select(*key)).distinct()


def continuations(seeds: DataFrame, prepared: DataFrame) -> DataFrame:
    """(document_id, field_name, clause_id) of seeds and of the next two clauses of each where the page goes on."""
    order = Window.partitionBy("document_id").orderBy("page_start", "clause_id")
    at = prepared.select(*_CLAUSE, "page_start", "page_end", F.row_number().over(order).alias("pos"))
    after = seeds.join(at, _CLAUSE).select("document_id", "field_name", F.col("page_end").alias("end"), F.explode(F.array(F.col("pos") + 1, F.col("pos") + 2)).alias("pos"))
    next_ = after.join(at, ["document_id", "pos"]).where("page_start <= end + 1").select("document_id", "field_name", "clause_id")
    return seeds.unionByName(next_).distinct()


def orphans(pages: DataFrame, chunks: DataFrame, ranked_further: DataFrame) -> DataFrame:
    """(document_id, field_name, page_number) of pages with a phrase of the field that no ranked clause holds on that page.

    ``pages`` and ``chunks`` are reduced to their phrases before any shuffle.
    """
    dim = F.broadcast(dims.aliases(pages.sparkSession, True).select("alias", "field_name"))
    held = F.explode(held_phrases(normalised(F.coalesce("text", F.lit(""))))).alias("alias")
    on_page = pages.select("document_id", "page_number", held).distinct().join(dim, "alias")
    in_clause = chunks.select(*_CLAUSE, "page_number", held).distinct().join(dim, "alias").join(ranked_further.select(*_CLAUSE, "field_name"), [*_CLAUSE, "field_name"], "left_semi")
    return on_page.join(in_clause, ["document_id", "page_number", "field_name", "alias"], "left_anti").select("document_id", "field_name", "page_number").distinct()


def diagnostics(selected: DataFrame, ranked: DataFrame, pages: DataFrame, stage: int, lost: DataFrame | None = None) -> DataFrame:
    """Per document and field: counts, pages, methods, whether candidates were left out, why nothing was found, and the status.

    ``lost`` are the orphans of stage 4; only there a field without candidates counts as searched in full.
    """
    key = ["document_id", "field_name"]
    spans = _pages(selected, *key).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages"))
    methods = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("methods", r"\+"))))), "+")
    chosen = selected.groupBy(*key).agg(F.count("*").alias("n_selected"), methods.alias("methods"), F.max("overflow").alias("overflow"))
    left_out = ranked.select(*key, "clause_id").join(selected.select(*key, "clause_id"), [*key, "clause_id"], "left_anti").groupBy(*key).agg(F.count("*").alias("n_left"))
    texts = pages.groupBy("document_id").agg(F.max(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("has_text"))
    each = texts.withColumn("field_name", F.explode(F.array(*map(F.lit, dims.ALIASES))))
    out = each.join(chosen, key, "left").join(spans, key, "left").join(left_out, key, "left")
    out = out.join(lost.select(*key).distinct().withColumn("lost", F.lit(True)), key, "left") if lost is not None else out.withColumn("lost", F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    full = F.lit(stage >= 4) & F.col("has_text") & ~flag("lost")
    some = zero("n_selected") > 0
    reason = F.when(~some, F.when(~F.col("has_text"), "empty_extracted_text").when(flag("lost"), "source_matches_outside_supplied_chunks").when(full, "no_lexical_evidence_after_full_field_scan").otherwise("field_strategy_not_exhausted"))
    return out.select(
        *key, (zero("n_selected") + zero("n_left")).alias("n_candidates"), zero("n_selected").alias("n_selected"), F.coalesce("pages", F.lit("")).alias("pages"),
        F.coalesce("methods", F.lit("")).alias("methods"), ((zero("n_left") > 0) | flag("lost") | flag("overflow")).alias("limited"), flag("overflow").alias("overflow"), full.alias("full_search"), reason.alias("reason"),
        F.when(some, "CANDIDATES").when(full, "NOT_FOUND").otherwise("NOT_RETRIEVED").alias("status"),
    )


def anchor_hits(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(anchor_id, document_id, field_name, clause_id): clauses that hold an anchor's quotation literally on its page, white space aside."""
    spaced = lambda c: F.trim(F.regexp_replace(c, r"[ \n\t]+", " "))
    quotes = anchors.select("anchor_id", "document_id", "field_name", "page_number", spaced("quote").alias("q")).where("q <> ''").distinct()
    texts = chunks.join(quotes.select("document_id", "page_number").distinct(), ["document_id", "page_number"], "left_semi").select(*_CLAUSE, "page_number", spaced("text").alias("t"))
    return quotes.join(texts, ["document_id", "page_number"]).where(F.contains("t", "q")).select("anchor_id", "document_id", "field_name", "clause_id").distinct()


def anchor_recall(anchors: DataFrame, hits: DataFrame, selected: DataFrame) -> DataFrame:
    """(anchor_id, document_id, field_name, hit, reason) of every anchor against a selection."""
    found = hits.join(selected.select("document_id", "field_name", "clause_id"), ["document_id", "field_name", "clause_id"], "left_semi").select("anchor_id").distinct().withColumn("found", F.lit(True))
    held = hits.select("anchor_id").distinct().withColumn("held", F.lit(True))
    base = anchors.select("anchor_id", "document_id", "field_name").distinct().join(found, "anchor_id", "left").join(held, "anchor_id", "left")
    reason = F.when(F.col("found"), F.lit(None).cast("string")).when(F.col("held"), "clause_not_selected").otherwise("quotation_in_no_clause")
    return base.select("anchor_id", "document_id", "field_name", F.coalesce("found", F.lit(False)).alias("hit"), reason.alias("reason"))
