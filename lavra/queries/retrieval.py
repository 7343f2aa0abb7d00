"""Retrieval and vector queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lavra.functions import dims
from lavra.operators import retrieval as R, stages as S, vectors as V
from lavra.sources.tables import table


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prepare(table(spark, sf_dir, "clauses"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_text").select("document_id", "page_number")


def _ranked(spark: SparkSession, sf_dir: str, fallback: bool = False, prepared: DataFrame | None = None) -> DataFrame:
    return R.rank_fields(prepared or _prepared(spark, sf_dir), _numbers(spark, sf_dir), fallback)


def _stage(spark: SparkSession, sf_dir: str, stage: int, prepared: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    prepared = prepared or _prepared(spark, sf_dir)
    return R.select_stage(prepared, _numbers(spark, sf_dir), ranked or _ranked(spark, sf_dir, stage >= 4, prepared), stage)


def _all_stages(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Selections of stages 0 to 4, each keeping all of the one before."""
    prepared = _prepared(spark, sf_dir)
    plain, further = (R.cut(_ranked(spark, sf_dir, f, prepared)) for f in (False, True))
    out: list[DataFrame] = []
    for stage in range(5):
        new = _stage(spark, sf_dir, stage, prepared, further if stage == 4 else plain)
        out.append(R.cut(R.expand(out[-1], new) if out else new))
    return out


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "evidence_chunks").select("document_id", "clause_id", "page_number", "text")


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located evidence as anchors of its document: the field, the page and the quotation that retrieval should reach."""
    found = table(spark, sf_dir, "field_evidence").where("status = 'FOUND' AND pagina IS NOT NULL AND trecho_origem IS NOT NULL")
    return found.select(F.col("evidence_id").alias("anchor_id"), "document_id", "field_name", F.col("pagina").alias("page_number"), F.col("trecho_origem").alias("quote"))


def r01_corpus_statistics(spark, sf_dir):
    """Clauses per document and mean length in words."""
    return R.corpus_statistics(_prepared(spark, sf_dir)).select("document_id", "n_clauses", F.round("mean_length", 6).alias("mean_length"))


def r01_document_frequency(spark, sf_dir):
    """In how many clauses of its document each term stands."""
    return R.document_frequency(table(spark, sf_dir, "clauses"))


def r02_query_terms(spark, sf_dir):
    """Query terms of each field, plain and with the further phrases of the last stage."""
    return dims.terms(spark).withColumn("fallback", F.lit(False)).unionByName(dims.terms(spark, True).withColumn("fallback", F.lit(True)))


def r03_bm25_score(spark, sf_dir):
    """BM25 of every clause for every field whose terms it holds."""
    return R.bm25(_prepared(spark, sf_dir)).select("document_id", "clause_id", "field_name", "overlap", F.round("bm25", 6).alias("bm25"))


def r04_phrase_hits(spark, sf_dir):
    """Phrases of each field in text and title."""
    return R.phrase_hits(_prepared(spark, sf_dir)).select("document_id", "clause_id", "field_name", "n_hits", "n_headings", F.array_join("matched", "+").alias("matched"))


def d10_repeated_titles(spark, sf_dir):
    """Running titles."""
    return R.repeated_titles(_prepared(spark, sf_dir), _numbers(spark, sf_dir))


def d09_major_sections(spark, sf_dir):
    """Running number of major headings that are no running title."""
    prepared = _prepared(spark, sf_dir)
    return R.sections(prepared, R.repeated_titles(prepared, _numbers(spark, sf_dir))).select("document_id", "clause_id", "section")


def r08_field_ranking(spark, sf_dir):
    """Admitted candidates with composite score, methods and rank per field (R05 to R08)."""
    return _ranked(spark, sf_dir).drop("matched")


def r08_further_ranking(spark, sf_dir):
    """The ranking of the last stage, with further phrases."""
    return _ranked(spark, sf_dir, True).drop("matched")


def r09_quota(spark, sf_dir):
    """The candidates within each field's quota."""
    return R.select_quota(_ranked(spark, sf_dir)).select("document_id", "field_name", "clause_id", "rank")


def r10_cover_page(spark, sf_dir):
    """Selection of stage 0 for the field that the cover page serves."""
    return _stage(spark, sf_dir, 0).where(F.col("field_name") == R.COVER_FIELD).select("document_id", "clause_id", "score", "methods")


def r11_neighbours(spark, sf_dir):
    """Clauses on or next to the pages of selected ones."""
    prepared = _prepared(spark, sf_dir)
    return R.neighbours(R.select_quota(_ranked(spark, sf_dir, False, prepared)), prepared)


def r12_section_expansion(spark, sf_dir):
    """Clauses of the selected ones' sections, and whether a section spans too many pages to be taken."""
    prepared = _prepared(spark, sf_dir)
    sections = R.sections(prepared, R.repeated_titles(prepared, _numbers(spark, sf_dir)))
    return R.section_expansion(R.select_quota(_ranked(spark, sf_dir, False, prepared)), sections)


def r13_orphans(spark, sf_dir):
    """Pages with a phrase of a field that no ranked clause holds there."""
    return R.orphans(table(spark, sf_dir, "page_text").select("document_id", "page_number", "text"), _chunks(spark, sf_dir), _ranked(spark, sf_dir, True))


def _diagnosed(spark, sf_dir, stage):
    prepared = _prepared(spark, sf_dir)
    ranked = R.cut(_ranked(spark, sf_dir, stage >= 4, prepared))
    pages = table(spark, sf_dir, "page_text").select("document_id", "page_number", "text")
    lost = R.orphans(pages, _chunks(spark, sf_dir), ranked) if stage >= 4 else None
    return R.diagnostics(_stage(spark, sf_dir, stage, prepared, ranked), ranked, pages, stage, lost)


def r14_diagnostics(spark, sf_dir):
    """Per field of a document at stage 3: candidates, selected ones, their pages and methods, limits and the field's status."""
    return _diagnosed(spark, sf_dir, 3)


def r15_field_status(spark, sf_dir):
    """The same at stage 4, where a field without candidates counts as searched in full unless its phrases stand elsewhere."""
    return _diagnosed(spark, sf_dir, 4)


def r16_group_merge(spark, sf_dir):
    """Selected clauses merged over the fields of each group."""
    return R.merge_groups(R.select_quota(_ranked(spark, sf_dir)))


def r17_round_robin_cap(spark, sf_dir):
    """Clauses of a group taken in turn from its fields, and whether they are among the first three."""
    return R.cap_round_robin(R.select_quota(_ranked(spark, sf_dir)), 3)


def r18_final_order(spark, sf_dir):
    """The clauses of each group's plan of stage 0 in reading order."""
    return R.group_plan(_stage(spark, sf_dir, 0)).select("document_id", "group_id", "clause_id", "place")


def r19_plan(spark, sf_dir):
    """The plan of every group at stage 3."""
    return R.group_plan(_stage(spark, sf_dir, 3))


def r20_expand(spark, sf_dir):
    """The selection of stage 2 that keeps all of stage 0."""
    prepared = _prepared(spark, sf_dir)
    ranked = R.cut(_ranked(spark, sf_dir, False, prepared))
    first, second = (_stage(spark, sf_dir, n, prepared, ranked) for n in (0, 2))
    return R.expand(first, second).select("document_id", "field_name", "clause_id", "score", "methods")


def r21_routed_plan(spark, sf_dir):
    """Seeds of both rankings with the clauses that continue them, and the cover page."""
    prepared = _prepared(spark, sf_dir)
    seeds = R.routed_seeds(_ranked(spark, sf_dir, False, prepared), _ranked(spark, sf_dir, True, prepared))
    cover = prepared.where("page_start <= 1 AND page_end >= 1").select("document_id", F.lit(R.COVER_FIELD).alias("field_name"), "clause_id")
    return R.continuations(seeds.unionByName(cover).distinct(), prepared)


def r22_anchor_recall(spark, sf_dir):
    """Anchors whose quotation stands on their page in a clause selected for their field at stage 0, and why others are missed."""
    anchors = _anchors(spark, sf_dir)
    return R.anchor_recall(anchors, R.anchor_hits(anchors, _chunks(spark, sf_dir)), _stage(spark, sf_dir, 0))


def _first_stage(spark, sf_dir):
    anchors = _anchors(spark, sf_dir)
    hits, key = R.cut(R.anchor_hits(anchors, _chunks(spark, sf_dir))), ["document_id", "field_name", "clause_id"]
    first = S.first_stages(table(spark, sf_dir, "clauses"), _numbers(spark, sf_dir), hits.select(*key))
    found = hits.join(first, key).groupBy("anchor_id").agg(F.min("stage").alias("stage"))
    return anchors.select("anchor_id", "document_id", "field_name").distinct().join(found, "anchor_id", "left").fillna(-1, ["stage"])


def r24_progressive_stages(spark, sf_dir):
    """The stage at which each anchor is first reached when only fields not yet reached go on; -1 where none does."""
    return _first_stage(spark, sf_dir)


def r25_new_associations(spark, sf_dir):
    """Fields and clauses that each stage adds to the one before."""
    return S.first_stages(table(spark, sf_dir, "clauses"), _numbers(spark, sf_dir)).where("stage > 0")


def r26_stage_curve(spark, sf_dir):
    """Per stage: anchors reached in all and for critical fields, clauses selected, and batches of eight of them by document."""
    first, stages = R.cut(_first_stage(spark, sf_dir)), _all_stages(spark, sf_dir)
    critical, rows = F.col("field_name").isin(*dims.CRITICAL), None
    for k, selected in enumerate(stages):
        hit = F.col("stage").between(0, k)
        recall = first.agg(F.count("*").alias("n_anchors"), F.count_if(hit).alias("n_hits"), F.count_if(critical).alias("n_critical"), F.count_if(hit & critical).alias("n_critical_hits"))
        sizes = selected.select("document_id", "clause_id").distinct().groupBy("document_id").count().agg(F.sum("count").alias("n_clauses"), F.sum(F.ceil(F.col("count") / 8)).alias("n_batches"))
        row = recall.crossJoin(sizes).withColumn("stage", F.lit(k))  # one row beside one row
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("recall", F.round(F.try_divide("n_hits", "n_anchors"), 6))


_NORM = "array_to_string(regexp_extract_all(replace(strip_accents(lower(replace({0}, 'ß', 'ss'))), 'ß', 'ss'), '[a-z0-9]+'), ' ')"


def _ranking(n: int) -> str:
    """Common tables of one ranking: plain (0) or with further phrases (4)."""
    return f"""
{dims.values_sql(dims.term_rows(n == 4), f'terms{n}', 'field_name, term, n_terms')},
{dims.values_sql(dims.alias_rows(n == 4), f'aliases{n}', 'field_name, alias, alias_order')},
bm{n} AS (SELECT o.document_id, o.clause_id, t.field_name, count(*) AS overlap,
  sum(ln(1 + (n_clauses - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS bm25
  FROM post o JOIN terms{n} t USING (term) JOIN df USING (document_id, term) JOIN stats USING (document_id) JOIN len USING (document_id, clause_id) GROUP BY ALL),
ph{n} AS (SELECT document_id, clause_id, field_name, sum((contains(' ' || norm_text || ' ', ' ' || alias || ' '))::INT) AS n_hits,
  sum((contains(' ' || norm_title || ' ', ' ' || alias || ' '))::INT) AS n_headings, string_agg(alias, '+' ORDER BY alias) AS matched FROM p, aliases{n}
  WHERE contains(' ' || norm_text || ' ', ' ' || alias || ' ') OR contains(' ' || norm_title || ' ', ' ' || alias || ' ') GROUP BY ALL),
joined{n} AS (SELECT document_id, clause_id, field_name, coalesce(n_hits, 0) AS n_hits, coalesce(n_headings, 0) AS n_headings, coalesce(bm25, 0) AS bm25,
  coalesce(overlap, 0) >= least(2, n_terms) AND coalesce(bm25, 0) > 0 AS admitted FROM bm{n} FULL JOIN ph{n} USING (document_id, clause_id, field_name) JOIN (SELECT DISTINCT field_name, n_terms FROM terms{n}) USING (field_name)),
scored{n} AS (SELECT j.*, p.page_start, p.page_end, rep.norm_title IS NOT NULL AS running,
  round((bm25 + 4 * n_hits + 8 * n_headings) * (CASE WHEN rep.norm_title IS NOT NULL THEN 0.2::DOUBLE ELSE 1 END) * (CASE WHEN regexp_matches(coalesce(text, ''), '\\.{{3,}}\\s*\\d+') THEN 0.25::DOUBLE ELSE 1 END)
  + 0.01::DOUBLE / (1 + p.page_start), 8) AS score
  FROM joined{n} j JOIN p USING (document_id, clause_id) LEFT JOIN rep ON rep.document_id = p.document_id AND rep.norm_title = p.norm_title
  WHERE n_hits > 0 OR n_headings > 0 OR admitted),
ranked{n} AS (SELECT document_id, clause_id, field_name, page_start, page_end, score,
  concat_ws('+', CASE WHEN n_headings > 0 AND NOT running THEN 'heading' END, CASE WHEN n_hits > 0 THEN 'keyword' END, CASE WHEN admitted THEN 'bm25' END{", 'fallback'" if n == 4 else ''}) AS methods,
  row_number() OVER (PARTITION BY document_id, field_name ORDER BY score DESC, page_start, page_end, clause_id)::INT AS rank FROM scored{n})"""


_CRITICAL = f"({', '.join(repr(x) for x in dims.CRITICAL)})"
_BASE = f"""
c AS (SELECT DISTINCT document_id, clause_id, title, category, page_start, page_end, text FROM clauses),
p AS (SELECT document_id, clause_id, title, page_start, page_end, text, {_NORM.format("coalesce(text, '')")} AS norm_text, {_NORM.format("coalesce(title, '')")} AS norm_title FROM c),
len AS (SELECT document_id, clause_id, CASE WHEN norm_text = '' THEN 0 ELSE len(string_split(norm_text, ' ')) END AS length FROM p),
stats AS (SELECT document_id, count(*) AS n_clauses, CASE WHEN avg(length) = 0 THEN 1.0 ELSE avg(length) END AS mean_length FROM len GROUP BY 1),
post AS (SELECT document_id, clause_id, term, count(*) AS tf FROM (SELECT document_id, clause_id, unnest(string_split(norm_text, ' ')) AS term FROM p WHERE norm_text <> '') GROUP BY ALL),
df AS (SELECT document_id, term, count(*) AS df FROM post GROUP BY ALL),
{dims.values_sql(dims.group_rows(dims.GROUPS), 'grp', 'group_id, field_name, field_order')},
np AS (SELECT document_id, count(DISTINCT page_number) AS n_pages FROM page_text GROUP BY 1),
rep AS (SELECT document_id, norm_title FROM (SELECT document_id, norm_title, count(*) AS n FROM p GROUP BY ALL) LEFT JOIN np USING (document_id)
  WHERE n >= greatest(3, coalesce(n_pages, 0) // 2)),
letters AS (SELECT *, regexp_replace(coalesce(title, ''), '[^\\p{{L}}]', '', 'g') AS l FROM p),
sec AS (SELECT document_id, clause_id, page_start, page_end, sum(CASE WHEN r.norm_title IS NULL AND (regexp_matches(trim(coalesce(title, '')), '^[0-9]{{1,2}}[.)]?\\s+[^0-9]') OR (length(l) >= 8 AND l = upper(l))) THEN 1 ELSE 0 END)
  OVER (PARTITION BY document_id ORDER BY page_start, clause_id ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM letters LEFT JOIN rep r USING (document_id, norm_title)),
secsize AS (SELECT document_id, section, count(DISTINCT page) AS n_pages FROM (SELECT document_id, section, unnest(range(page_start, page_end + 1)) AS page FROM sec) GROUP BY ALL),
{_ranking(0)},
{_ranking(4)},
sel AS (SELECT * FROM ranked0 WHERE rank <= CASE WHEN field_name IN {_CRITICAL} THEN 4 ELSE 2 END)"""


def _stage_sql(n: int) -> str:
    """Common tables of the selection of one stage, ``st<n>``."""
    times = 2 if n else 1
    seeds = "ranked4" if n == 4 else f"(SELECT * FROM ranked0 WHERE rank <= CASE WHEN field_name IN {_CRITICAL} THEN {4 * times} ELSE {2 * times} END)"
    parts = [f"SELECT document_id, field_name, clause_id, score, string_split(methods, '+') AS m FROM seeds{n}", f"SELECT document_id, '{R.COVER_FIELD}', clause_id, 0, ['document_cover'] FROM p WHERE page_start <= 1 AND page_end >= 1"]
    over = "SELECT NULL AS document_id, NULL AS field_name WHERE false"
    if n in (2, 3):
        parts.append(f"SELECT DISTINCT s.document_id, s.field_name, q.clause_id, 0, ['page_neighbor'] FROM seeds{n} s JOIN p q ON q.document_id = s.document_id AND q.page_start <= s.page_end + 1 AND q.page_end >= s.page_start - 1")
    if n == 3:
        chosen = "SELECT DISTINCT s.document_id, s.field_name, k.section, z.n_pages FROM seeds3 s JOIN sec k USING (document_id, clause_id) JOIN secsize z ON z.document_id = k.document_id AND z.section = k.section"
        parts.append(f"SELECT DISTINCT x.document_id, x.field_name, k.clause_id, 0, ['section'] FROM ({chosen}) x JOIN sec k ON k.document_id = x.document_id AND k.section = x.section WHERE x.n_pages <= {R.SECTION_PAGES}")
        over = f"SELECT DISTINCT document_id, field_name FROM ({chosen}) WHERE n_pages > {R.SECTION_PAGES}"
    return f"""seeds{n} AS (SELECT * FROM {seeds}),
over{n} AS ({over}),
st{n} AS (SELECT u.document_id, u.field_name, u.clause_id, any_value(p.page_start) AS page_start, any_value(p.page_end) AS page_end, max(score) AS score, array_to_string(list_sort(list_distinct(flatten(list(m)))), '+') AS methods
  FROM ({' UNION ALL '.join(parts)}) u(document_id, field_name, clause_id, score, m) JOIN p ON p.document_id = u.document_id AND p.clause_id = u.clause_id GROUP BY u.document_id, u.field_name, u.clause_id)"""


def _all_sql() -> str:
    """Selections of all stages, each keeping the one before: ``all<n>``."""
    out = [_stage_sql(n) for n in range(5)]
    out.append("all0 AS (SELECT document_id, field_name, clause_id, score, methods FROM st0)")
    out += [f"all{n} AS (SELECT document_id, field_name, clause_id, score, methods FROM st{n} UNION ALL SELECT * FROM all{n - 1} o WHERE NOT EXISTS (SELECT 1 FROM st{n} s WHERE s.document_id = o.document_id AND s.field_name = o.field_name AND s.clause_id = o.clause_id))" for n in range(1, 5)]
    return ", ".join(out)


def _merged(of: str) -> str:
    return f"SELECT document_id, group_id, clause_id, page_start, page_end, max(score) AS score, string_agg(DISTINCT field_name, '+' ORDER BY field_order) AS fields, array_to_string(list_sort(list_distinct(flatten(list(string_split(methods, '+'))))), '+') AS methods FROM {of} JOIN grp USING (field_name) GROUP BY document_id, group_id, clause_id, page_start, page_end".replace("string_agg(DISTINCT field_name, '+' ORDER BY field_order)", "array_to_string(list_transform(list_sort(list({'o': field_order, 'f': field_name})), lambda x: x.f), '+')")


_ORPHANS = f"""pg AS (SELECT DISTINCT document_id, page_number, ' ' || {_NORM.format("coalesce(text, '')")} || ' ' AS n FROM page_text),
ck AS (SELECT DISTINCT document_id, clause_id, page_number, ' ' || {_NORM.format("coalesce(text, '')")} || ' ' AS n FROM evidence_chunks),
inck AS (SELECT DISTINCT k.document_id, k.page_number, a.field_name, a.alias FROM ck k JOIN aliases4 a ON contains(k.n, ' ' || a.alias || ' ') JOIN ranked4 r ON r.document_id = k.document_id AND r.clause_id = k.clause_id AND r.field_name = a.field_name),
orphan AS (SELECT DISTINCT g.document_id, a.field_name, g.page_number FROM pg g JOIN aliases4 a ON contains(g.n, ' ' || a.alias || ' ') WHERE NOT EXISTS (SELECT 1 FROM inck i WHERE i.document_id = g.document_id AND i.page_number = g.page_number AND i.field_name = a.field_name AND i.alias = a.alias))"""


def _diagnosed_sql(n: int) -> str:
    ranked = "ranked4" if n == 4 else "ranked0"
    lost = "SELECT DISTINCT document_id, field_name FROM orphan" if n == 4 else "SELECT NULL AS document_id, NULL AS field_name WHERE false"
    return f"""WITH {_BASE}, {_stage_sql(n)}, {_ORPHANS}, lost AS ({lost}), docs AS (SELECT document_id, max(CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 1 ELSE 0 END) = 1 AS has_text FROM page_text GROUP BY 1), f AS (SELECT DISTINCT field_name FROM terms0),
    ch AS (SELECT document_id, field_name, count(*) AS k, array_to_string(list_sort(list_distinct(flatten(list(string_split(methods, '+'))))), '+') AS methods, array_to_string(list_sort(list_distinct(flatten(list(range(page_start, page_end + 1))))), ',') AS pages FROM st{n} GROUP BY ALL),
    lo AS (SELECT document_id, field_name, count(*) AS k FROM {ranked} r WHERE NOT EXISTS (SELECT 1 FROM st{n} s WHERE s.document_id = r.document_id AND s.field_name = r.field_name AND s.clause_id = r.clause_id) GROUP BY ALL),
    x AS (SELECT d.document_id, f.field_name, d.has_text, coalesce(ch.k, 0) AS n_selected, coalesce(lo.k, 0) AS n_left, coalesce(ch.pages, '') AS pages, coalesce(ch.methods, '') AS methods, l.field_name IS NOT NULL AS lost, o.field_name IS NOT NULL AND ch.k IS NOT NULL AS overflow
      FROM docs d CROSS JOIN f LEFT JOIN ch ON ch.document_id = d.document_id AND ch.field_name = f.field_name LEFT JOIN lo ON lo.document_id = d.document_id AND lo.field_name = f.field_name
      LEFT JOIN lost l ON l.document_id = d.document_id AND l.field_name = f.field_name LEFT JOIN over{n} o ON o.document_id = d.document_id AND o.field_name = f.field_name),
    y AS (SELECT *, {'has_text AND NOT lost' if n == 4 else 'false'} AS full_search FROM x)
    SELECT document_id, field_name, n_selected + n_left AS n_candidates, n_selected, pages, methods, n_left > 0 OR lost OR overflow AS limited, overflow, full_search,
      CASE WHEN n_selected = 0 THEN CASE WHEN NOT has_text THEN 'empty_extracted_text' WHEN lost THEN 'source_matches_outside_supplied_chunks' WHEN full_search THEN 'no_lexical_evidence_after_full_field_scan' ELSE 'field_strategy_not_exhausted' END END AS reason,
      CASE WHEN n_selected > 0 THEN 'CANDIDATES' WHEN full_search THEN 'NOT_FOUND' ELSE 'NOT_RETRIEVED' END AS status FROM y"""


_SPACED = "trim(regexp_replace({0}, '[ \\n\\t]+', ' ', 'g'))"
_HITS = f"""an AS (SELECT DISTINCT evidence_id AS anchor_id, document_id, field_name, pagina AS page_number, {_SPACED.format('trecho_origem')} AS q FROM field_evidence WHERE status = 'FOUND' AND pagina IS NOT NULL AND trecho_origem IS NOT NULL),
hits AS (SELECT DISTINCT a.anchor_id, a.document_id, a.field_name, k.clause_id FROM an a JOIN evidence_chunks k ON k.document_id = a.document_id AND k.page_number = a.page_number AND contains({_SPACED.format('k.text')}, a.q) WHERE a.q <> '')"""
_AT = " UNION ALL ".join(f"SELECT h.anchor_id, {n} AS stage FROM hits h JOIN all{n} s ON s.document_id = h.document_id AND s.field_name = h.field_name AND s.clause_id = h.clause_id" for n in range(5))
_FIRST = f"firsts AS (SELECT a.anchor_id, a.document_id, a.field_name, coalesce(min(t.stage), -1)::INT AS stage FROM an a LEFT JOIN ({_AT}) t USING (anchor_id) GROUP BY ALL)"


def _sql(select: str, *more: str) -> str:
    return f"WITH {', '.join([_BASE, *more])} {select}"


_RANKED = "SELECT document_id, clause_id, field_name, page_start, page_end, score, methods, rank FROM ranked"
_SECTIONS = "SELECT DISTINCT x.document_id, x.field_name, k.clause_id, x.n_pages > 8 AS overflow FROM (SELECT DISTINCT s.document_id, s.field_name, k.section, z.n_pages FROM sel s JOIN sec k USING (document_id, clause_id) JOIN secsize z ON z.document_id = k.document_id AND z.section = k.section) x JOIN sec k ON k.document_id = x.document_id AND k.section = x.section"
_ROUTED = f"""seed AS (SELECT document_id, field_name, clause_id FROM ranked0 WHERE rank <= CASE WHEN field_name IN {_CRITICAL} OR field_name = 'cancelamento_renovacao' THEN 4 ELSE 2 END UNION SELECT document_id, field_name, clause_id FROM ranked4 WHERE rank <= 2
  UNION SELECT document_id, '{R.COVER_FIELD}', clause_id FROM p WHERE page_start <= 1 AND page_end >= 1),
places AS (SELECT document_id, clause_id, page_start, page_end, row_number() OVER (PARTITION BY document_id ORDER BY page_start, clause_id) AS pos FROM p)"""

QUERIES = {
    f.__name__: f
    for f in (
        r01_corpus_statistics, r01_document_frequency, r02_query_terms, r03_bm25_score, r04_phrase_hits, d10_repeated_titles, d09_major_sections, r08_field_ranking, r08_further_ranking, r09_quota, r10_cover_page,
        r11_neighbours, r12_section_expansion, r13_orphans, r14_diagnostics, r15_field_status, r16_group_merge, r17_round_robin_cap, r18_final_order, r19_plan, r20_expand, r21_routed_plan, r22_anchor_recall,
        r24_progressive_stages, r25_new_associations, r26_stage_curve,
    )
}
ORACLES = {
    "r01_corpus_statistics": _sql("SELECT document_id, n_clauses, round(mean_length, 6) AS mean_length FROM stats"),
    "r01_document_frequency": _sql("SELECT document_id, term, df FROM df"),
    "r02_query_terms": _sql("SELECT *, false AS fallback FROM terms0 UNION ALL SELECT *, true FROM terms4"),
    "r03_bm25_score": _sql("SELECT document_id, clause_id, field_name, overlap, round(bm25, 6) AS bm25 FROM bm0"),
    "r04_phrase_hits": _sql("SELECT document_id, clause_id, field_name, n_hits::BIGINT AS n_hits, n_headings::BIGINT AS n_headings, matched FROM ph0"),
    "d10_repeated_titles": _sql("SELECT document_id, norm_title FROM rep"),
    "d09_major_sections": _sql("SELECT document_id, clause_id, section FROM sec"),
    "r08_field_ranking": _sql(_RANKED + "0"),
    "r08_further_ranking": _sql(_RANKED + "4"),
    "r09_quota": _sql("SELECT document_id, field_name, clause_id, rank FROM sel"),
    "r10_cover_page": _sql(f"SELECT document_id, clause_id, score, methods FROM st0 WHERE field_name = '{R.COVER_FIELD}'", _stage_sql(0)),
    "r11_neighbours": _sql("SELECT DISTINCT s.document_id, s.field_name, q.clause_id FROM sel s JOIN p q ON q.document_id = s.document_id AND q.page_start <= s.page_end + 1 AND q.page_end >= s.page_start - 1"),
    "r12_section_expansion": _sql(_SECTIONS),
    "r13_orphans": _sql("SELECT * FROM orphan", _ORPHANS),
    "r14_diagnostics": _diagnosed_sql(3),
    "r15_field_status": _diagnosed_sql(4),
    "r16_group_merge": _sql(_merged("sel")),
    "r17_round_robin_cap": _sql("""SELECT document_id, group_id, clause_id, place, place <= 3 AS kept FROM (SELECT document_id, group_id, clause_id, row_number() OVER (PARTITION BY document_id, group_id ORDER BY turn.r, turn.o, clause_id)::INT AS place
        FROM (SELECT document_id, group_id, clause_id, min({'r': rank, 'o': field_order}) AS turn FROM sel JOIN grp USING (field_name) GROUP BY ALL))"""),
    "r18_final_order": _sql(f"SELECT document_id, group_id, clause_id, row_number() OVER (PARTITION BY document_id, group_id ORDER BY page_start, page_end, clause_id)::INT AS place FROM ({_merged('st0')})", _stage_sql(0)),
    "r19_plan": _sql(f"SELECT *, row_number() OVER (PARTITION BY document_id, group_id ORDER BY page_start, page_end, clause_id)::INT AS place FROM ({_merged('st3')})", _stage_sql(3)),
    "r20_expand": _sql("SELECT document_id, field_name, clause_id, score, methods FROM st2 UNION ALL SELECT document_id, field_name, clause_id, score, methods FROM st0 o WHERE NOT EXISTS (SELECT 1 FROM st2 s WHERE s.document_id = o.document_id AND s.field_name = o.field_name AND s.clause_id = o.clause_id)", _stage_sql(0), _stage_sql(2)),
    "r21_routed_plan": _sql("SELECT * FROM seed UNION SELECT s.document_id, s.field_name, b.clause_id FROM seed s JOIN places a ON a.document_id = s.document_id AND a.clause_id = s.clause_id JOIN places b ON b.document_id = a.document_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 2 AND b.page_start <= a.page_end + 1", _ROUTED),
    "r22_anchor_recall": _sql("""SELECT a.anchor_id, a.document_id, a.field_name, max(CASE WHEN s.clause_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS hit, CASE WHEN max(CASE WHEN s.clause_id IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN NULL WHEN max(h.clause_id) IS NOT NULL THEN 'clause_not_selected' ELSE 'quotation_in_no_clause' END AS reason
        FROM an a LEFT JOIN hits h USING (anchor_id) LEFT JOIN st0 s ON s.document_id = h.document_id AND s.field_name = h.field_name AND s.clause_id = h.clause_id GROUP BY a.anchor_id, a.document_id, a.field_name""", _stage_sql(0), _HITS),
    "r24_progressive_stages": _sql("SELECT * FROM firsts", _all_sql(), _HITS, _FIRST),
    "r25_new_associations": _sql(" UNION ALL ".join(f"(SELECT document_id, field_name, clause_id, {n} AS stage FROM all{n} EXCEPT SELECT document_id, field_name, clause_id, {n} FROM all{n - 1})" for n in range(1, 5)), _all_sql()),
    "r26_stage_curve": _sql("SELECT *, round(n_hits / n_anchors, 6) AS recall FROM (" + " UNION ALL ".join(f"SELECT * FROM (SELECT count(*) AS n_anchors, count(*) FILTER (stage BETWEEN 0 AND {n}) AS n_hits, count(*) FILTER (field_name IN {_CRITICAL}) AS n_critical, count(*) FILTER (stage BETWEEN 0 AND {n} AND field_name IN {_CRITICAL}) AS n_critical_hits FROM firsts), (SELECT sum(k)::BIGINT AS n_clauses, sum(ceil(k / 8))::BIGINT AS n_batches FROM (SELECT count(DISTINCT clause_id) AS k FROM all{n} GROUP BY document_id)), (SELECT {n} AS stage)" for n in range(5)) + ")", _all_sql(), _HITS, _FIRST),
}


def v01_cosine_top_k(spark, sf_dir):
    """Ten nearest vectors of every query vector (ids divisible by 100), against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return V.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def v02_filtered_top_k(spark, sf_dir):
    """Five nearest vectors of the query's own label."""
    vectors = table(spark, sf_dir, "embeddings")
    return V.top_k(vectors, vectors.where("vec_id % 100 = 0"), 5, "label")


QUERIES |= {f.__name__: f for f in (v01_cosine_top_k, v02_filtered_top_k)}
_TOP = """SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, greatest(0, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12)) AS d
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 {0})) WHERE rank <= {1}"""
ORACLES |= {"v01_cosine_top_k": _TOP.format("", 10), "v02_filtered_top_k": _TOP.format("AND q.label = v.label", 5)}
