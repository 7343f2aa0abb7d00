"""Text operators against brute force, exact round trips and hard inputs."""

import random
import unicodedata
from itertools import pairwise

import pytest
from hypothesis import given, settings, strategies as st

from lavra.llm import encoding, leakage, lookalike, names, scan_noise, site_lines, splitting, truncation

LONG = "x" * 300_000


# --- problem 4
@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("ＤＯ-ＬＣＺ", "DO-LCZ"), ("prêmio", "prêmio"), ("do​cu⁠mento­", "documento"), ("a b　c d", "a b c d"), ("especiﬁcação", "especificação"),
        ("allegatiοn", "allegation"), ("Север", "Север"), ("Ξενία", "Ξενία"), ("1º § ½ … “x” – ¬", "1º § ½ … “x” – ¬"), ("👩‍💼", "👩‍💼"), ("", ""), (LONG, LONG),
    ],
)
def test_canonical(text, plain):
    assert lookalike.canonical(text) == unicodedata.normalize("NFC", plain)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeçéο​а ́ﬁＡ º½\n"), max_size=40))
def test_canonical_is_stable_and_found_by_the_class(text):
    once = lookalike.canonical(text)
    assert lookalike.canonical(once) == once and unicodedata.is_normalized("NFC", once)
    import re

    assert once == text or re.search(lookalike.SUSPECT, text)


def test_lookalikes_table(spark):
    rows = [(1, "ａ", 7), (1, "ａ", 7), (2, "a", 7), (3, None, 7), (4, "", 7)]
    df = spark.createDataFrame(rows, "id long, text string, record_kind int")
    assert [(r.record_kind, r.record_id) for r in lookalike.lookalikes(df, "page", "id", "text").collect()] == [("page", 1)]


# --- problem 5
PAGES = "page_id long, document_id string, page_number int, text string, key_a string"
DELIVERIES = "sha256 string, source_name string, n_docs int"
NOTICE = "Este aviso se repete em cada documento da fonte, versão {0}"


def _site(spark, ids):
    rows = [(k, f"d{k}", 1, f"Texto próprio número {'abcdefghijklm'[k]} que ninguém mais escreve aqui\n{NOTICE.format(k).upper() if k % 2 else NOTICE.format(k)}\ncurta", "c") for k in ids]
    pages = spark.createDataFrame([*rows, *rows, (100, "d0", 2, None, "c"), (101, "d0", 3, "", "c")], PAGES)
    return pages, spark.createDataFrame([(f"d{k}", "fonte" if k < 8 else None, 0) for k in ids] * 2, DELIVERIES)


def test_repeated_lines(spark):
    pages, deliveries = _site(spark, range(10))
    lines, sources = site_lines.page_lines(pages), site_lines.document_sources(deliveries)
    found = site_lines.occurrences(lines, sources, site_lines.repeated_keys(*site_lines.delta(lines, sources)))
    assert sorted((r.page_id, r.line_no) for r in found.collect()) == [(k, 2) for k in range(8)]
    clean = site_lines.clean_pages(pages, found).collect()
    assert len(clean) == 8 and all("aviso" not in r.text.lower() and r.text.endswith("curta") for r in clean)


def test_merging_deltas_equals_one_pass(spark):
    pages, deliveries = _site(spark, range(8))
    sources = site_lines.document_sources(deliveries)
    early = sources.where("document_id < 'd3'")
    late = sources.where("document_id >= 'd3'")
    lines = site_lines.page_lines(pages)
    first, second, whole = site_lines.delta(lines, early), site_lines.delta(lines, late), site_lines.delta(lines, sources)
    merged = tuple(site_lines.merge_counts(a, b) for a, b in zip(first, second))
    for a, b in zip(merged, whole):
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert [r.crossed for r in site_lines.crossings(first, merged).collect()] == [1]


def test_site_lines_of_empty_tables(spark):
    lines, sources = site_lines.page_lines(spark.createDataFrame([], PAGES)), site_lines.document_sources(spark.createDataFrame([], DELIVERIES))
    assert site_lines.occurrences(lines, sources, site_lines.repeated_keys(*site_lines.delta(lines, sources))).count() == 0


# --- problem 6
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab c.;,\n1"), min_size=1, max_size=900), st.integers(40, 120), st.integers(0, 30))
def test_pieces_cover_the_text(text, limit, overlap):
    body = text.strip()
    spans = splitting.spans(body, limit, overlap)
    if not body:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(0 < e - s <= limit for s, e in spans)
    for (_, end), (start, after) in pairwise(spans):
        assert end - overlap <= start and after > end and body[end:start].strip() == ""


def test_split_items(spark):
    sentence = "Uma frase inteira que termina aqui. "
    rows = [("a", "  " + sentence * 50 + " ", 1), ("b", " curta ", 1), ("c", None, 1), ("d", "", 1), ("e", LONG, 1), ("f", "y" * 1200 + "   ", 1)]
    df = spark.createDataFrame(rows, "id string, text string, pieces int")
    got = {r.id: r for r in splitting.split_items(df).collect()}
    assert [r.id for r in splitting.oversized(df).orderBy("id").collect()] == ["a", "e"]
    assert got["b"].pieces[0].text == "curta" and got["c"].pieces is None and got["d"].pieces == [] and not got["f"].oversized
    for key, text in (("a", rows[0][1]), ("e", LONG)):
        assert all(text[p.start : p.end] == p.text and len(p.text) <= 1200 for p in got[key].pieces)
    assert all(p.text.endswith(".") for p in got["a"].pieces)


# --- problem 8
def test_ids_equal_the_public_encoder(spark):
    import tiktoken

    with open(encoding.VOCABULARY, "rb") as f:
        own = encoding.BytePairEncoder(f.read())
    theirs = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc déçã ñ\n\t123 .,!?’“🇧🇷👩‍💼बी<|endoftext|>") for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in [*texts, "a" * 5000, "   ", "\n\n x"]:
        ids = own.encode(text)
        assert ids == theirs.encode_ordinary(text) and own.decode(ids) == text
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Olá, mundo", 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.encode_table(spark, df).collect()}
    assert got == {1: [], 2: [], 3: theirs.encode_ordinary("Olá, mundo")}
    back = encoding.decode_ids(encoding.encode_table(spark, df)).collect()
    assert {r.doc_id: r.decoded for r in back} == {1: "", 2: "", 3: "Olá, mundo"}


# --- problem 9
def brute_leaks(text, quotes, run):
    words = leakage.fold_words(text).split()
    out = set()
    for item, quote in quotes:
        q = leakage.fold_words(quote).split()
        n = min(run, len(q))
        runs = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
        if any(tuple(words[k : k + n]) in runs for k in range(len(words) - n + 1)):
            out.add(item)
    return out


def test_search_finds_what_brute_force_finds():
    rng = random.Random(2)
    word = lambda: rng.choice("ana casa é bola um dois três Ação voto".split())
    quotes = [(k, " ".join(word() for _ in range(rng.randrange(1, 9)))) for k in range(40)] + [(40, ""), (41, "?!")]
    table = leakage.WuManber(quotes, run=5)
    for _ in range(200):
        text = ", ".join(word().upper() for _ in range(rng.randrange(0, 60)))
        assert table.search(leakage.fold_words(text)) == brute_leaks(text, quotes, 5)


def test_leaks_table(spark):
    quote = "O parecer emitido contra Grotalhari reconheceu que o bônus diferido pertencia a Nosepten, no galpão"
    docs = [(1, f"antes {quote.upper()} depois", 0), (1, f"antes {quote.upper()} depois", 0), (2, quote[:60], 0), (3, None, 0), (4, "", 0), (5, "o  parecer\nemitido contra GROTALHARI​ reconheceu que o bonus diferido pertencia a", 0), (6, LONG, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, quote, "f", "t"), (8, None, "f", "t")], "item_id long, quote string, field_name string, expected_theme string")
    found = leakage.leaks(df, items)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (5, 7)]
    assert {r.item_id: r.n_docs for r in leakage.leak_report(found, items).collect()} == {7: 2, 8: 0}
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_leaks_in_blocks_of_items(spark):
    quotes = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(9)]
    items = spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string")
    docs = spark.createDataFrame([(k, f"antes {quotes[k]} depois {quotes[(k + 1) % 9]}") for k in range(9)], "doc_id long, text string")
    whole = sorted(map(tuple, leakage.leaks(docs, items).collect()))
    assert len(whole) == 18 and whole == sorted(map(tuple, leakage.leaks(docs, items, block_chars=200).collect()))


# --- problem 2: headers and digits through the method
def test_header_without_policy_number(spark):
    body = "O texto da página {0} segue com palavras que ninguém repete {1}"
    rows = []
    for d in range(6):
        for n in range(1, 4):
            own = f"Seguradora Aurora S.A. - Tomador: {'ABCDEF'[d]}{'aeioua'[d] * 3} Comércio Ltda"
            rows.append((10 * d + n, f"d{d}", n, "\n".join([own, "Este portal oferece o documento a todos", body.format("um dois três".split()[n - 1], "xyzvwq"[d] * n)])))
    found = scan_noise.noise(spark.createDataFrame(rows, "page_id long, document_id string, page_number int, text string"))
    assert sorted((r.page_id, r.line_no) for r in found.where("kind = 'header'").collect()) == sorted((r[0], 1) for r in rows)


def test_digits_and_signs_meet_their_word_in_the_join(spark):
    words = [("seguro", 1), ("segur0", 1), ("pagamento", 3), ("p@gamento", 2), ("14", 5), ("l4", 1), ("10mm", 1), ("zzz0", 1), ("2019", 4), ("20l9", 9)]
    fixes = {r.word: r.correct for r in scan_noise.corrections(spark.createDataFrame(words, "word string, n long")).collect()}
    assert fixes == {"segur0": "seguro", "p@gamento": "pagamento", "l4": "14", "20l9": "2019"}
    judge = scan_noise.Judge(fixes)
    assert all(map(judge, ("Segur0,", "p@gamento", "l4", "20l9."))) and not any(map(judge, ("zzz0", "10mm", "a@b.com", "seguro")))


def test_merged_tables_find_what_one_pass_finds(spark, sf):
    from lavra.llm import queries

    whole, merged = queries.p5_found(spark, sf), queries.p5_merged_found(spark, sf)
    assert whole.exceptAll(merged).count() == merged.exceptAll(whole).count() == 0
    assert {"page_id", "document_id", "n_newly_repeated", "n_no_longer"} == set(queries.p5_incremental(spark, sf).columns)


# --- problem 10
BODY = "O segurado avisará a seguradora. A perda supere a franquia{0}"


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (BODY.format("."), "complete"), (BODY.format(".”"), "complete"), (BODY.format("!)"), "complete"), (BODY.format(". *"), "complete"), (BODY.format(", e"), "cut"),
        (BODY.format("..."), "cut"), (BODY.format(" [...]"), "cut"), (BODY.format(" (cont"), "cut"), (BODY.format("�"), "cut"), (BODY.format(" (§ 2º, 1ª"), "cut"),
        (BODY.format(".\n- foro"), "complete"), (BODY.format("." + " " * 200_000 + "x."), "complete"), ("", "blank"), (None, "blank"), (" \n ", "blank"), (BODY.format(".\nAnexo II"), "open"), (BODY.format(".\nO segu"), "open"),
    ],
)
def test_state(text, state):
    assert truncation.state(text)[0] == state


@pytest.mark.parametrize(
    "text",
    ['O segurado disse "não vou pagar.', "A lista (ver anexo\ncontinua aqui e termina.", "<p>Texto da cláusula.", "Texto.\n```\nx = 1.", "Um “dois (três” quatro."],
)
def test_open_structure_is_cut(text):
    assert truncation.state(text)[0] == "cut"


@pytest.mark.parametrize("text", ['Ele disse "sim" e (não) saiu.', "<p>Texto<br>da cláusula.</p>", "Texto.\n```\nx = (1\n```\nFim.", "a) um item (dois) e três.", 'Um cano de 5" e outro.'])
def test_closed_structure_is_complete(text):
    assert truncation.state(text)[0] == "complete"


def test_states_take_linear_time():
    import time

    began = time.time()
    for text in (f"a{' ' * 400_000}b.", f"a{' ' * 400_000}...x", "[ " * 200_000 + "x", "a | " * 100_000 + "b", '"a ' * 100_000, "* " * 200_000, "." * 400_000 + "x", "- " * 200_000 + "a"):
        truncation.state(text)
    assert time.time() - began < 10


def test_abbreviations_are_learned(spark):
    rows = [(k, f"Nos termos do xyz. {k} segue o texto. Ponto final.", "s") for k in range(truncation.STOPS)]
    df = spark.createDataFrame([*rows, (90, "Vale o disposto no xyz.", "s"), (91, "Vale o disposto no texto.", "s")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.evidence) for r in truncation.truncated(df).collect()] == [(90, "abbreviation")]


def test_truncated(spark):
    rows = [(k, BODY.format("."), "s") for k in range(5)]
    rows += [(10, BODY.format(".\nO segu"), "s"), (11, BODY.format(".\nAnexo II"), "s"), (12, "Anexo IV", "s"), (13, None, None), (14, "", None), (15, BODY.format(" e a"), None), (15, BODY.format(" e a"), None), (16, LONG + ".", "s")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, evidence int")
    assert sorted(r.doc_id for r in truncation.truncated(df).collect()) == [10, 15]
    rates = {r.source: (r.n_docs, r.n_truncated) for r in truncation.truncation_rates(df).collect()}
    assert rates == {"s": (9, 1), None: (1, 1)}
    assert truncation.truncated(df.limit(0)).count() == 0


# --- problem 1
def test_names(spark):
    rows = [
        "Companhia de Seguros Araponga S.A.", "CIA. DE SEGUROS ARAPONGA SA", "Araponga, Cia. de Seguros", "Cia Seg. Arapgna S/A", "Araponga Seguros Gerais S.A.", "Araponga Seg. Gerais S/A",
        "Araponga Vida e Prev. S.A.", "Araponga Ressegurad. BR S.A.", None, "nao_localizado", "", "Ltda", LONG,
    ]
    holders = [
        "Energia Potrarçal Trenavasco S.A.", "POTRARCAL TRENAVASCO", "Energ. Potrarçl Trenavasco Sociedade Anônima", "Metalúrgica Potrarçal Trenavasco Ltda.", "Patrícia Fobembó Mavazzini", "Paty Fobembó Mavazzini",
        "Mavazzini, P. Fobembó", "Eduardo Fobembó Mavazzini", "E. Fobembó Mavazzini", None, "nao_localizado", "", f"{LONG} {LONG[:-1]}",
    ]
    table = [(k, a, b, 1) for k, (a, b) in enumerate(zip(rows, holders))] + [(100 + k, rows[0], holders[0], 1) for k in range(5)]
    df = spark.createDataFrame(table, "extraction_id long, seguradora string, tomador_segurado string, entity int")
    pairs = {(r.name_a, r.name_b) for r in names.variant_pairs(names.link_names(names.spellings(df))).collect()}

    def linked(*group):
        return {tuple(sorted((a, b))) for k, a in enumerate(group) for b in group[k + 1 :]}

    assert pairs == linked(*rows[:4]) | linked(*rows[4:6]) | linked(*holders[:3]) | linked(*holders[4:7]) | linked(*holders[7:9])
    assert names.variant_pairs(names.link_names(names.spellings(df.limit(0)))).count() == 0


def _entities(spark, holders, insurers=()):
    rows = [(k, None, h, 1) for k, h in enumerate(holders)] + [(1000 + k, i, None, 1) for k, i in enumerate(insurers)]
    df = spark.createDataFrame(rows, "extraction_id long, seguradora string, tomador_segurado string, entity int")
    return {r.name: r.entity for r in names.link_names(names.spellings(df)).collect()}


def test_a_more_frequent_name_does_not_hide_the_true_one(spark):
    often, true, typo = "Eduardo Fobembó Mavazzini", "Eduardo Fobembó Montegrano", "Eduardo Fobembó Montegxaxo"
    found = _entities(spark, [often] * 10 + [true] * 5 + [typo])
    assert found[typo] == found[true] != found[often]


def test_names_without_descriptor_meet_each_other(spark):
    groups = [("Fobembó Mavazzini", "Fobembó Mavazini"), ("E. Potrarçal Trenavasco", "E. Potrarçl Trenavasco")]
    insurers = ("Araponga Seguros S.A.", "Arapnga Seguros S.A.")
    found = _entities(spark, [h for a, b in groups for h in (a, a, b)], [insurers[0], *insurers])
    assert all(found[a] == found[b] for a, b in [*groups, insurers]) and len(set(found.values())) == 3


def test_long_chains_end_in_one_entity(spark):
    letters = "bcdfghjklmnpqrst"
    assert len(set(_entities(spark, [f"Energia {'z' * k}{letters[k:]} S.A." for k in range(13)]).values())) == 1


def test_names_within_two_errors_share_a_key():
    rng = random.Random(3)
    for _ in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 8))]
        other = list(words)
        for _ in range(2):
            k = rng.randrange(len(words))
            at, w = rng.randrange(len(other[k])), other[k]
            other[k] = rng.choice([w[:at] + "x" + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + w[at + 1 :] or "x", w[:at] + w[at : at + 2][::-1] + w[at + 2 :]])
        if sum(map(names.errors, words, other)) <= 2:
            assert names.name_keys(words) & names.name_keys(other), (words, other)


# --- problem 2
def test_noise(spark):
    clean = "O ex-administrador avisará a seguradora sobre a reclamação recebida. O administrador aprovará a retenção prevista."
    noisy = "Apólice DO-ABC-12345 – João\nO administrador avisará a segu-\nradora sobre a reclarnação recebida, e o ex-\nadministrador apr0vará a ret¬\nenção, conforme o item 4.\n4. Limites e franquia\nMoeda: R$ — apólice DO-ABC-12345\nPag1na 2 dc 4"
    rows = [(k, f"c{k}", 1, clean, "k") for k in range(60)]
    rows += [(100 + n, "d", n, noisy.replace("Pag1na 2", f"Pag1na {n}"), "k") for n in (1, 2, 3)] + [(102, "d", 2, noisy, "k")]
    rows += [(200, "e", 1, None, "k"), (201, "e", 2, "", "k"), (202, "e", 3, LONG, "k"), (203, "e", None, "só uma linha", "k")]
    pages = spark.createDataFrame(rows, "page_id long, document_id string, page_number int, text string, kind string")
    found = scan_noise.noise(pages)
    got = {(r.page_id, r.line_no, r.kind) for r in found.collect()}
    expected = {(1, "header"), (2, "hyphen"), (3, "misread"), (4, "misread"), (4, "hyphen"), (8, "page_number")}
    assert got == {(p, n, kind) for p in (101, 102, 103) for n, kind in expected}
    by_join = {(r.page_id, r.line_no, r.kind) for r in scan_noise.noise(pages, max_table=0).collect()}
    assert by_join == got
    cases, fixes = scan_noise.noise_and_corrections(pages)
    text = {r.page_id: r.text for r in scan_noise.repaired_pages(pages, cases, fixes).collect()}
    assert "seguradora sobre a reclamação recebida" in text[102] and "ex-administrador" in text[102] and "DO-ABC-12345 –" not in text[102].split("Moeda")[0] and "Pag1na" not in text[102]
    assert text[200] is None and scan_noise.noise(pages.limit(0)).count() == 0


def test_a_large_correction_table_finds_the_same(spark):
    clean = "O administrador avisará a seguradora sobre a reclamação recebida."
    rows = [(k, f"c{k}", 1, clean, "k") for k in range(60)]
    broken, disguised = "avisará sobre a reclar-\nnação recebida, e\nmais nada.", "avisará sobre a recla\u200brnação recebida."
    rows += [(100, "d", 1, broken, "k"), (101, "d", 2, disguised, "k"), (102, None, 3, "sobre a reclarnação, e", "k"), (103, "d", None, "sobre a reclarnação, e", "k")]
    pages = spark.createDataFrame(rows, "page_id long, document_id string, page_number int, text string, kind string")
    got = {(r.page_id, r.line_no, r.kind) for r in scan_noise.noise(pages).collect()}
    assert {(101, 1, "misread"), (102, 1, "misread"), (103, 1, "misread")} < got and (100, "misread") in {(p, kind) for p, _, kind in got}
    assert {(r.page_id, r.line_no, r.kind) for r in scan_noise.noise(pages, max_table=0).collect()} == got


def test_a_broken_misread_word_is_corrected_once_joined(spark):
    clean = "O administrador avisará a seguradora sobre a reclamação recebida."
    rows = [(k, f"c{k}", 1, clean, "k") for k in range(60)] + [(100, "d", 1, "avisará sobre a reclar-\nnação recebida, e\nmais nada.", "k"), (101, "d", 2, "sobre a reclarnação, e", "k")]
    pages = spark.createDataFrame(rows, "page_id long, document_id string, page_number int, text string, kind string")
    text = {r.page_id: r.text for r in scan_noise.repaired_pages(pages, *scan_noise.noise_and_corrections(pages)).collect()}
    assert text[100] == "avisará sobre a reclamação recebida, e mais nada." and text[0] == clean


def test_corrections_equal_brute_force(spark):
    words = [("segurado", 500), ("scgurado", 3), ("seguracio", 3), ("tornador", 4), ("tomador", 300), ("tomada", 200), ("limite", 90), ("lirnite", 12), ("xyz", 1), ("aclquirlr", 1), ("adquirir", 50)]
    df = spark.createDataFrame(words, "word string, n long")
    got = {r.word: r.correct for r in scan_noise.corrections(df).collect()}
    want = {}
    for w, n in words:
        options = []
        for true, read in (c.split(" ") for c in scan_noise.CONFUSIONS):
            forms = {w[:p] + true + w[p + len(read) :] for p in range(len(w)) if w.startswith(read, p)} | {w.replace(read, true)}
            options += [(m, v) for v, m in words if v in forms - {w} and m >= scan_noise.RATIO * n]
        if options:
            want[w] = max(options)[1]
    assert got == want


def test_page_numbers():
    for line in ("— 3 —", "[3]", "Pág. 3", "Página 3 de 9", "Pag1na 3 dc 9", "3/9", "fl. 003", "Folha nº 3", "p. 3 | 9", "iii", "   - 3 -"):
        assert scan_noise.is_page_number(line, 3), line
    for line in ("4. Limites", "art. 3.", "Página 4 de 9", "x", ""):
        assert not scan_noise.is_page_number(line, 3), line
