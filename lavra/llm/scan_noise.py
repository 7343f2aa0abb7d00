"""Problem 2: noise in text from scanned pages, found line by line and repaired.

1. One pass counts words and hyphenated compounds of all pages; each Arrow
   batch is added up before the shuffle.
2. Rare words meet frequent ones in SQL: a word's anagram hash is the sum of
   its characters' fifth powers, so reading ``true`` as ``read`` changes it by a
   constant.  Joining ``hash(rare) + difference`` with ``hash(frequent)`` gives the
   candidates, a check of the letters in order confirms them, and the most
   frequent one is the correction.
   A digit or sign within a word, or a letter within a number, is evidence by
   itself: there the true word need not be more frequent.
3. A second pass marks lines: words of the correction table, line-end hyphens
   with both word parts, page-number lines, and lines at the edges of a page that
   hold a policy number or nothing but names.
4. Hyphens are judged by evidence: a compound written with its hyphen
   elsewhere more often than the joined word keeps it.  Edge lines are headers
   where their skeleton - letters with confusable shapes made equal - stands on
   three pages of the document, and either holds a policy number or consists of
   names and is no line of many documents, as notices of a source are.

Defined results: null and blank pages have no lines; repeated rows of a page
count once in the result; headings, labelled lines, headers and page-number lines
are never ``misread``.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType
from xxhash import xxh3_64_hexdigest

from lavra.llm.lookalike import SUSPECT, canonical, canonical_column
from lavra.session import cut

# What a recognised character may stand for, as "true read".
CONFUSIONS = (
    "i l", "l i", "e c", "c e", "o 0", "s 5", "l 1", "i 1", "b 6", "g 9", "z 2", "b 8", "u ii", "d cl", "cl d", "n ri",
    "ri n", "m rn", "rn m", "g q", "q g", "ti h", "li h", "h li", "v y", "y v", "w vv", "ã ä", "õ ö", "ç g", "é 6", "í l", "í 1",
    "ó 6", "á à", "a á", "h b", "m nn", "in m", "nt m", "o ö", "a @", "á @",
)
# The same for the digits of a number.
NUMBER_CONFUSIONS = ("0 o", "1 l", "1 i", "5 s", "8 b")

#: A frequent word is at least so many times as frequent as its misreading.
RATIO = 10
#: Characters of the longest token that is a word.
MAX_WORD = 40
#: Entries of the correction table that are broadcast; a larger table is joined.
MAX_TABLE = 2_000_000
#: Digits of the longest number that counts as a word.
MAX_NUMBER = 4
#: Pages on which a header recurs, and lines at either edge of a page that may hold one.
HEADER_PAGES, EDGE = 3, 4
#: A line without a policy number on the pages of so many documents names no policy or party of one of them.
MANY_DOCUMENTS = 4
#: Letters and digits of the shortest header.
MIN_HEADER = 8

_SUSPECT = re.compile(SUSPECT)
#: A break sign at a line's end; its neighbours are read from the text around it.
_BREAK = re.compile(r"[-¬­‐–](?=[ \t]*(?:\n|\Z))")
_TOKEN = re.compile(r"[^\W_]+(?:[-@][^\W_]+)*")
_LABEL = re.compile(r"\s*[A-ZÀ-Ý][^:.;\n]{1,45}:\s")
_NUMBERED = re.compile(r"\s*\d+(?:\.\d+)*[.)]?\s+[A-ZÀ-Ý][^.;:]{2,60}\s*\Z")
_ID = re.compile(r"[A-Z0-9OIl]{2,4}-[A-Z0-9]{2,5}-[\w]{4,7}")
# Shapes made equal for comparing lines; pairs are written in shapes that are equal already.
_SHAPES = str.maketrans("0156892íìîçyäàáâãåéèêëóòôõöúùûüñegi@|!$", "olsbbqzlllcvaaaaaaccccooooouuuuncqlalls")
_PAIRS = ("rn m", "cl d", "rl n", "vv w", "ll u", "tl u", "h u", "nn m", "ln m")


def skeleton(line: str) -> str:
    """Letters and digits of a line, with shapes that are taken for each other made equal."""
    text = line.casefold().translate(_SHAPES)
    for pair in _PAIRS:
        text = text.replace(*pair.split(" "))
    return re.sub(r"[\W_]+", "", text)


_PAGE = re.compile(
    r"\W*(?:p(?:[aá]g(?:[i1l]na)?)?|fl|f[o0][l1i]ha|h[o0]ja|page|fo[l1i]io|f)?\W{0,3}(?:n[º°o.]*)?\W{0,4}([0-9OoIil]{1,4})\W*(?:\W|d[ec]|[o0]f)?\W*([0-9OoIil]{1,4})?\W*", re.I
)
_DIGITS = str.maketrans("OoIil", "00111")


def roman(n: int) -> str:
    """A number in lower-case Roman numerals."""
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        count, n = divmod(n, value)
        out += sign * count
    return out


def is_page_number(line: str, page: int) -> bool:
    """Whether a line holds only the number of its page, perhaps with a label and the number of pages."""
    if (letters := re.fullmatch(r"\W*(?:p[aá]g\w*|fl|folha|p)?\W*([ivxlcIVXLC]{1,8})\W*", line.strip())) and letters.group(1).lower() == roman(page):
        return True
    found = _PAGE.fullmatch(line.strip())
    if not found or not (any(ch.isdigit() for ch in line) or len(line.strip()) == 1):
        return False
    return int(found.group(1).translate(_DIGITS)) == page


def is_heading(line: str) -> bool:
    """Upper-case lines, and short numbered titles."""
    letters = [ch for ch in line if ch.isalpha()]
    if letters and all(ch.isupper() or ch in "ªº" for ch in letters):
        return True
    return bool(_NUMBERED.match(line)) and len(line) < 60


_LONG_WORD = re.compile(r"[^\W\d_]{4}")
_SMALL_WORD = re.compile(r"(?<![^\W\d_])[a-zª-öø-ÿ][^\W\d_]{3}")


def names_only(line: str) -> bool:
    """Whether all longer words of a line begin with a capital letter, as in lines that name somebody."""
    return not _SMALL_WORD.search(line) and bool(_LONG_WORD.search(line))


def digit_in_word(token: str) -> bool:
    """A digit that stands for a letter: one or two among three or more letters of a word."""
    digits = sum(ch.isdigit() for ch in token)
    if not digits or digits > 3 or len(token) > MAX_WORD or "-" in token and _ID.search(token.upper()):
        return False
    letters = sum(ch.isalpha() for ch in token)
    if letters <= digits or letters < 2:
        return False
    if all(ch in "0123456789ABCDEFabcdef" for ch in token) and digits > 1:
        return False  # a hexadecimal code
    return not re.fullmatch(r"\d+[ªº]|\d+(?:h\d*|k|mm?|mi|[ºª]|[a-z]{1,2})|[A-Z]{1,3}\d+", token, re.I)


def letter_in_number(token: str) -> bool:
    """A letter that stands for a digit within a number."""
    return bool(re.fullmatch(r"[0-9]+[lIOoSBZ]+[0-9]*|[lIOoSBZ][0-9]{2,}|[lIOo][0-9]", token))


def _running(line: str) -> bool:
    return bool(line) and not is_heading(line) and not _LABEL.match(line)


def breaks(text: str) -> list[tuple[int, int, int, int]]:
    """(start, sign, begin, end) of words broken at a line's end: the word's start, its sign, and its part after the
    line end, which is empty at the end of the text or where no word follows."""
    out = []
    for m in _BREAK.finditer(text):
        sign = start = m.start()
        while start and text[start - 1].isalpha():
            start -= 1
        if start == sign:
            continue
        begin = sign + 1
        while begin < len(text) and text[begin].isspace():
            begin += 1
        end = begin
        while end < len(text) and text[end].isalnum():
            end += 1
        out.append((start, sign, begin, end))
    return out


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            text = canonical(text) if _SUSPECT.search(text) else text
            # a word broken at a line end is evidence for neither spelling
            found = breaks(text)
            raw.update((_split_off(text, [k for s, _, b, e in found for k in ((s, b), (b, e))]) if found else text).lower().split())
        if len(raw) > 400_000:
            yield _as_frame(raw)
            raw.clear()
    yield _as_frame(raw)


def _as_frame(raw: Counter) -> pd.DataFrame:
    counts: Counter = Counter()
    for token, n in raw.items():
        for w in _TOKEN.findall(token):
            if 1 < len(w) <= (MAX_NUMBER if w.isdigit() else MAX_WORD):
                counts[w] += n
    return pd.DataFrame(list(counts.items()), columns=["word", "n"])


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over all pages; words in lower case, compounds with their hyphens."""
    partial = pages.select("text").mapInPandas(_count_words, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def anagram_hash(word):
    """Sum of the fifth powers of a word's characters, wrapping at 64 bits."""
    power = lambda c: F.ascii(c).cast("bigint") * F.ascii(c) * F.ascii(c) * F.ascii(c) * F.ascii(c)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.when(c == "", 0).otherwise(power(c)).cast("bigint"))


def _hash(text: str) -> int:
    return sum(ord(ch) ** 5 for ch in text)


def corrections(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, correct, read, true) of the words that are misreadings of a much more frequent word.

    Words with a digit or sign meet every word that reading these otherwise makes of them, whatever its frequency.
    """
    plain = words.where(~F.col("word").contains("-")).select("word", "n", anagram_hash(F.col("word")).alias("h"))
    changes = [(*c.split(" "), False) for c in CONFUSIONS] + [(*c.split(" "), True) for c in NUMBER_CONFUSIONS]
    odd = F.col("word").rlike("[0-9@]")
    options = F.array(
        *[
            F.when(F.col("word").contains(read) & (odd if number or not read.isalpha() else ~odd), F.struct(F.lit(true).alias("true"), F.lit(read).alias("read"), (F.col("h") + F.lit(times * (_hash(true) - _hash(read)))).alias("target")))
            for true, read, number in changes
            for times in (1, 2)
        ]
    )
    rare = plain.where(~F.col("word").rlike("^[0-9]+$")).select("word", "n", F.explode(F.array_compact(options)).alias("o")).select("word", "n", "o.*")
    frequent = plain.where(F.length("word") > 1).select(F.col("word").alias("correct"), F.col("n").alias("m"), F.col("h").alias("target"))
    met = rare.join(frequent, "target").where((odd | (F.col("m") >= ratio * F.col("n"))) & ~F.col("correct").rlike("@") & (F.col("word") != F.col("correct")))
    size = F.length("read")
    single = F.exists(
        F.sequence(F.lit(1), F.length("word")),
        lambda p: (F.substring("word", p, size) == F.col("read")) & (F.concat(F.substring("word", F.lit(1), p - 1), F.col("true"), F.substring("word", p + size, F.length("word"))) == F.col("correct")),
    )
    whole = F.expr("replace(word, read, true)") == F.col("correct")
    confirmed = met.where(single | whole)
    best = F.max(F.struct("m", "correct", "read", "true")).alias("b")
    return confirmed.groupBy("word").agg(best).select("word", "b.correct", "b.read", "b.true")


_MARKS = "page_id bigint, document_id string, page_number int, line_no bigint, kind string, a string, b string"


def _marker(name: str, shared):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _table(name, shared)
        for batch in batches:
            rows: list[tuple] = []
            for page_id, doc, number, text, own in zip(batch["page_id"], batch["document_id"], batch["page_number"], batch["text"], batch["bad"]):
                known = None if pd.isna(number) else int(number)
                text = canonical(text) if _SUSPECT.search(text) else text
                rows += [(page_id, doc, known, *r) for r in mark_page(text, known, Judge(dict(own)) if own else table)]
            frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _MARKS.split(", ")])
            yield frame.astype({"page_number": "Int32"})

    return mark


class Judge:
    """Whether a token, as it stands between white space, holds a misread word; answers are kept."""

    def __init__(self, bad: dict[str, str], keep: int = 300_000):
        self.bad, self.keep, self.known = bad, keep, {}

    def __call__(self, token: str) -> bool:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            found = self.known[token] = self._misread(token)
        return found

    def _misread(self, token: str) -> bool:
        for word in _TOKEN.findall(token):
            if "-" in word and word.lower() in self.bad:
                return True
            if "-" in word and _ID.search(word):
                continue
            if any(p.lower() in self.bad and self._odd(p, token) for p in word.split("-")):
                return True
        return False

    @staticmethod
    def _odd(word: str, token: str) -> bool:
        """Exact check of words with digits or signs, which may also be codes, units and addresses."""
        if word.isalpha():
            return True
        return bool(_SIGN_IN_WORD.search(token)) if "@" in word else digit_in_word(word) or letter_in_number(word)


_TABLES: dict[str, Judge] = {}


def _table(name: str, shared) -> Judge:
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Judge(pickle.loads(shared.value))
    return _TABLES[name]


_SIGN_IN_WORD = re.compile(r"(?<![\w.@])[^\W\d_]+@[^\W\d_]+(?![\w@]|\.\w)")


def _split_off(text: str, spans: list[tuple[int, int]]) -> str:
    """A text with the given spans blanked; its line feeds stay where they are."""
    parts, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*parts, text[at:]])


def mark_page(text: str, number: int | None, misread: Judge) -> list[tuple[int, str, str | None, str | None]]:
    """(line_no, kind, a, b) of one page.

    Kinds: ``misread``, ``break`` (a, b: parts of the word, with the sign after a tab), ``page_number``, and
    ``edge`` (a: hash of the skeleton, b: ``id`` where it holds a policy number) for lines that may be headers.
    """
    lines = text.split("\n")
    filled = [k for k, line in enumerate(lines) if line and not line.isspace()]
    out: list[tuple[int, str, str | None, str | None]] = []
    furniture: set[int] = set()
    for k in {*filled[:EDGE], *filled[-EDGE:]}:
        line = lines[k]
        if number is not None and len(line.strip()) <= 24 and is_page_number(line, number):
            out.append((k + 1, "page_number", None, None))
            furniture.add(k)
        elif (named := line.count("-") > 1 and bool(_ID.search(line))) or names_only(line):
            if not _LABEL.match(line) and (named or not is_heading(line)) and (len(shape := skeleton(line)) >= MIN_HEADER or named):
                out.append((k + 1, "edge", xxh3_64_hexdigest(shape), "id" if named else None))
            if named:
                furniture.add(k)
    # misread words: whole-page test first, lines only where it finds something.  Parts of broken words, also of
    # one broken at the page's end or start, are no words of their own.
    broken = breaks(text)
    rest = _split_off(text, [k for s, g, b, e in broken for k in ((s, g), (b, e))]) if broken else text
    if filled and (first := _FIRST_WORD.match(lines[filled[0]])) and filled[0] not in furniture:
        at = sum(len(x) + 1 for x in lines[: filled[0]])
        rest = _split_off(rest, [(at + first.start(1), at + first.end(1))])
    hits = {t for t in set(rest.split()) if misread(t)}
    if hits:
        for k, line in enumerate(rest.split("\n")):
            if k not in furniture and not hits.isdisjoint(line.split()) and _running(lines[k]):
                out.append((k + 1, "misread", None, None))
    for start, sign, begin, end in broken:
        k = text.count("\n", 0, sign)
        if k in furniture or is_heading(lines[k]):
            continue
        left, right = text[start:sign], text[begin:end]
        far = text.count("\n", 0, begin)
        # a part that holds a digit or sign is also read as half of a compound
        odd = right and not (left + right).isalpha() and misread(f"{left}-{right}")
        if right and far not in furniture and (misread(left + right) or odd) and _running(lines[k]):
            good = misread.bad.get((left + right).lower(), left.lower() if misread(right) else "")
            same = 0
            while same < min(len(good), len(left)) and good[same] == left[same].lower():
                same += 1
            out.append((k + 1 if same < len(left) else far + 1, "misread", None, None))
        begins = start
        while begins > 1 and text[begins - 1] == "-" and text[begins - 2].isalnum():  # the compound it ends
            begins -= 2
            while begins and text[begins - 1].isalnum():
                begins -= 1
        follows = right.lower() if right and far not in furniture else None
        out.append((k + 1, "break", text[begins:sign].lower() + "\t" + text[sign], follows))
    return out


def page_words(text: str) -> set[str]:
    """Words in lower case that ``mark_page`` may look up: those between white space and the joined form of broken ones."""
    found = breaks(text)
    tokens = set((_split_off(text, [k for s, g, b, e in found for k in ((s, g), (b, e))]) if found else text).split())
    for start, sign, begin, end in found:
        tokens |= {text[start:sign] + text[begin:end], text[start:sign], text[begin:end]}
    parts = {p.lower() for t in tokens for w in _TOKEN.findall(t) for p in w.split("-")}
    return {p for p in parts if 1 < len(p) <= MAX_WORD and not p.isdigit()}


def _keyed_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = (canonical(t) if _SUSPECT.search(t) else t for t in batch["text"])
        rows = [(key, word) for key, text in zip(batch["_key"], texts) for word in page_words(text)]
        yield pd.DataFrame(rows, columns=["_key", "word"]).astype({"_key": "int64"})


_FIRST_WORD = re.compile(r"\s*([^\W\d_A-ZÀ-Ý]+)(?![\w.])")


def noise_and_corrections(pages: DataFrame, max_table: int = MAX_TABLE) -> tuple[DataFrame, DataFrame]:
    """The cases, as of ``noise``, and the correction table (word, correct, read, true)."""
    text = pages.where(F.col("text").isNotNull() & (F.length("text") > 0)).select(
        F.col("page_id").cast("bigint").alias("page_id"), "document_id", F.col("page_number").cast("int").alias("page_number"), "text"
    )
    words = cut(word_counts(text))
    fixes = cut(corrections(words))
    return judged(cut(marked(text, fixes, max_table)), words), fixes


def noise(pages: DataFrame, max_table: int = MAX_TABLE) -> DataFrame:
    """(page_id, document_id, line_no, kind) of noisy lines, distinct."""
    return noise_and_corrections(pages, max_table)[0]


def marked(text: DataFrame, fixes: DataFrame, max_table: int = MAX_TABLE) -> DataFrame:
    """Marks of all lines; a correction table beyond ``max_table`` entries meets the pages' words in a join instead."""
    spark, small = text.sparkSession, fixes.limit(max_table + 1).count() <= max_table
    if not small:
        # a key that is never null; pages that share one get the words of both, which changes nothing
        text = text.withColumn("_key", F.xxhash64("page_id", "document_id", "page_number", "text"))
        own = text.select("_key", "text").mapInPandas(_keyed_words, "_key bigint, word string").join(fixes.select("word", "correct"), "word")
        found = own.groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("word", "correct"))).alias("bad"))
        text = text.join(found, "_key", "left").drop("_key")
    else:
        text = text.withColumn("bad", F.lit(None).cast("map<string,string>"))
    table = {r[0]: r[1] for r in fixes.select("word", "correct").toLocalIterator()} if small else {}
    shared = spark.sparkContext.broadcast(pickle.dumps(table, protocol=5))
    return text.mapInPandas(_marker(uuid4().hex, shared), _MARKS)


def judged(marks: DataFrame, words: DataFrame) -> DataFrame:
    """Marks turned into cases: hyphens by evidence, edge lines by recurrence."""
    direct = marks.where(F.col("kind").isin("misread", "page_number")).select("page_id", "document_id", "line_no", "kind")
    breaks = marks.where("kind = 'break'").select(
        "page_id", "document_id", "line_no", F.substring_index("a", "\t", 1).alias("l"), F.substring_index("a", "\t", -1).alias("sign"), F.col("b").alias("r")
    )
    counts = words.select(F.col("word"), F.col("n"))
    compound = counts.select(F.col("word").alias("_c"), F.col("n").alias("n_compound"))
    whole = counts.select(F.col("word").alias("_w"), F.col("n").alias("n_whole"))
    first = words.where(F.col("word").contains("-")).groupBy(F.substring_index("word", "-", 1).alias("_l")).agg(F.sum("n").alias("n_first"))
    alone = counts.select(F.col("word").alias("_a"), F.col("n").alias("n_alone"))
    seen = (
        breaks.withColumn("_c", F.concat("l", F.lit("-"), "r"))
        .withColumn("_w", F.concat("l", "r"))
        .join(compound, "_c", "left")
        .join(whole, "_w", "left")
        .join(first, F.col("l") == F.col("_l"), "left")
        .join(alone, F.col("l") == F.col("_a"), "left")
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    keeps = F.when(F.col("r").isNotNull(), n("n_compound") > n("n_whole")).otherwise(n("n_first") > n("n_alone"))
    hyphens = seen.where(F.col("sign").isin("¬", "­") | ~keeps).select("page_id", "document_id", "line_no", F.lit("hyphen").alias("kind"))
    edges = marks.where("kind = 'edge'")
    recurring = edges.groupBy("document_id", "a").agg(F.countDistinct("page_number").alias("k"), F.max("b").alias("id")).where(F.col("k") >= HEADER_PAGES)
    recurring = cut(recurring)
    common = recurring.where("id IS NULL").groupBy("a").count().where(F.col("count") >= MANY_DOCUMENTS).select("a")
    own = recurring.where("id IS NOT NULL").unionByName(recurring.where("id IS NULL").join(common, "a", "left_anti"))
    headers = edges.join(own.select("document_id", "a"), ["document_id", "a"]).select("page_id", "document_id", "line_no", F.lit("header").alias("kind"))
    found = hyphens.unionByName(headers).unionByName(direct)
    # a line that turned out to be a header holds no running text
    kinds = found.groupBy("page_id", "document_id", "line_no").agg(F.collect_set("kind").alias("kinds"))
    running = F.filter("kinds", lambda k: (k == "header") | ~F.array_contains("kinds", "header") | (k == "page_number"))
    return kinds.select("page_id", "document_id", "line_no", F.explode(running).alias("kind"))


def repaired_pages(pages: DataFrame, found: DataFrame, fixes: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Pages as continuous paragraphs: furniture removed, broken words joined, corrections applied.

    ``found`` are the cases of ``noise``, ``fixes`` its correction table; ``repeated``, if given, has (page_id, line_no)
    of lines to leave out as well (problem 5).  One row a page_id; pages without text keep it.
    """
    drop = found.where("kind in ('header', 'page_number')").select("page_id", "line_no")
    if repeated is not None:
        drop = drop.unionByName(repeated.select("page_id", "line_no"))
    per_page = drop.groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    hyphens = found.where("kind = 'hyphen'").groupBy("page_id").agg(F.collect_set("line_no").alias("hyphens"))
    misread = found.where("kind = 'misread'").select("page_id").distinct()
    own = Window.partitionBy("page_id").orderBy(F.col("text").asc_nulls_last())
    first = pages.select("page_id", "document_id", "page_number", "text").withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")
    base = first.withColumn("text", canonical_column("text"))
    joined = base.join(per_page, "page_id", "left").join(hyphens, "page_id", "left")
    # read twice below: kept once.  Words are corrected as they stand after broken ones are joined.
    whole = cut(joined.select("page_id", "document_id", "page_number", _repair_udf("text", "drop", "hyphens").alias("text")))
    wrong = whole.join(misread, "page_id", "left_semi").select("page_id", F.explode(_words_udf("text")).alias("word")).join(fixes.select("word", "correct"), "word")
    table = wrong.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "correct"))).alias("fixes"))
    text = F.when(F.col("fixes").isNull(), F.col("text")).otherwise(_correct_udf("text", "fixes"))
    return whole.join(table, "page_id", "left").select("page_id", "document_id", "page_number", text.alias("text"))


def repair(text: str | None, drop: set[int], hyphens: set[int]) -> str | None:
    """One page's readable text before its words are corrected; see ``repaired_pages``."""
    if text is None:
        return None
    paragraphs: list[str] = []
    current, glue = "", False
    for no, line in enumerate(text.split("\n"), 1):
        if no in drop:
            continue
        line = " ".join(line.split())
        alone = bool(line) and not _running(line)
        if not line or alone:
            if current and not glue:
                paragraphs.append(current)
                current = ""
            if alone:
                paragraphs.append(line)
            continue
        current = current + line if glue else f"{current} {line}" if current else line
        # a broken word loses its sign; a compound broken at its own hyphen keeps it
        glue = no in hyphens or (current[-1] == "-" and current[-2:-1].isalnum())
        if no in hyphens:
            current = current[:-1]
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)


_WORD = re.compile(r"[^\W_]+(?:@[^\W_]+)*")


def correct(text: str, fixes: dict[str, str]) -> str:
    """A text with its misread words corrected, in the case they are written in."""

    def fix(m: re.Match) -> str:
        word = m.group()
        good = fixes.get(word.lower())
        if good is None or not Judge._odd(word, word):
            return word
        return good.upper() if word.isupper() and len(word) > 1 else good.capitalize() if word[0].isupper() else good

    return _WORD.sub(fix, text)


@F.pandas_udf(StringType())
def _repair_udf(texts: pd.Series, drops: pd.Series, hyphens: pd.Series) -> pd.Series:
    some = lambda x: set() if x is None else {int(v) for v in x}
    return pd.Series([repair(t, some(d), some(h)) for t, d, h in zip(texts, drops, hyphens)])


@F.pandas_udf(ArrayType(StringType()))
def _words_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: [] if text is None else sorted({w.lower() for w in _WORD.findall(text)}))


@F.pandas_udf(StringType())
def _correct_udf(texts: pd.Series, fixes: pd.Series) -> pd.Series:
    return pd.Series([correct(t, dict(f)) if f else t for t, f in zip(texts, fixes)])
