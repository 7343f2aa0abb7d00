"""Problem 10: texts cut off by a field limit or a broken transfer.

Three kinds of evidence, in this order:

1. a stack automaton: brackets, curly and straight quotations of the last
   paragraph, tags and code fences of the whole text that are open at the end;
   a broken escape, entity, tag or multibyte sequence there;
2. a sign of omission after unfinished text, an unfinished number, an
   abbreviation that the corpus itself seldom ends a sentence with, or a last
   line that goes on after a finished sentence;
3. a last line without any terminator.  Whether such a line is a heading, a
   signature or a table row, or the start of a sentence, is told by the
   baseline of its source: how often lines that begin with the same word end
   with a terminator there, and, where the source has no such line, anywhere.

Texts are read whole, by patterns that take time in proportion to their length.
Baselines and abbreviations are counts over all lines of all documents,
aggregated before the shuffle; candidates meet them in equi-joins.

Defined results: null, empty and blank texts are no cases; repeated rows of a
document give one row; null sources form a group of their own in the report.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lavra.session import broadcast_if_small, cut

# Signs of omission, words that a section number follows, closers of a sentence.
_OMISSION = re.compile(r"(?:\[\s*+(?:\.{2,}|…|cont\w*+\.?)?\s*+\]?|\(\s*+(?:\.{2,}|…|cont\w*+\.?\s*+)\)?|(?<!\.)\.{3,}|…|(?<!-)-{2,}>?|>>)\Z", re.I)
_CUT_NUMBER = re.compile(r"(?:\bitem|\bapartado|\bsection)\s+\d+\.\Z|[$€]\s?\d(?:[\d.,]*[.,])?\Z|\bprocesso\s+\d+\.\Z", re.I)
_FINISHED = re.compile(r"[.!?][\"”»’)\]]*\Z")
_WITHIN = re.compile(r"[.!?][\"”»’)\]]*\s+(?=\S)")
_LIST = re.compile(r"(?:[-–—•*·▪◦]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,5}[.)])\s+\S")
_TABLE = re.compile(r"(?:\t|\s\|\s|\A\||\s{3,})\s*+(?:\S+\s+){0,2}\S+(?:\s*\|)?\Z")
_GAP = re.compile(r"\s+")
_OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}
_STRUCTURE = re.compile(r"[()\[\]{}“”«»\"]")
_BROKEN = re.compile(r"(?:�|&[#\w]{0,8}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9a-fA-F]|</?[a-zA-Z][^<>\n]{0,200}|Ã)\Z")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?>")
# Tags that enclose nothing.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_FENCE = re.compile(r"^[ \t]{0,3}(?:```|~~~)", re.M)
_LAST_WORD = re.compile(r"(?:\A|[\s(])([^\W\d_]+º?)\.\Z")
#: Footnote marks, of which the first three may also follow a terminator directly.
_MARKS = "*†‡¹²³"

#: A word is an abbreviation where the text goes on behind its full stop so many times, and so many times as often as not.
STOPS, STOP_RATIO = 10, 3

_EVIDENCE = StructType([StructField("state", StringType()), StructField("opener", StringType())])


def open_structures(text: str) -> list[str]:
    """Brackets and quotations opened and not closed, by a stack; closers without opener are ignored.

    A straight quotation mark opens before a letter and after white space or an opener, and closes where it is open.
    """
    stack: list[str] = []
    for found in _STRUCTURE.finditer(text):
        ch = found.group()
        if ch == '"':
            at = found.start()
            if '"' in stack:
                del stack[stack.index('"') :]
            elif (not at or text[at - 1] in " \t\n([{“«") and text[at + 1 : at + 2].strip():
                stack.append(ch)
        elif ch in _OPENERS:
            stack.append(ch)
        elif stack and ch == _OPENERS.get(stack[-1]):
            stack.pop()
    return stack


def open_markup(text: str) -> bool:
    """Whether a code fence or a tag of the text is open at its end; tags within fences do not count."""
    if "```" in text or "~~~" in text:
        parts = _FENCE.split(text)
        if len(parts) % 2 == 0:
            return True
        text = "".join(parts[::2])
    if "<" not in text:
        return False
    depth: dict[str, int] = {}
    for closing, name in _TAG.findall(text):
        name = name.lower()
        if name not in _VOID:
            depth[name] = max(0, depth.get(name, 0) + (-1 if closing else 1))
    return any(depth.values())


def _without_marks(text: str) -> str:
    """A text without footnote marks at its end."""
    while text and text[-1] in _MARKS:
        bare = text.rstrip(_MARKS)
        if bare[-1:].isspace():
            text = bare.rstrip()
        elif bare[-1:] in (".", "!", "?") and not set(text[len(bare) :]) - set("*†‡"):
            text = bare
        else:
            break
    return text


def _table_row(line: str) -> bool:
    """Whether the last cell of a line, of at most three words, stands after a cell border."""
    head = line.rsplit(None, 5)
    head = head[0] if len(head) == 6 else ""
    cells = _GAP.sub(lambda m: "\t" if "\t" in m.group() else m.group()[:3], line[len(head) :])
    return bool(_TABLE.search(("x" if head else "") + cells))


def opener(line: str) -> str:
    """First word of a line; it must be the whole word, followed by a space."""
    first, space, _ = line.strip().partition(" ")
    return first if space else ""


def state(text: str | None) -> tuple[str, str]:
    """(state, word): ``blank``, ``complete`` or ``cut``; ``open`` leaves the verdict to the baseline of the last line's first
    word.  The word of a complete text, if any, is its last one, and an abbreviation revokes the verdict."""
    body = (text or "").strip()
    if not body:
        return "blank", ""
    whole = body = _without_marks(body) or body
    while body[-1:] == ">" and (tag := _TAG.fullmatch(body, body.rfind("<"))):  # a closed element ends where its text does
        body = body[: tag.start()].rstrip()
    if not body:
        return "blank", ""
    if _BROKEN.search(body):
        return "cut", ""
    if found := _OMISSION.search(body):
        rest = body[: found.start()].rstrip()
        if rest and not (_FINISHED.search(rest) or rest[-1] == "“"):
            return "cut", ""
    last = body.rsplit("\n", 1)[-1].strip()
    if "```" in body or "~~~" in body:  # code is no prose
        body = "".join(_FENCE.split(body)[::2]).rstrip() or body
    at = max(body.rfind("\n\n"), 0)
    paragraph = body[at:] if at else body
    if _FINISHED.search(body):
        if _CUT_NUMBER.search(body):
            return "cut", ""
        if open_structures(paragraph) or open_markup(whole):
            return "cut", ""
        word = _LAST_WORD.search(body)
        return "complete", word.group(1).lower() if word else ""
    if body[-1] in ",-‐¬(“«[{/&":
        return "cut", ""
    if _LIST.match(last):
        # an entry ends where it ends, unless it is itself running text
        return ("cut" if len(last) > 60 and body[-1] != ";" else "complete"), ""
    if body[-1] == ";" or _WITHIN.search(last) or open_structures(last) or open_markup(whole):
        return "cut", ""
    if _table_row(last):
        return "complete", ""
    if last[0].islower():
        return "cut", ""
    return "open", opener(last)


@F.pandas_udf(_EVIDENCE)
def _state_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([state(t) for t in texts], columns=["state", "opener"])


def baselines(documents: DataFrame) -> DataFrame:
    """(kind, source, word, n_yes, n_no), in one pass over all lines.

    Kind ``line``: lines by source and first word, with and without a terminator.  Kind ``stop``: words that stand
    before a full stop within a line, where the text goes on small or with a digit, and where it does not.
    """
    line = F.trim(F.col("line"))
    ended = F.struct(F.lit("line").alias("kind"), "source", F.substring_index(line, " ", 1).alias("word"), line.rlike(r"[.!?][\"”»’)\]]*$").alias("yes"))
    # a line is split at its full stops once; each but the last part ends in the word before one, the next begins behind it
    last = lambda p: F.lower(F.substring_index(p, " ", -1))
    stop = lambda p, q: F.struct(F.lit("stop").alias("kind"), F.lit("").alias("source"), F.ltrim(last(p), F.lit("(")).alias("word"), q.rlike(r"^[\p{Ll}\p{N}]").alias("yes"))
    parts = F.transform(F.array(F.split(line, r"[.]\s+")), lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), stop)).getItem(0)
    stops = F.filter(parts, lambda x: x["word"].rlike(r"^[\p{L}º]+$"))
    return (
        documents.where(F.length("text") > 0)
        .select(F.coalesce("source", F.lit("")).alias("source"), F.explode(F.split("text", "\n")).alias("line"))
        .where(line.contains(" "))
        .select(F.explode(F.concat(F.array(ended), stops)).alias("r"))
        .groupBy("r.kind", "r.source", "r.word")
        .agg(F.count_if("r.yes").alias("n_yes"), F.count_if(~F.col("r.yes")).alias("n_no"))
    )


def document_states(documents: DataFrame) -> DataFrame:
    """(doc_id, source, state, word) of every document with text; an unknown source is empty.

    No filter on the state here: pushed below the columns it would run the automaton a second time.
    """
    return (
        documents.where(F.length("text") > 0)
        .select("doc_id", F.coalesce("source", F.lit("")).alias("source"), _state_udf("text").alias("s"))
        .select("doc_id", "source", "s.state", F.col("s.opener").alias("word"))
    )


def verdicts(states: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, source, evidence) of the truncated ones among ``document_states``, by the counts of ``baselines``."""
    lines = counts.where("kind = 'line'")
    of_source = lines.select("source", "word", F.col("n_yes").alias("own_yes"), F.col("n_no").alias("own_no"))
    overall = lines.groupBy("word").agg(F.sum("n_yes").alias("all_yes"), F.sum("n_no").alias("all_no"))
    short = counts.where((F.col("kind") == "stop") & (F.col("n_yes") >= STOPS) & (F.col("n_yes") > STOP_RATIO * F.col("n_no"))).select("word")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    evidence = (
        F.when(F.col("state") == "cut", "structure")
        .when(none("own_yes") > none("own_no"), "source baseline")
        .when(none("all_yes") > none("all_no"), "corpus baseline")
    )
    opened = states.where("state IN ('cut', 'open')").join(of_source, ["source", "word"], "left").join(overall, "word", "left")
    ended = states.where("state = 'complete' AND word <> ''").join(broadcast_if_small(short), "word", "left_semi").select("doc_id", "source", F.lit("abbreviation").alias("evidence"))
    found = opened.select("doc_id", "source", evidence.alias("evidence")).where("evidence IS NOT NULL").unionByName(ended)
    return found.groupBy("doc_id", "source").agg(F.min("evidence").alias("evidence"))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, evidence) of the documents that stop in mid-word or mid-sentence."""
    return verdicts(cut(document_states(documents)), cut(baselines(documents)))


def truncation_rates(documents: DataFrame) -> DataFrame:
    """Per source: documents with text, truncated ones and their rate; an unknown source is null."""
    states = cut(document_states(documents))
    base = states.where("state <> 'blank'").groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"))
    found = verdicts(states, cut(baselines(documents))).groupBy("source").agg(F.count("*").alias("n_truncated"))
    n = F.coalesce("n_truncated", F.lit(0).cast("bigint"))
    return base.join(found, "source", "left").select(
        F.when(F.col("source") != "", F.col("source")).alias("source"), "n_docs", n.alias("n_truncated"), (n / F.col("n_docs")).alias("rate")
    )
