"""Problem 1: variant spellings of names typed by people.

A name is read as proper words, a descriptor (line of business, activity or
given name) and a legal form.  Names alike in proper words and descriptor form
a *unit*; most variants - case, accents, legal form, order of the parts,
abbreviations, nicknames - end there.  The noisy channel links the rest: units
are candidates by how often they are written, and every unit is attached to the
unit with the highest posterior

    log(rows of the candidate) - log-cost of the typing errors - log-cost of an abbreviated descriptor

provided it is written at least as often.  Candidates meet through deletion
keys of their proper words, which names within ``MAX_ERRORS`` share, and tags of
their descriptors.  All units of a key are candidates: the most frequent one
gives each unit a lower bound of its posterior, and then only those meet that
are frequent enough to reach it, so a hot key does not square.  Chains of
attachments end in one canonical unit by pointer jumping.

Descriptors are learned: words in a fixed share of all distinct spellings of
the field that keep no company, as a descriptor stands with the proper words of
many entities and a proper word with the few of its own.  The number of such
words is bounded by words-per-name over the share, whatever the size of the data.

Defined results: null, empty and marker values are no names; spellings without
a proper word stand for themselves; words over ``MAX_WORD`` letters must be
equal; equal posteriors go to the first in
code-point order; repeated rows only raise the frequency.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from lavra.functions.matching import plain
from lavra.session import cut, spread

FIELDS = ("seguradora", "tomador_segurado")
#: Markers of a missing value.
MISSING = ("", "nao_localizado")
#: A learned descriptor stands in this share of the spellings, and in so many at least; beside so many other words at
#: least; and beside all of them but one in less than this share of its own spellings.
SHARE, LEAST, COMPANIONS, LOYAL = 0.008, 4, 8, 0.34
#: Letters of the longest word that may hold a typing error; longer ones only equal themselves.
MAX_WORD = 40
#: Typing errors that one name may differ by, and the log-odds each costs.
MAX_ERRORS, ERROR_COST = 2.0, 3.0

# Words that say no more than the legal form or join others.
LEGAL = "ltda limitada sociedade anonima sa eireli me epp cia"
PARTICLES = "de da do das dos del la e y"
# Lines of business that make different insurers of one proper name, by the words that tell them.
LINES = {"resseguro": "resseguradora resseguros ressegurador", "vida": "vida previdencia", "gerais": "gerais", "companhia": "companhia cia"}
LINE_FILLERS = "seguros seguradora seguro brasil br"
LINE_ABBREVIATIONS = {"seg": "", "segs": "", "segur": "", "resseg": "resseguro", "resseguro": "resseguro", "prev": "vida", "v": "vida", "ger": "gerais", "comp": "companhia", "cia": "companhia", "bras": ""}
# Activities known before any data, which tables too small to learn from need.
ACTIVITIES = "energia agropecuaria metalurgica industria quimica construtora participacoes tecnologia transportes engenharia distribuidora comercio alimentos hospitais"
# Nicknames and their given names.
NICKNAMES = {
    "paty": "patricia", "pati": "patricia", "vini": "vinicius", "beto": "roberto", "rafa": "rafael", "chico": "francisco", "dani": "daniela",
    "edu": "eduardo", "dudu": "eduardo", "ze": "jose", "quim": "joaquim", "tonho": "antonio", "toninho": "antonio", "tiao": "sebastiao",
    "bel": "isabel", "bela": "isabel", "gabi": "gabriela", "nanda": "fernanda", "fe": "fernanda", "cida": "aparecida", "lipe": "felipe",
    "juca": "jose", "chiquinho": "francisco", "tuca": "antonio", "malu": "maria", "nando": "fernando", "duda": "eduardo",
}

_SA = re.compile(r"(?<![a-z])s\s?[./]?\s?a\.?\s*(?=$|,)")
_TOKEN = re.compile(r"([a-z]+)(\.?)")


@lru_cache(maxsize=200_000)
def errors(a: str, b: str) -> int:
    """Typing errors between two words: changes, omissions, additions and swaps of neighbours."""
    if a == b:
        return 0
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1]


def _near(word: str, known, dotted: bool) -> str | None:
    """The known word that a word is, abbreviates or misspells."""
    if word in known:
        return word
    if dotted and len(word) > 1:
        full = [k for k in known if k.startswith(word)]
        if full:
            return min(full, key=lambda k: (len(k), k))
    room = 0 if len(word) < 4 else 1 if len(word) < 6 else 2
    signs = set(word)  # each error changes at most two signs of the set
    close = [(errors(word, k), k) for k in known if abs(len(k) - len(word)) <= room and len(k) > 3 and len(signs.symmetric_difference(k)) <= 2 * room]
    best = min(close, default=(9, ""))
    if best[0] <= room:
        return best[1]
    if dotted and len(word) > 3:  # an abbreviation with an error in it
        short = min(((errors(word, k[: len(word)]), k) for k in known if len(k) > len(word)), default=(9, ""))
        if short[0] <= 1:
            return short[1]
    return None


def read_insurer(name: str) -> tuple[list[str], str, str]:
    """(proper words, line of business, kind) of an insurer's name."""
    text = _SA.sub(" ", plain(name))
    words = {w: line for line, ws in LINES.items() for w in ws.split()}
    fillers = set(LINE_FILLERS.split())
    legal = {"sociedade", "anonima", "ltda", "limitada"}
    lines, proper = set(), []
    for word, dot in _TOKEN.findall(text):
        if word in PARTICLES.split():
            continue
        if word in LINE_ABBREVIATIONS:
            lines.add(LINE_ABBREVIATIONS[word])
            continue
        known = _near(word, [*words, *fillers, *legal], bool(dot))
        short = min(((errors(word, a), a) for a in LINE_ABBREVIATIONS if len(a) > 2), default=(9, "")) if dot else (9, "")
        if known in words:
            lines.add(words[known])
        elif known is None and short[0] <= len(short[1]) // 3:
            lines.add(LINE_ABBREVIATIONS[short[1]])
        elif known is None and len(word) == 3 and errors(word, "vida") == 1:
            lines.add("vida")
        elif known is None and len(word) > 1:
            cut_short = [k for k in ("resseguradora", "previdencia", "companhia") if len(word) > 4 and errors(word, k[: len(word)]) <= 1]
            if cut_short:
                lines.add(words[cut_short[0]])
            else:
                proper.append(word)
    lines.discard("")
    line = next((x for x in ("resseguro", "vida", "gerais", "companhia") if x in lines), "")
    return sorted(proper), line, "full" if line else "none"


def read_holder(name: str, activities: frozenset[str], given: frozenset[str]) -> tuple[list[str], str, str]:
    """(proper words, descriptor, kind) of a policyholder's name.

    Kinds: ``full``, ``initial`` (given name by its first letters) and ``none`` (two family names alone).
    """
    text = plain(name)
    firm = bool(_SA.search(text))
    text = _SA.sub(" ", text)
    legal = set(LEGAL.split())
    known_words = activities | given
    found, initials, proper = set(), "", []
    for word, dot in _TOKEN.findall(text):
        if word in PARTICLES.split() and not (len(word) == 1 and dot):
            continue
        if word in NICKNAMES and not dot and word not in known_words:
            found.add(NICKNAMES[word])
            continue
        if len(word) == 1:
            initials += word
            continue
        if _near(word, legal - {"cia", "sa", "me"}, False) or word in legal:
            firm = True
            continue
        known = _near(word, known_words, bool(dot))
        if known:
            found.add(known)
        else:
            proper.append(word)
    proper.sort()
    if found:
        return proper, " ".join(sorted(found)), "full"
    if initials and not firm:
        return proper, initials, "initial"
    return proper, "", "none"


def compatible(a: str, kind_a: str, b: str, kind_b: str, activities: frozenset[str]) -> float | None:
    """Log-cost of writing descriptor ``b`` as ``a``; None where they mean different things."""
    if kind_b != "full":
        return 0.0 if (a, kind_a) == (b, kind_b) else None
    if kind_a == "full":
        if a == b:
            return 0.0
        x, y = set(a.split()), set(b.split())
        return 1.0 if x < y else None
    words = set(b.split())
    if kind_a == "none":
        return 1.0 if words <= activities or not words & activities and not activities else None
    firsts = sorted(w[0] for w in words - activities)
    return 1.0 if firsts and all(ch in firsts for ch in a) else None


_READ = StructType([StructField("proper", ArrayType(StringType())), StructField("descriptor", StringType()), StructField("kind", StringType())])

_TAGS = StructType([StructField("offered", ArrayType(StringType())), StructField("asked", ArrayType(StringType()))])


def _reader(activities: frozenset[str], given: frozenset[str]):
    @F.pandas_udf(_READ)
    def read(fields: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [read_insurer(n) if f == "seguradora" else read_holder(n, activities, given) for f, n in zip(fields, names)]
        return pd.DataFrame(rows, columns=["proper", "descriptor", "kind"])

    return read


def spellings(extractions: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field_name, name, n): distinct names with their rows; markers and nulls are none."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("name")) for f in fields]))
    long = extractions.select("extraction_id", *fields).distinct().select(each.alias("f")).select("f.field_name", "f.name")
    return long.where(F.col("name").isNotNull() & ~F.trim("name").isin(*MISSING)).groupBy("field_name", "name").agg(F.count("*").alias("n"))


def learn_descriptors(names: DataFrame, share: float = SHARE, least: int = LEAST) -> tuple[frozenset[str], frozenset[str]]:
    """(activities, given names): those known before, and those learned from a field's spellings.

    A learned word is an activity where a third of its names carry a legal form.
    """

    @F.pandas_udf("struct<words:array<string>,legal:boolean>")
    def read(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            low = plain(text)
            legal = bool(_SA.search(low) or re.search(r"(?<![a-z])(?:ltda|limitada|sociedade)", low))
            return sorted({w for w, dot in _TOKEN.findall(_SA.sub(" ", low)) if not dot and len(w) > 2}), legal

        return pd.DataFrame([one(t) for t in texts], columns=["words", "legal"])

    total = names.count()
    silent = [*LEGAL.split(), *PARTICLES.split()]
    words = names.select(read("name").alias("r")).select(F.array_except("r.words", F.array(*map(F.lit, silent))).alias("words"), "r.legal")
    counts = words.select(F.explode("words").alias("word"), "legal").groupBy("word").agg(F.count("*").alias("k"), F.count_if("legal").alias("legal"))
    often = cut(counts.where(F.col("k") >= max(least, share * total)))  # at most (words per name) / share rows
    beside = words.select(F.explode("words").alias("word"), "words").join(F.broadcast(often), "word").select("word", "k", F.explode("words").alias("other")).where("word <> other")
    met = beside.groupBy("word", "k", "other").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "other"))
    second = met.withColumn("place", place).where("place = 2").select("word", F.col("n").alias("second"))
    many = met.groupBy("word").agg(F.count("*").alias("companions")).where(F.col("companions") >= COMPANIONS)
    rows = often.join(many, "word").join(second, "word").where(F.col("second") < LOYAL * F.col("k")).select("word", "k", "legal").collect()
    known = frozenset(NICKNAMES.values())
    activities = frozenset(r["word"] for r in rows if 3 * r["legal"] >= r["k"]) - known
    given = frozenset(r["word"] for r in rows if 3 * r["legal"] < r["k"]) - set(NICKNAMES) - set(ACTIVITIES.split())
    activities |= set(ACTIVITIES.split())
    return activities, (given | known) - activities


def _deletions(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) <= MAX_WORD else {word}


def _twice(word: str) -> set[str]:
    return {x for d in _deletions(word) for x in _deletions(d)} if len(word) <= MAX_WORD else {word}


def name_keys(words: list[str]) -> set[str]:
    """Deletion keys: two names of as many words share one where they differ by two errors at most, in one word or two."""
    n = len(words)
    if n < 2:
        return {x for w in words for x in _twice(w)}
    if n == 2:
        a, b = words
        keys = {"|".join(sorted((x, y))) for x in _deletions(a) for y in _deletions(b)}
        return keys | {f"={a}|{x}" for x in _twice(b)} | {f"={b}|{x}" for x in _twice(a)}
    if n > 5:  # of three parts one has no error
        at = [0, n // 3, 2 * n // 3, n]
        return {f"{n}:{k}|{' '.join(words[at[k] : at[k + 1]])}" for k in range(3)}
    keys = set()
    for i in range(n):
        keys |= {f"{i}|{x}|{' '.join(words[:i] + words[i + 1 :])}" for x in _twice(words[i])}
        for j in range(i + 1, n):
            rest = " ".join(words[:i] + words[i + 1 : j] + words[j + 1 :])
            keys |= {f"{i},{j}|{x}|{y}|{rest}" for x in _deletions(words[i]) for y in _deletions(words[j])}
    return keys


@F.pandas_udf(ArrayType(StringType()))
def _keys(propers: pd.Series) -> pd.Series:
    return propers.map(lambda proper: sorted(name_keys(proper.split(" "))))


def tags(descriptor: str, kind: str, activities: frozenset[str]) -> tuple[list[str], list[str]]:
    """(offered, asked): a unit may be attached only where one of the tags it asks for is offered; see ``compatible``.

    Tags of equal descriptors begin with an equals sign.
    """
    words, same = set(descriptor.split()), f"={kind}:{descriptor}"
    if kind != "full":
        return [same], [same, f"~{descriptor[0]}" if kind == "initial" else "!"]
    offered = [same, *(f"<{w}" for w in words if len(words) > 1), *{f"~{w[0]}" for w in words - activities}]
    return offered + ["!"] * (words <= activities or not activities), [same, f"<{min(words)}"]


def _tagger(activities: frozenset[str]):
    @F.pandas_udf(_TAGS)
    def tag(descriptors: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tags(d, k, activities) for d, k in zip(descriptors, kinds)], columns=["offered", "asked"])

    return tag


def _costs(activities: frozenset[str]):
    @F.pandas_udf(DoubleType())
    def cost(pv: pd.Series, dv: pd.Series, kv: pd.Series, pc: pd.Series, dc: pd.Series, kc: pd.Series) -> pd.Series:
        out = []
        for a, da, ka, b, db, kb in zip(pv, dv, kv, pc, dc, kc):
            a, b = a.split(" "), b.split(" ")
            c = compatible(da, ka, db, kb, activities)
            if c is None or len(a) != len(b):
                out.append(None)
                continue
            straight = sum(map(errors, a, b))
            crossed = sum(map(errors, a, b[::-1])) if len(a) == 2 else straight
            d = min(straight, crossed)
            short = min(len("".join(a)), len("".join(b)))
            out.append(c + ERROR_COST * d if d <= MAX_ERRORS and 3 * d <= short else None)
        return pd.Series(out, dtype="float64")

    return cost


def attachments(units: DataFrame, activities: frozenset[str]) -> DataFrame:
    """(field_name, unit, to): each unit with the one of highest posterior among all that share a key with it, if any does."""
    tagged = spread(units, "unit").withColumn("tags", _tagger(activities)("descriptor", "kind")).withColumn("key", F.explode(_keys("proper")))
    each = lambda c: tagged.select("field_name", "unit", "n", "key", F.explode(f"tags.{c}").alias("tag")).withColumn("h", F.xxhash64("key", "tag"))
    offered = each("offered").select("field_name", "h", F.col("unit").alias("c_unit"), F.col("n").alias("c_n"))
    # units of equal descriptors differ by an error, others at least in their descriptors
    asked = each("asked").select("field_name", "h", "unit", "n", F.when(F.col("tag").startswith("="), ERROR_COST).otherwise(1.0).alias("least"))
    tops = offered.groupBy("field_name", "h").agg(F.min_by("c_unit", F.struct(-F.col("c_n"), "c_unit")).alias("top"), F.max("c_n").alias("top_n"), F.count("*").alias("k"))
    # keys are many more than their small tables let Spark expect: hints keep it from a broadcast
    faced = cut(asked.join(tops.hint("merge"), ["field_name", "h"]).where("k > 1 or top <> unit"))
    first = cut(_scored(faced.select("field_name", "unit", "n", F.col("top").alias("c_unit"), F.col("top_n").alias("c_n")), activities))
    bounds = first.groupBy("field_name", "unit").agg(F.max("posterior").alias("bound"))
    # candidates less frequent than this can't reach the bound, or are no candidates of an equal descriptor
    reach = F.greatest(F.when(F.col("least") == ERROR_COST, F.col("n")).otherwise(F.lit(1)).cast("double"), F.coalesce(F.exp(F.col("bound") + F.col("least")) * (1 - 1e-9), F.lit(1.0)))
    open_ = faced.where("k > 1").join(bounds.hint("merge"), ["field_name", "unit"], "left").withColumn("reach", F.floor(reach)).where("reach <= top_n")
    level = lambda c: F.length(F.bin(F.col(c)))
    steps = open_.select("field_name", "h", "unit", "n", "reach", F.explode(F.sequence(level("reach"), level("top_n"))).alias("level"))
    met = steps.join(offered.withColumn("level", level("c_n")).hint("merge"), ["field_name", "h", "level"]).where("c_n >= reach")
    best = F.struct(-F.col("posterior"), -F.col("c_n"), "c_unit")
    return first.unionByName(_scored(met, activities)).groupBy("field_name", "unit").agg(F.min_by("c_unit", best).alias("to"))


def _scored(met: DataFrame, activities: frozenset[str]) -> DataFrame:
    """(field_name, unit, c_unit, c_n, posterior) of the pairs of units and candidates that may be one name."""
    part = lambda c, k: F.split(c, r"\|").getItem(k)
    older = (F.col("c_n") > F.col("n")) | ((F.col("c_n") == F.col("n")) & (F.col("c_unit") < F.col("unit")))
    differ = (part("unit", 1) != part("c_unit", 1)) | (part("unit", 2) != part("c_unit", 2))
    pairs = met.select("field_name", "unit", "n", "c_unit", "c_n").where((F.col("unit") != F.col("c_unit")) & (older | differ)).distinct()
    cost = _costs(activities)(*(part(c, k) for c in ("unit", "c_unit") for k in range(3)))
    found = pairs.withColumn("cost", cost).where(F.col("cost").isNotNull() & ~F.isnan("cost"))
    return found.select("field_name", "unit", "c_unit", "c_n", (F.log("c_n") - F.col("cost")).alias("posterior"))


def link_names(names: DataFrame) -> DataFrame:
    """(field_name, name, entity): each spelling with the canonical unit it is attached to."""
    names = cut(names)
    activities, given = learn_descriptors(names.where("field_name <> 'seguradora'"))
    read = spread(names, "name").withColumn("r", _reader(activities, given)("field_name", "name")).select("field_name", "name", "n", F.array_join("r.proper", " ").alias("proper"), "r.descriptor", "r.kind")
    # a name without a proper word is its own entity
    read = cut(read.withColumn("unit", F.when(F.col("proper") == "", F.concat(F.lit("?"), "name")).otherwise(F.concat_ws("|", "proper", "descriptor", "kind"))))
    units = read.where("proper <> ''").groupBy("field_name", "unit", "proper", "descriptor", "kind").agg(F.sum("n").alias("n"))
    links = cut(attachments(units, activities))
    while True:  # three rounds follow chains of eight attachments, the next three of 64
        for _ in range(3):
            next_ = links.select("field_name", F.col("unit").alias("to"), F.col("to").alias("far"))
            links = links.join(next_, ["field_name", "to"], "left").select("field_name", "unit", F.coalesce("far", "to").alias("to"))
        links = cut(links)
        if links.join(links.select("field_name", F.col("unit").alias("to")), ["field_name", "to"], "left_semi").isEmpty():
            break
    return read.join(links, ["field_name", "unit"], "left").select("field_name", "name", "n", F.coalesce("to", "unit").alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(field_name, name_a, name_b): all pairs of spellings of one entity, name_a first in code-point order."""
    other = linked.select("field_name", "entity", F.col("name").alias("name_b"))
    return linked.select("field_name", "entity", F.col("name").alias("name_a")).join(other, ["field_name", "entity"]).where("name_a < name_b").select("field_name", "name_a", "name_b")


def canonical_names(linked: DataFrame) -> DataFrame:
    """(field_name, name, canonical_name, n): each spelling with the most frequent one of its entity."""
    first = Window.partitionBy("field_name", "entity").orderBy(F.desc("n"), "name")
    return linked.select("field_name", "name", F.first("name").over(first).alias("canonical_name"), "n")
