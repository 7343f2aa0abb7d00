"""Two dialects of one query text: Spark SQL, and the SQL it is compared with.

A query is a function of a dialect; only functions that the engines spell differently go through it.  In Spark texts
``{table}`` stands for a table of the folder, so braces of patterns are doubled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

# Months by name, for dates in words.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
# Currencies by the patterns that name them in plain text.
CURRENCIES = (("BRL", r"r\$|\bbrl\b|\breais\b|\breal\b"), ("USD", r"us\$|\busd\b|\bdolares\b"), ("EUR", r"€|\beur\b|\beuros?\b"), ("GBP", r"£|\bgbp\b"))
# Letters that lose their accent.
ACCENTED, BARE = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ", "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def pick(self, spark: str, duck: str) -> str:
        return spark if self.spark else duck

    def t(self, table: str) -> str:
        return self.pick("{" + table + "}", table)

    def re(self, pattern: str) -> str:
        """A pattern as a string literal."""
        body = pattern.replace("'", "''") if not self.spark else pattern.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}")
        return f"'{body}'"

    def matches(self, x: str, pattern: str) -> str:
        return self.pick(f"({x} RLIKE {self.re(pattern)})", f"regexp_matches({x}, {self.re(pattern)})")

    def sub(self, x: str, pattern: str, by: str) -> str:
        """All matches replaced; ``$1`` names a group."""
        return self.pick(f"regexp_replace({x}, {self.re(pattern)}, {self.re(by)})", f"regexp_replace({x}, {self.re(pattern)}, '{by.replace('$', chr(92))}', 'g')")

    def group(self, x: str, pattern: str, n: int = 1) -> str:
        return f"regexp_extract({x}, {self.re(pattern)}, {n})"

    def every(self, x: str, pattern: str, n: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, {n})"

    def each(self, items: str, var: str, body: str) -> str:
        return self.pick(f"transform({items}, {var} -> {body})", f"list_transform({items}, lambda {var}: {body})")

    def only(self, items: str, var: str, condition: str) -> str:
        return self.pick(f"filter({items}, {var} -> {condition})", f"list_filter({items}, lambda {var}: {condition})")

    def has(self, items: str, x: str) -> str:
        return self.pick(f"array_contains({items}, {x})", f"list_contains({items}, {x})")

    def size(self, items: str) -> str:
        return self.pick(f"size({items})", f"CAST(len({items}) AS INT)")

    def array(self, *items: str) -> str:
        return self.pick(f"array({', '.join(items)})", f"[{', '.join(items)}]")

    def at(self, items: str, k: int) -> str:
        return self.pick(f"element_at({items}, {k})", f"({items})[{k}]")

    def text(self, x: str) -> str:
        return f"CAST({x} AS {self.pick('STRING', 'VARCHAR')})"

    def sha(self, x: str) -> str:
        return self.pick(f"sha2({x}, 256)", f"sha256({x})")

    def joined(self, items: str, by: str) -> str:
        return self.pick(f"array_join({items}, '{by}')", f"array_to_string({items}, '{by}')")

    def sorted_set(self, x: str, by: str = "+", where: str | None = None) -> str:
        """The distinct values of a group, sorted and joined; empty where there is none."""
        x = f"CASE WHEN {where} THEN {x} END" if where else x
        return self.pick(f"array_join(array_sort(collect_set({x})), '{by}')", f"coalesce(array_to_string(list_sort(list_distinct(list({x}))), '{by}'), '')")

    def distinct_sorted(self, items: str) -> str:
        return self.pick(f"array_sort(array_distinct({items}))", f"list_sort(list_distinct({items}))")

    def lines(self, x: str) -> str:
        return self.pick(f"split({x}, '\\\\n')", f"string_split({x}, chr(10))")

    def days(self, later: str, earlier: str) -> str:
        return self.pick(f"datediff({later}, {earlier})", f"datediff('day', {earlier}, {later})")

    def explode(self, items: str) -> str:
        return self.pick(f"explode({items})", f"unnest({items})")

    def span(self, first: str, last: str) -> str:
        return self.pick(f"sequence({first}, {last})", f"range({first}, {last} + 1)")

    def n_if(self, condition: str) -> str:
        return f"CAST(coalesce(sum(CASE WHEN {condition} THEN 1 ELSE 0 END), 0) AS BIGINT)"

    # --- text
    def lower(self, x: str) -> str:
        return f"lower(replace({x}, 'ß', 'ss'))"

    def collapse(self, x: str) -> str:
        return f"trim({self.sub(x, r'\s+', ' ')})"

    def norm(self, x: str) -> str:
        return self.collapse(self.lower(x))

    def bare(self, x: str) -> str:
        return self.pick(f"translate({x}, '{ACCENTED}', '{BARE}')", f"strip_accents({x})")

    def fold(self, x: str) -> str:
        return self.collapse(self.bare(self.lower(x)))

    def words(self, x: str) -> str:
        """Plain words joined by single spaces."""
        return self.joined(self.every(self.bare(self.lower(x)), "[a-z0-9]+"), " ")

    # --- values
    def currency(self, folded: str) -> str:
        """The code of the only currency that a folded text names, else null."""
        count = " + ".join(f"(CASE WHEN {self.matches(folded, p)} THEN 1 ELSE 0 END)" for _, p in CURRENCIES)
        return f"CASE WHEN ({count}) <> 1 THEN NULL " + " ".join(f"WHEN {self.matches(folded, p)} THEN '{c}'" for c, p in CURRENCIES) + " END"

    def amount(self, raw: str) -> str:
        """One number in either notation; ambiguous forms are null."""
        body = self.sub(raw, "^[+-]", "")
        clean = (
            f"CASE WHEN {self.matches(body, r'^[0-9]+$')} THEN {body}"
            f" WHEN {self.matches(body, r'^[0-9]+[.,][0-9]{1,2}$')} THEN replace({body}, ',', '.')"
            f" WHEN {self.matches(body, r'^[0-9]{1,3}((\.[0-9]{3})+|(,[0-9]{3})+)$')} THEN {self.sub(body, '[.,]', '')}"
            f" WHEN {self.matches(body, r'^[0-9]{1,3}(\.[0-9]{3})+,[0-9]{1,2}$')} THEN replace(replace({body}, '.', ''), ',', '.')"
            f" WHEN {self.matches(body, r'^[0-9]{1,3}(,[0-9]{3})+\.[0-9]{1,2}$')} THEN replace({body}, ',', '') END"
        )
        return f"try_cast(concat(CASE WHEN {raw} LIKE '-%' THEN '-' ELSE '' END, {clean}) AS DECIMAL(38, 2))"

    def amounts(self, x: str) -> str:
        """All numbers of a text, in either notation."""
        if self.spark:
            raw = self.every(x, r"(?U)(?<![\w])[-+]?[0-9]+(?:[.,][0-9]+)*(?![\w])")
        else:  # no look-around here: separators are doubled so that each number has its own; a sign behind a word is one
            raw = self.every(self.sub(self.sub(x, r"([\p{L}\p{N}_])[-+]", "$1 "), r"([^\p{L}\p{N}_.,+-])", "$1$1"), r"(?:^|[^\p{L}\p{N}_])([-+]?[0-9]+(?:[.,][0-9]+)*)(?:$|[^\p{L}\p{N}_])", 1)
        return self.only(self.each(raw, "r", self.amount("r")), "v", "v IS NOT NULL")

    def date(self, folded: str) -> str:
        """A folded text that is a date: ISO, day first, or in words; else null."""
        day_first, words = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$", r"^([0-9]{1,2}) de ([a-z]+) de ([0-9]{4})$"
        month = f"CASE {self.group(folded, words, 2)} " + " ".join(f"WHEN '{m}' THEN '{k:02}'" for k, m in enumerate(MONTHS, 1)) + " END"
        made = lambda y, m, d: f"try_cast(concat({y}, '-', {m}, '-', lpad({d}, 2, '0')) AS DATE)"
        return (
            f"CASE WHEN {self.matches(folded, r'^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} THEN try_cast({folded} AS DATE)"
            f" WHEN {self.matches(folded, day_first)} THEN {made(self.group(folded, day_first, 3), f'lpad({self.group(folded, day_first, 2)}, 2, {chr(39)}0{chr(39)})', self.group(folded, day_first, 1))}"
            f" WHEN {self.matches(folded, words)} AND ({month}) IS NOT NULL THEN {made(self.group(folded, words, 3), month, self.group(folded, words, 1))} END"
        )

    def dates_in(self, folded: str) -> str:
        """The distinct dates that a folded text names, sorted."""
        found = [self.every(folded, p) for p in (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}", r"[0-9]{1,2} de [a-z]+ de [0-9]{4}")]
        return self.distinct_sorted(self.only(self.each(f"{self.pick('concat', 'list_concat')}({', '.join(found)})", "r", self.date("r")), "v", "v IS NOT NULL"))


SPARK, DUCK = Dialect(True), Dialect(False)


def entries(rows: Iterable[tuple[str, str, Callable[[Dialect], str]]]):
    """(name, what it does, Spark text, other text) of queries given as functions of a dialect."""
    return [(name, doc, build(SPARK), build(DUCK)) for name, doc, build in rows]
