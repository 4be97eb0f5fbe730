"""The search box: a line of text as a filter.

    paid -test "new york"              words and phrases anywhere, all of them, a - or NOT before what must not be there
    status:paid  status:=paid          a column contains, or is; != for is not; "" for blank
    amount>100  date:2025-01-01..2025-03-31  region:(emea|apac)  notes:/^ref \\d+$/i
    "order id":103  [order id]:103     names with blanks; case, blanks and underscores of a name don't matter
    (status:late OR region:us) -test   OR binds least; capitals only
    =[amount]*2 > 500                  a formula

Nothing fails: what reads as no column, number or pattern is searched for as it stands, or left out with a message in errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formula_text
from .dialect import translated
from .predicates import all_of, any_of, leaf
from .values import as_text, fold, named

MOST_LEVELS = 64
_FIELD = re.compile(r'(?:"(?P<quoted>[^"]+)"|\[(?P<boxed>[^\]]+)\]|(?P<bare>[^\s"()\[\]:=<>!/][^\s"():=<>!]*))(?P<op>:!=|:=|:|>=|<=|<>|!=|=|>|<)')
_VALUE = re.compile(r'"(?P<phrase>[^"]*)"|(?P<pattern>/(?:\\.|[^/\\\n])+/[imsu]*(?=[\s)]|$))|(?P<word>[^\s()]+)')
_OPS = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "=": "eq", "!=": "ne", "<>": "ne"}


@dataclass(frozen=True)
class Term:
    """One test: a column or *, and one of the comparisons of predicates.leaf; formula for a whole text that is one."""

    column: str
    op: str
    value: object = None
    value2: object = None
    case_sensitive: bool = False


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class Group:
    op: str
    children: tuple


@dataclass(frozen=True)
class Search:
    """tree: None if there is nothing to search for. errors: what was left out or read as plain text, and why."""

    tree: Term | Not | Group | None
    errors: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        """What is searched for anywhere, to be shown as found."""
        return [t.value for t in terms(self.tree) if t.column == "*" and t.op == "contains"]


def terms(tree) -> list[Term]:
    if tree is None:
        return []
    return [tree] if isinstance(tree, Term) else terms(tree.child) if isinstance(tree, Not) else [t for c in tree.children for t in terms(c)]


def column_of(name: str, columns: list[str]) -> str | None:
    """The column of a name: as it stands, or but for case, blanks and underscores."""
    key = lambda c: re.sub(r"[\s_]+", " ", c.strip().lower())
    return name if name in columns else next((c for c in columns if key(c) == key(name)), None)


def _joined(op: str, children: list):
    """One tree of several, groups of the same kind in one."""
    flat = [x for c in children if c is not None for x in (c.children if isinstance(c, Group) and c.op == op else (c,))]
    return None if not flat else flat[0] if len(flat) == 1 else Group(op, tuple(flat))


class _Reader:
    def __init__(self, text: str, columns: list[str]):
        self.text, self.columns, self.at, self.errors = text, columns, 0, []

    def blank(self) -> None:
        self.at += len(self.text[self.at :]) - len(self.text[self.at :].lstrip())

    def operator(self, word: str) -> bool:
        self.blank()
        if re.match(rf"{word}(?=[\s(\"]|$)", self.text[self.at :]):
            self.at += len(word)
            return True
        return False

    def either(self, level: int):
        out = [self.every(level)]
        while self.operator("OR"):
            out.append(self.every(level))
        return _joined("or", out)

    def every(self, level: int):
        out = []
        while True:
            self.operator("AND")
            self.blank()
            rest = self.text[self.at :]
            if not rest or rest[0] == ")" and level or re.match(r"OR(?=[\s(\"]|$)", rest):
                return _joined("and", out)
            out.append(self.negated(level))

    def negated(self, level: int):
        rest = self.text[self.at :]
        if re.match(r"-[^\s]", rest) or self.operator("NOT"):
            self.at += rest.startswith("-")
            self.blank()
            if self.at >= len(self.text):
                self.errors.append("nothing stands after NOT")
                return None
            child = self.negated(level) if level < MOST_LEVELS else self.word()
            return Not(child) if child is not None else None
        return self.atom(level)

    def atom(self, level: int):
        rest = self.text[self.at :]
        if rest[0] == "(" and level < MOST_LEVELS:
            self.at += 1
            inside = self.either(level + 1)
            if self.text[self.at : self.at + 1] == ")":
                self.at += 1
            else:
                self.errors.append("a bracket is not closed")
            return inside
        m = _FIELD.match(rest)
        name = m and (m["quoted"] or m["boxed"] or m["bare"])
        column = column_of(name, self.columns) if name else None
        if column is not None:
            start = self.at
            self.at += m.end()
            found = self.field(column, m["op"])
            if found is not None:
                return found
            self.at = start
        return self.word()

    def word(self):
        """A phrase, a pattern or plain text, anywhere."""
        m = _VALUE.match(self.text, self.at)
        if m is None or m["phrase"] is None and m[0].startswith('"'):
            self.errors.append("a quote is not closed" if self.text[self.at] == '"' else "a bracket is out of place")
            self.at += 1
            return None
        self.at = m.end()
        if m["pattern"]:
            return self.pattern("*", m["pattern"])
        return Term("*", "contains", m[0] if m["phrase"] is None else m["phrase"]) if m["phrase"] != "" else None

    def pattern(self, column: str, said: str):
        source, _, flags = said[1:].rpartition("/")
        try:
            translated(source, flags)
        except ValueError as e:
            self.errors.append(f"{said}: {e}")
            return Term(column, "contains", said)
        return Term(column, "matches", source)

    def field(self, column: str, op: str):
        """The test of a column; None if no value stands there."""
        rest = self.text[self.at :]
        if op == ":" and (m := re.match(r"\(([^()]*)\)", rest)):
            self.at += m.end()
            return Term(column, "in", tuple(v.strip().strip('"') for v in m[1].split("|")))
        m = _VALUE.match(rest)
        if m is None or (m["phrase"] is None and rest.startswith('"')):
            return None
        self.at += m.end()
        said = m[0] if m["phrase"] is None else m["phrase"]
        if op in (":=", ":!="):
            if m["phrase"] == "":
                return Term(column, "isEmpty" if op == ":=" else "isNotEmpty")
            return Term(column, "equals" if op == ":=" else "notEquals", said)
        if op != ":":
            if m["phrase"] == "" and op in ("=", "!=", "<>"):
                return Term(column, "isEmpty" if op == "=" else "isNotEmpty")
            return Term(column, _OPS[op], said)
        if m["pattern"]:
            return self.pattern(column, m["pattern"])
        ends = re.fullmatch(r"(.+?)\.\.(.+)", said) if m["phrase"] is None else None
        return Term(column, "between", ends[1], ends[2]) if ends else Term(column, "contains", said)


def parse(text: str, columns: list[str]) -> Search:
    """The tree of a search over columns; never fails."""
    if text.lstrip().startswith("="):
        try:
            formula_text.parse(text)
        except formula_text.FormulaError as e:
            return Search(None, (str(e),))
        return Search(Term("", "formula", text.strip()))
    r = _Reader(text, columns)
    tree = r.either(0)
    while r.at < len(text.rstrip()):  # a bracket too many
        r.errors.append("a bracket is out of place")
        r.at += 1
        tree = _joined("and", [tree, r.either(0)])
    return Search(tree, tuple(r.errors))


def condition(df: DataFrame, search: Search, errors: list[str] | None = None, strict: bool = False) -> Column | None:
    """The search as a Column that is never null; None if it has no tests. A test that can't be made of a column (no number, no date) is left out, and told in errors, or raised if strict is set."""

    def of(tree) -> Column | None:
        if isinstance(tree, Not):
            child = of(tree.child)
            return None if child is None else ~child
        if isinstance(tree, Group):
            some = [c for c in map(of, tree.children) if c is not None]
            return (any_of if tree.op == "or" else all_of)(*some) if some else None
        try:
            if tree.op == "in":
                return leaf(df, tree.column, "in", values=tree.value, case_sensitive=tree.case_sensitive)
            return leaf(df, tree.column, tree.op, tree.value, tree.value2, case_sensitive=tree.case_sensitive)
        except ValueError as e:
            if strict:
                raise
            if errors is not None:
                errors.append(str(e))
            return None

    return None if search.tree is None else of(search.tree)


def searched(df: DataFrame, text: str, errors: list[str] | None = None) -> DataFrame:
    """The rows that a search finds, all of them for an empty one. A formula's rows are those for which it is true."""
    search = parse(text, [c for c in df.columns if not c.startswith("__")])
    if errors is not None:
        errors += search.errors
    if isinstance(search.tree, Term) and search.tree.op == "formula":
        return formula_text.holds(df, text)
    found = condition(df, search, errors)
    return df if found is None else df.where(found)


def hits(df: DataFrame, search: Search) -> Column:
    """For each row, the columns in which a word of the search stands."""
    shown = [c for c in df.columns if not c.startswith("__")]
    words = [fold(F.lit(w)) for w in search.words]
    marks = [F.when(any_of(*[fold(as_text(named(c), df.schema[c].dataType)).contains(w) for w in words]) if words else F.lit(False), c) for c in shown]
    return F.array_compact(F.array(*marks))
