"""Formulas written as text, compiled into Spark columns.

A cell of a formula is a number, a text, a date, a truth value or an error code. Each node of a formula is a few helper
columns, one for each kind of value that it can have and one for the error, of which exactly one is not null in a row; what
the schema rules out has no column. So kinds and errors stay typed in Catalyst, nothing runs in Python, and a node that is read
several times is computed once, in a projection of its own. Arguments that shape an expression (patterns, formats, units of
datedif) have to be constants.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import formulas as fx
from .values import as_text, collapse, detected_locale, fold, named, parse_date, parse_number, strip

#: The error codes, and the most signs and levels of a formula.
DIV0, NUM, VALUE, NA, REF, NAME = "#DIV/0!", "#NUM!", "#VALUE!", "#N/A", "#REF!", "#NAME?"
MOST_SIGNS, MOST_LEVELS = 2000, 64
_TOKEN = re.compile(r'\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|"(?P<text>(?:[^"]|"")*)"|\[(?P<column>(?:[^\]]|\]\])*)\]|(?P<name>[^\W\d][\w.]*)|(?P<op><>|<=|>=|[=<>&+\-*/^%(),]))')
_POWER = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}
KINDS = ("num", "text", "date", "bool")


class FormulaError(ValueError):
    """The text is no formula."""


@dataclass(frozen=True)
class Node:
    """kind: number, text, column, name, call (name and args) or an operator's sign, % and unary minus being `post%` and `pre-`."""

    kind: str
    value: object = None
    args: tuple[Node, ...] = ()


def parse(text: str) -> Node:
    """The tree of a formula, with or without a leading =."""
    if len(text) > MOST_SIGNS:
        raise FormulaError(f"more than {MOST_SIGNS} signs")
    tokens, at = [], 0
    text = text.strip().removeprefix("=").rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"not readable from {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take(op: str | None = None) -> tuple[str, str]:
        nonlocal place
        if op is not None and tokens[place] != ("op", op):
            raise FormulaError(f"{op} expected")
        place += 1
        return tokens[place - 1]

    def operand(level: int) -> Node:
        kind, said = take()
        if kind == "op" and said in "+-":
            inner = operand(deeper(level))
            return Node("pre-", None, (inner,)) if said == "-" else Node("pre+", None, (inner,))
        if kind == "number":
            node = Node("number", float(said))
        elif kind == "text":
            node = Node("text", said.replace('""', '"'))
        elif kind == "column":
            node = Node("column", said.replace("]]", "]"))
        elif kind == "name" and tokens[place] == ("op", "("):
            take()
            args: list[Node] = []
            while tokens[place] != ("op", ")"):
                if args:
                    take(",")
                args.append(whole(1, deeper(level)))
            take()
            node = Node("call", said.upper(), tuple(args))
        elif kind == "name":
            node = Node("name", said)
        elif (kind, said) == ("op", "("):
            node = whole(1, deeper(level))
            take(")")
        else:
            raise FormulaError("a value is missing")
        while tokens[place] == ("op", "%"):
            take()
            node = Node("post%", None, (node,))
        return node

    def whole(least: int, level: int) -> Node:
        node = operand(level)
        while tokens[place][0] == "op" and _POWER.get(tokens[place][1], 0) >= least:
            op = take()[1]
            node = Node(op, None, (node, whole(_POWER[op] + 1, deeper(level))))
        return node

    def deeper(level: int) -> int:
        if level >= MOST_LEVELS:
            raise FormulaError(f"more than {MOST_LEVELS} levels")
        return level + 1

    tree = whole(1, 0)
    if tokens[place][0] != "end":
        raise FormulaError(f"nothing expected from {tokens[place][1]!r} on")
    return tree


def references(tree: Node) -> list[str]:
    """The columns that a formula names, in order, each once."""
    own = [tree.value] if tree.kind in ("column", "name") else []
    return list(dict.fromkeys([*own, *[r for a in tree.args for r in references(a)]]))


@dataclass(frozen=True)
class Value:
    """What a node can be: a column for each kind, and err. direct: a column of the table; locale: how its texts write numbers."""

    num: Column | None = None
    text: Column | None = None
    date: Column | None = None
    bool: Column | None = None
    err: Column | None = None
    constant: object = None
    direct: bool = False
    blank_only: bool = False  # text is only there for nulls of a typed column
    locale: str = "us"

    def parts(self) -> dict[str, Column]:
        return {k: c for k in (*KINDS, "err") if (c := getattr(self, k)) is not None}


def _first(*columns: Column | None) -> Column | None:
    some = [c for c in columns if c is not None]
    return F.coalesce(*some) if len(some) > 1 else some[0] if some else None


def _code(when: Column, code: str) -> Column:
    return F.when(when, code)


def _blank(c: Column) -> Column:
    return strip(c) == ""


def _is(c: Column) -> Column:
    return c.isNotNull()


@dataclass
class Compiler:
    """Adds a formula's helper columns to df, a projection a node."""

    df: DataFrame
    order: str = "mdy"
    locales: dict[str, str] = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    made: int = 0

    def keep(self, v: Value) -> Value:
        """The value by way of helper columns; where it is an error, no other part is there."""
        v = self._held(v)
        if v.err is None or not any(k in v.parts() for k in KINDS):
            return v
        return self._held(replace(v, **{k: F.when(v.err.isNull(), c) for k, c in v.parts().items() if k != "err"}))

    def _held(self, v: Value) -> Value:
        names = {k: f"__f{self.made}_{k}" for k in v.parts()}
        self.made += 1
        self.df = self.df.withColumns({names[k]: c for k, c in v.parts().items()})
        return replace(v, **{k: F.col(n) for k, n in names.items()})

    # Readings of a value, each (column, own error), null and no error where the value itself is an error.
    def number(self, v: Value, blank: float | None = 0.0) -> tuple[Column, Column | None]:
        read, err = [], None
        if v.num is not None:
            read.append(v.num)
        if v.bool is not None:
            read.append(v.bool.cast("double"))
        if v.date is not None:
            read.append(fx.serial(v.date))
        if v.text is not None:
            if v.blank_only and blank is not None:
                read.append(F.when(_is(v.text), blank))
            else:
                t = self._held(Value(num=F.when(_blank(v.text), F.lit(blank).cast("double")).otherwise(parse_number(v.text, v.locale)), text=v.text))
                read.append(t.num)
                err = _code(_is(t.text) & t.num.isNull(), VALUE)
        return (_first(*read) if read else F.lit(None).cast("double")), err

    def words(self, v: Value) -> Column:
        out = [v.text, None if v.num is None else fx.shown_number(v.num), None if v.date is None else F.date_format(v.date, "yyyy-MM-dd"), None if v.bool is None else F.when(v.bool, "TRUE").when(~v.bool, "FALSE")]
        return _first(*out) if any(c is not None for c in out) else F.lit(None).cast("string")

    def day(self, v: Value) -> tuple[Column, Column | None]:
        read = [v.date]
        if v.text is not None:
            read.append(parse_date(v.text, self.order))
        if v.num is not None:
            read.append(F.when(v.num.between(-400000, 2958465), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(v.num).cast("int"))))
        d = _first(*read) if any(c is not None for c in read) else F.lit(None).cast("date")
        there = [c for k, c in v.parts().items() if k != "err"]
        return d, _code(reduce(Column.__or__, map(_is, there)) & d.isNull(), VALUE) if there else None

    def truth(self, v: Value) -> tuple[Column, Column | None]:
        read, err = [v.bool, None if v.num is None else v.num != 0], []
        if v.text is not None:
            t = F.upper(strip(v.text))
            said = F.when(t == "TRUE", True).when(t.isin("FALSE", ""), False)
            read.append(said)
            err.append(_code(_is(v.text) & said.isNull(), VALUE))
        if v.date is not None:
            err.append(_code(_is(v.date), VALUE))
        return (_first(*read) if any(c is not None for c in read) else F.lit(None).cast("boolean")), _first(*err)

    # Nodes.
    def value(self, tree: Node) -> Value:
        k = tree.kind
        if k == "number":
            return Value(num=F.lit(tree.value), constant=tree.value)
        if k == "text":
            return Value(text=F.lit(tree.value), constant=tree.value)
        if k in ("column", "name"):
            return self._reference(tree)
        if k == "call":
            return self.call(tree.value, tree.args)
        args = [self.value(a) for a in tree.args]
        if k in ("pre-", "pre+", "post%"):
            x, bad = self.number(args[0])
            if k != "post%" and isinstance(args[0].constant, float):
                return Value(num=F.lit(-args[0].constant if k == "pre-" else args[0].constant), constant=-args[0].constant if k == "pre-" else args[0].constant)
            return self.keep(Value(num={"pre-": -x, "pre+": x, "post%": x / 100}[k], err=_first(args[0].err, bad)))
        if k == "&":
            return self.keep(Value(text=F.concat(self.words(args[0]), self.words(args[1])), err=_first(args[0].err, args[1].err)))
        if k in "+-":
            return self._sum(*args, 1 if k == "+" else -1)
        if k in "*/^":
            (x, bad_x), (y, bad_y) = self.number(args[0]), self.number(args[1])
            h = self._held(Value(num=x, date=y))
            x, y = h.num, h.date
            zero = {"*": None, "/": _code(y == 0, DIV0), "^": _code((x == 0) & (y == 0), NUM), "": None}[k]
            zero = _first(zero, _code((x == 0) & (y < 0), DIV0)) if k == "^" else zero
            out = {"*": lambda: x * y, "/": lambda: F.try_divide(x, y), "^": lambda: F.pow(x, y)}[k]()
            return self._finite(out, _first(args[0].err, args[1].err, bad_x, bad_y, zero))
        return self._compared(*args, k)

    def _finite(self, x: Column, err: Column | None) -> Value:
        h = self._held(Value(num=x, err=err))
        return self.keep(Value(num=h.num, err=_first(h.err, _code(F.isnan(h.num) | (F.abs(h.num) == float("inf")), NUM))))

    def _reference(self, tree: Node) -> Value:
        if tree.kind == "name" and tree.value.upper() in ("TRUE", "FALSE"):
            return Value(bool=F.lit(tree.value.upper() == "TRUE"), constant=tree.value.upper() == "TRUE")
        same = [c for c in self.columns if c == tree.value] or [c for c in self.columns if c.strip().lower() == tree.value.strip().lower()]
        if not same:
            return Value(err=F.lit(REF if tree.kind == "column" else NAME))
        name, kind = same[0], self.df.schema[same[0]].dataType
        c = named(name)
        if isinstance(kind, T.StringType):
            if name not in self.locales:
                self.locales[name] = detected_locale(self.df, name)
            return Value(text=F.coalesce(c, F.lit("")), direct=True, locale=self.locales[name])
        none = F.when(c.isNull(), "")
        if isinstance(kind, T.BooleanType):
            return Value(bool=c, text=none, direct=True, blank_only=True)
        if isinstance(kind, T.NumericType):
            return Value(num=c.cast("double"), text=none, direct=True, blank_only=True)
        if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            return Value(date=c.cast("date"), text=none, direct=True, blank_only=True)
        return Value(text=as_text(c, kind), direct=True)

    def _sum(self, a: Value, b: Value, sign: int) -> Value:
        if a.date is None and b.date is None and (a.text is None or a.blank_only) and (b.text is None or b.blank_only):
            (x, _), (y, _) = self.number(a), self.number(b)
            return self._finite(x + y if sign > 0 else x - y, _first(a.err, b.err))
        sides = []
        for v in (a, b):
            n, _ = self.number(replace(v, date=None))
            d = _first(v.date, None if v.text is None or v.blank_only else parse_date(v.text, self.order))
            h = self._held(Value(num=n, date=F.when(n.isNull(), d) if d is not None else F.lit(None).cast("date")))
            sides.append((h.num, h.date))
        (x, dx), (y, dy) = sides
        moved = F.date_add(dx, (sign * F.floor(y)).cast("int"))
        moved = F.coalesce(moved, F.date_add(dy, F.floor(x).cast("int"))) if sign > 0 else moved
        n = F.coalesce(x + y, F.lit(None).cast("double")) if sign > 0 else F.coalesce(x - y, F.datediff(dx, dy).cast("double"))
        h = self._held(Value(num=n, date=moved, err=_first(a.err, b.err)))
        bad = F.when(h.num.isNull() & h.date.isNull(), VALUE).when(F.abs(h.num) == float("inf"), NUM).when(~F.year(h.date).between(1, 9999), NUM)
        return self.keep(Value(num=h.num, date=h.date, err=_first(h.err, bad)))

    def _compared(self, a: Value, b: Value, op: str) -> Value:
        sides = []
        for v in (a, b):
            typed = [v.num, None if v.date is None else fx.serial(v.date)]
            read = None if v.text is None or v.blank_only else parse_number(v.text, v.locale)
            day = _first(v.date, None if v.text is None or v.blank_only else parse_date(v.text, self.order))
            n = _first(*typed, read)
            rank = F.when(_is(v.text), 1) if v.text is not None else None
            rank = _first(rank, F.when(_is(v.bool), 2) if v.bool is not None else None, F.lit(0))
            said = F.lit(None).cast("string") if v.text is None else fold(strip(v.text))
            made = {"n": n if n is not None else F.lit(None).cast("double"), "d": day if day is not None else F.lit(None).cast("date"), "t": said, "r": rank, "b": F.lit(None).cast("int") if v.bool is None else v.bool.cast("int"), "is_day": F.lit(False) if v.date is None else _is(v.date)}
            self.df = self.df.withColumns({f"__f{self.made}_{k}": c for k, c in made.items()})
            sides.append({k: F.col(f"__f{self.made}_{k}") for k in made})
            self.made += 1
        x, y = sides
        sign = lambda p, q: F.when(p < q, -1).when(p > q, 1).when(p == q, 0)
        blank_x, blank_y = F.coalesce(x["t"] == "", F.lit(False)), F.coalesce(y["t"] == "", F.lit(False))
        truthful = (x["r"] == 2) | (y["r"] == 2)
        by_day, by_number = _is(x["d"]) & _is(y["d"]), _is(x["n"]) & _is(y["n"])
        s = F.when(~truthful & blank_x & blank_y, 0).when(~truthful & (blank_x | blank_y), F.lit(None)).when((x["is_day"] | y["is_day"]) & by_day, sign(x["d"], y["d"]))
        s = s.when(by_number, sign(x["n"], y["n"])).when(by_day, sign(x["d"], y["d"])).when(x["r"] != y["r"], sign(x["r"], y["r"])).when(x["r"] == 2, sign(x["b"], y["b"])).otherwise(sign(x["t"], y["t"]))
        h = self._held(Value(num=s, err=_first(a.err, b.err)))
        test = {"=": h.num == 0, "<>": h.num != 0, "<": h.num < 0, ">": h.num > 0, "<=": h.num <= 0, ">=": h.num >= 0}[op]
        return self.keep(Value(bool=F.coalesce(test, F.lit(op == "<>")), err=h.err))

    def chosen(self, cases: Iterable[tuple[Column, Value]], err: Column | None, last: Value) -> Value:
        """The value of the first case that holds, whatever its kind."""
        cases = list(cases)
        kinds = [k for k in (*KINDS, "err") if any(getattr(v, k) is not None for v in (*[v for _, v in cases], last))]

        def part(k: str) -> Column:
            none = F.lit(None).cast({"num": "double", "date": "date", "bool": "boolean"}.get(k, "string"))
            of = lambda v: none if getattr(v, k) is None else getattr(v, k)
            out = reduce(lambda w, c: w.when(c[0], of(c[1])), cases[1:], F.when(cases[0][0], of(cases[0][1])))
            return out.otherwise(of(last))

        parts = {k: part(k) for k in kinds}
        parts["err"] = _first(err, parts.get("err"))
        return self.keep(Value(**{k: c for k, c in parts.items() if c is not None}))

    def call(self, name: str, args: tuple[Node, ...]) -> Value:
        if name not in FUNCTIONS:
            return Value(err=F.lit(NAME))
        least, most, make = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise FormulaError(f"{name} takes {least} to {most} arguments")
        return make(self, name, args)


# Functions. Each gets the compiler and its arguments as trees.
def _if(c: Compiler, _: str, args: tuple[Node, ...]) -> Value:
    test = c.value(args[0])
    holds, bad = c.truth(test)
    h = c._held(Value(bool=holds, err=_first(test.err, bad)))
    then, other = c.value(args[1]), c.value(args[2]) if len(args) > 2 else Value(bool=F.lit(False))
    return c.chosen([(h.bool, then)], h.err, other)


def _ifs(c: Compiler, _: str, args: tuple[Node, ...]) -> Value:
    if len(args) % 2:
        raise FormulaError("IFS takes pairs")
    out = Value(err=F.lit(NA))
    for test, then in reversed(list(zip(args[::2], args[1::2], strict=True))):
        v = c.value(test)
        holds, bad = c.truth(v)
        h = c._held(Value(bool=holds, err=_first(v.err, bad)))
        out = c.chosen([(h.bool, c.value(then))] if h.err is None else [(_is(h.err), Value(err=h.err)), (h.bool, c.value(then))], None, out)
    return out


def _iferror(c: Compiler, _: str, args: tuple[Node, ...]) -> Value:
    v, other = c.value(args[0]), c.value(args[1])
    return v if v.err is None else c.chosen([(_is(v.err), other)], None, replace(v, err=None))


def _junction(c: Compiler, name: str, args: tuple[Node, ...]) -> Value:
    """AND and OR: the first argument that decides, or is an error, ends it."""
    truth, err = F.lit(name == "AND"), F.lit(None).cast("string")
    for a in reversed(args):
        v = c.value(a)
        holds, bad = c.truth(v)
        own = _first(v.err, bad, F.lit(None).cast("string"))
        h = c._held(Value(bool=holds, err=own, text=err, date=truth))
        goes_on = h.bool if name == "AND" else ~h.bool
        truth = F.when(_is(h.err), F.lit(None)).when(goes_on, h.date).otherwise(F.lit(name == "OR"))
        err = F.when(_is(h.err), h.err).when(goes_on, h.text)
    return c.keep(Value(bool=truth, err=err))


def _tested(c: Compiler, name: str, args: tuple[Node, ...]) -> Value:
    v = c.value(args[0])
    if name == "NOT":
        holds, bad = c.truth(v)
        return c.keep(Value(bool=~holds, err=_first(v.err, bad)))
    no = F.lit(False)
    if name == "ISBLANK":
        return c.keep(Value(bool=no if v.text is None else F.coalesce(_blank(v.text), no)))
    read = _first(None if v.num is None else _is(v.num), None)
    said = no if v.text is None or v.blank_only else F.coalesce(parse_number(v.text, v.locale).isNotNull(), no)
    return c.keep(Value(bool=said if read is None else read | said))


def _coalesce(c: Compiler, _: str, args: tuple[Node, ...]) -> Value:
    out = Value(text=F.lit(""))
    for a in reversed(args):
        v = c.value(a)
        there = [_is(getattr(v, k)) for k in ("num", "date", "bool", "err") if getattr(v, k) is not None]
        there += [] if v.text is None else [F.coalesce(~_blank(v.text), F.lit(False))]
        out = c.chosen([(reduce(Column.__or__, there), v)], None, out)
    return out


@dataclass
class _Args:
    """Arguments read in order; err gathers theirs."""

    c: Compiler
    trees: tuple[Node, ...]
    err: Column | None = None
    at: int = 0

    def next(self) -> Value | None:
        self.at += 1
        return self.c.value(self.trees[self.at - 1]) if self.at <= len(self.trees) else None

    def text(self) -> Column:
        v = self.next()
        self.err = _first(self.err, v.err)
        return self.c.words(v)

    def number(self, default: float | None = None) -> Column:
        v = self.next()
        if v is None:
            return F.lit(default)
        x, bad = self.c.number(v)
        self.err = _first(self.err, v.err, bad)
        return x

    def day(self) -> Column:
        v = self.next()
        d, bad = self.c.day(v)
        self.err = _first(self.err, v.err, bad)
        return d

    def constant(self, default: object = None) -> object:
        v = self.next()
        if v is None:
            return default
        if v.constant is None:
            raise FormulaError("a pattern, format, number of places or unit has to be a constant")
        return v.constant

    def held(self, *columns: Column) -> list[Column]:
        names = [f"__f{self.c.made}_{i}" for i in range(len(columns))]
        self.c.made += 1
        self.c.df = self.c.df.withColumns(dict(zip(names, columns, strict=True)))
        return [F.col(n) for n in names]


def _texts(kind: str, make: Callable[[_Args], tuple[Column, Column | None]]):
    """A function of texts and numbers: make gives the result, of a kind, and an error of its own."""

    def of(c: Compiler, _: str, trees: tuple[Node, ...]) -> Value:
        args = _Args(c, trees)
        out, own = make(args)
        return c.keep(Value(**{kind: out}, err=_first(args.err, own)))

    return of


def _whole(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")


def _left(a: _Args) -> tuple[Column, Column | None]:
    t, n = a.held(a.text(), _whole(a.number(1.0)))
    return F.substring(t, F.lit(1), n), _code(n < 0, VALUE)


def _right(a: _Args) -> tuple[Column, Column | None]:
    t, n = a.held(a.text(), _whole(a.number(1.0)))
    return F.substring(t, F.greatest(F.char_length(t) - n, F.lit(0)) + 1, F.char_length(t)), _code(n < 0, VALUE)


def _mid(a: _Args) -> tuple[Column, Column | None]:
    t, at, n = a.held(a.text(), _whole(a.number()), _whole(a.number()))
    return F.substring(t, at, n), _code((at < 1) | (n < 0), VALUE)


def _replace(a: _Args) -> tuple[Column, Column | None]:
    t, at, n, new = a.held(a.text(), _whole(a.number()), _whole(a.number()), a.text())
    return F.concat(F.substring(t, F.lit(1), at - 1), new, F.substring(t, at + n, F.char_length(t))), _code((at < 1) | (n < 0), VALUE)


def _substitute(a: _Args) -> tuple[Column, Column | None]:
    t, old, new = a.held(a.text(), a.text(), a.text())
    whole = F.when(old == "", t).otherwise(F.replace(t, old, new))
    if len(a.trees) < 4:
        return whole, None
    (n,) = a.held(_whole(a.number()))
    pieces = F.split(t, F.concat(F.lit("\\Q"), old, F.lit("\\E")), -1)
    some = F.concat(F.array_join(F.slice(pieces, F.lit(1), n), "\x00"), new, F.array_join(F.slice(pieces, n + 1, F.size(pieces)), "\x00"))
    return F.when((old == "") | (F.size(pieces) <= n) | (n < 1), t).otherwise(F.replace(some, F.lit("\x00"), old)), _code(n < 1, VALUE)


def _find(folded: bool):
    def make(a: _Args) -> tuple[Column, Column | None]:
        part, t = a.text(), a.text()
        (part, t) = a.held(fold(part), fold(t)) if folded else a.held(part, t)
        (start,) = a.held(_whole(a.number(1.0)))
        at = F.expr("0").cast("int") + F.call_function("locate", part, t, start)
        at = F.when(part == "", start).otherwise(at)
        return at.cast("double"), _code((at < 1) | (start < 1) | (start > F.char_length(t) + 1), VALUE)

    return make


def _folded(test: str):
    return lambda a: ((lambda t, p: (getattr(t, test)(p), None))(*a.held(fold(a.text()), fold(a.text()))))


def _concat(a: _Args) -> tuple[Column, Column | None]:
    return F.concat(*[a.text() for _ in a.trees]), None


def _textjoin(c: Compiler, _: str, trees: tuple[Node, ...]) -> Value:
    a = _Args(c, trees)
    joiner = a.text()
    skip = a.next()
    holds, bad = c.truth(skip)
    a.err = _first(a.err, skip.err, bad)
    texts = F.array(*[a.text() for _ in trees[2:]])
    joined = F.when(holds, F.filter(texts, lambda t: ~_blank(t))).otherwise(texts)
    return c.keep(Value(text=_joined(joined, joiner), err=a.err))


def _joined(texts: Column, joiner: Column) -> Column:
    return F.aggregate(texts, F.lit(None).cast("string"), lambda a, t: F.when(a.isNull(), t).otherwise(F.concat(a, joiner, t)), lambda a: F.coalesce(a, F.lit("")))


def _value(c: Compiler, _: str, trees: tuple[Node, ...]) -> Value:
    v = c.value(trees[0])
    x, bad = c.number(v, None)
    if v.text is None:
        return c.keep(Value(num=x, err=_first(v.err, bad)))
    h = c._held(Value(num=F.coalesce(x, fx.serial(parse_date(v.text, c.order))), text=v.text, err=v.err))
    return c.keep(Value(num=h.num, err=_first(h.err, _code(_is(h.text) & h.num.isNull(), VALUE))))


def _text(c: Compiler, _: str, trees: tuple[Node, ...]) -> Value:
    v, pattern = c.value(trees[0]), c.value(trees[1]).constant
    if not isinstance(pattern, str):
        raise FormulaError("the format has to be a constant text")
    try:
        fx.text(F.lit(None), pattern)
    except ValueError:
        return c.keep(Value(text=F.lit(None).cast("string"), err=_first(v.err, F.lit(VALUE))))
    dated = any(m[3] for m in fx._TOKEN.finditer(pattern))
    h = c._held(replace(v, constant=None))
    if dated:
        d, _bad = c.day(h)
        out = F.when(_is(d), fx.text(d, pattern))
    else:
        typed = [h.num, None if h.date is None else fx.serial(h.date), None if h.text is None or h.blank_only else parse_number(h.text, h.locale)]
        x = _first(*typed) if any(t is not None for t in typed) else F.lit(None).cast("double")
        out = F.when(_is(x), fx.text(x, pattern))
    return c.keep(Value(text=F.coalesce(out, c.words(h)), err=v.err))


def _rounded(make: Callable[[Column, int], Column]):
    def of(a: _Args) -> tuple[Column, Column | None]:
        x = a.number()
        return make(x, int(a.constant(0.0))), None

    return of


def _row(name: str):
    """SUM, AVERAGE, MIN, MAX: cells of columns that are no numbers are left out, other texts have to be ones."""

    def of(c: Compiler, _: str, trees: tuple[Node, ...]) -> Value:
        read, err = [], None
        for v in map(c.value, trees):
            if v.direct and v.text is not None:
                some = _first(v.num, None if v.date is None else fx.serial(v.date), None if v.blank_only else parse_number(v.text, v.locale))
                read.append(some if some is not None else F.lit(None).cast("double"))
                err = _first(err, v.err)
            else:
                x, bad = c.number(v)
                read.append(x)
                err = _first(err, v.err, bad)
        h = c._held(Value(num=fx._numbers(tuple(read)), err=err))
        total = F.aggregate(h.num, F.lit(0.0), lambda a, x: a + x)
        if name == "AVERAGE":
            return c.keep(Value(num=F.try_divide(total, F.size(h.num)), err=_first(h.err, _code(F.size(h.num) == 0, DIV0))))
        least = {"MIN": F.array_min, "MAX": F.array_max}
        return c._finite(total if name == "SUM" else F.coalesce(least[name](h.num), F.lit(0.0)), h.err)

    return of


def _mod(a: _Args) -> tuple[Column, Column | None]:
    p, q = a.held(a.number(), a.number())
    return p - q * F.floor(F.try_divide(p, q)), _code(q == 0, DIV0)


def _date(a: _Args) -> tuple[Column, Column | None]:
    y, m, d = a.held(_whole(a.number()), _whole(a.number()), _whole(a.number()))
    first = F.add_months(F.lit("2000-01-01").cast("date"), (y - 2000) * 12 + m - 1)
    fine = y.between(1, 9999) & F.abs(m).between(0, 120000) & F.abs(d).between(0, 3660000)
    (made,) = a.held(F.when(fine, F.date_add(first, d - 1)))
    return made, _code((F.year(made) > 9999) | (F.year(made) < 1) | made.isNull(), NUM)


def _weekday(a: _Args) -> tuple[Column, Column | None]:
    d, kind = a.held(a.day(), _whole(a.number(1.0)))
    n = F.when(kind == 1, F.dayofweek(d)).when(kind == 2, F.weekday(d) + 1).when(kind == 3, F.weekday(d))
    return n.cast("double"), _code(_is(kind) & ~kind.isin(1, 2, 3), NUM)


def _datedif(a: _Args) -> tuple[Column, Column | None]:
    start, end = a.held(a.day(), a.day())
    unit = str(a.constant()).upper()
    if unit not in ("D", "M", "Y", "YM", "MD", "YD"):
        return F.lit(None).cast("double"), _code(_is(start) & _is(end), NUM)
    return fx.datedif(start, end, unit).cast("double"), _code(start > end, NUM)


def _edate(a: _Args) -> tuple[Column, Column | None]:
    d, n = a.held(a.day(), _whole(a.number()))
    return F.when(F.abs(n) < 120000, F.add_months(d, n)), _code(F.abs(n) >= 120000, NUM)


def _regex(name: str):
    def of(c: Compiler, _: str, trees: tuple[Node, ...]) -> Value:
        a = _Args(c, trees)
        (t,) = a.held(a.text())
        pattern, new = str(a.constant()), str(a.constant()) if name == "REGEXREPLACE" else ""
        flags = str(a.constant(""))
        try:
            if set(flags) - set("ims"):
                raise ValueError("no such flag")
            out = {"REGEXMATCH": lambda: fx.regexmatch(t, pattern, flags), "REGEXEXTRACT": lambda: fx.regexextract(t, pattern, flags), "REGEXREPLACE": lambda: fx.regexreplace(t, pattern, new, flags)}[name]()
        except ValueError:
            return c.keep(Value(text=F.lit(None).cast("string"), err=_first(a.err, F.lit(VALUE))))
        if name == "REGEXMATCH":
            return c.keep(Value(bool=out, err=a.err))
        (out,) = a.held(out)
        return c.keep(Value(text=out, err=_first(a.err, _code(_is(t) & out.isNull(), NA))))

    return of


def _plain(kind: str, *reads: Callable[[_Args], Column], of: Callable[..., Column]):
    return _texts(kind, lambda a: (of(*[r(a) for r in reads]), None))


_T, _N, _D = _Args.text, _Args.number, _Args.day
_MANY = 255
FUNCTIONS: dict[str, tuple[int, int, Callable[[Compiler, str, tuple[Node, ...]], Value]]] = {
    "IF": (2, 3, _if), "IFS": (2, _MANY, _ifs), "IFERROR": (2, 2, _iferror), "AND": (1, _MANY, _junction), "OR": (1, _MANY, _junction), "NOT": (1, 1, _tested), "ISBLANK": (1, 1, _tested), "ISNUMBER": (1, 1, _tested), "COALESCE": (1, _MANY, _coalesce),
    "LEN": (1, 1, _plain("num", _T, of=lambda t: F.char_length(t).cast("double"))), "LEFT": (1, 2, _texts("text", _left)), "RIGHT": (1, 2, _texts("text", _right)), "MID": (3, 3, _texts("text", _mid)),
    "UPPER": (1, 1, _plain("text", _T, of=F.upper)), "LOWER": (1, 1, _plain("text", _T, of=F.lower)), "PROPER": (1, 1, _plain("text", _T, of=lambda t: _proper(t))), "TRIM": (1, 1, _plain("text", _T, of=collapse)),
    "CONCAT": (1, _MANY, _texts("text", _concat)), "TEXTJOIN": (3, _MANY, _textjoin), "SUBSTITUTE": (3, 4, _texts("text", _substitute)), "REPLACE": (4, 4, _texts("text", _replace)), "FIND": (2, 3, _texts("num", _find(False))), "SEARCH": (2, 3, _texts("num", _find(True))),
    "CONTAINS": (2, 2, _texts("bool", _folded("contains"))), "STARTSWITH": (2, 2, _texts("bool", _folded("startswith"))), "ENDSWITH": (2, 2, _texts("bool", _folded("endswith"))), "VALUE": (1, 1, _value), "TEXT": (2, 2, _text),
    "ROUND": (1, 2, _texts("num", _rounded(fx.round_))), "ROUNDUP": (1, 2, _texts("num", _rounded(fx.roundup))), "ROUNDDOWN": (1, 2, _texts("num", _rounded(fx.rounddown))), "ABS": (1, 1, _plain("num", _N, of=F.abs)), "INT": (1, 1, _plain("num", _N, of=lambda x: F.floor(x).cast("double"))),
    "MOD": (2, 2, _texts("num", _mod)), "SUM": (1, _MANY, _row("SUM")), "AVERAGE": (1, _MANY, _row("AVERAGE")), "MIN": (1, _MANY, _row("MIN")), "MAX": (1, _MANY, _row("MAX")),
    "DATE": (3, 3, _texts("date", _date)), "YEAR": (1, 1, _plain("num", _D, of=lambda d: F.year(d).cast("double"))), "MONTH": (1, 1, _plain("num", _D, of=lambda d: F.month(d).cast("double"))), "DAY": (1, 1, _plain("num", _D, of=lambda d: F.dayofmonth(d).cast("double"))),
    "WEEKDAY": (1, 2, _texts("num", _weekday)), "DATEDIF": (3, 3, _texts("num", _datedif)), "EDATE": (2, 2, _texts("date", _edate)),
    "REGEXMATCH": (2, 3, _regex("REGEXMATCH")), "REGEXEXTRACT": (2, 3, _regex("REGEXEXTRACT")), "REGEXREPLACE": (3, 4, _regex("REGEXREPLACE")),
}


def _proper(t: Column) -> Column:
    """The first letter of each run of letters up, the others down."""
    parts = F.regexp_extract_all(F.lower(t), F.lit(r"(\P{L}*\p{L}*)"), F.lit(1))
    head = lambda p: F.regexp_extract(p, r"^\P{L}*", 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(head(p), F.upper(F.substring(p, F.char_length(head(p)) + 1, F.lit(1))), F.substring(p, F.char_length(head(p)) + 2, F.char_length(p)))), "")


def evaluated(df: DataFrame, text: str, name: str = "__formula", order: str = "mdy", locales: dict[str, str] | None = None) -> DataFrame:
    """df with a column of struct<kind, number, text>: kind is number, text, date, bool or error; number its number (a date's serial day, 1 or 0); text what it shows, an error's code for one.

    Columns are named [so] or bare, whatever their case; nulls are blanks. FormulaError where the text is no formula.
    """
    shown = tuple(c for c in df.columns if not c.startswith("__"))
    c = Compiler(df, order, dict(locales or {}), shown)
    v = c.value(parse(text))
    kind = [F.when(_is(p), k) for k, p in (("number", v.num), ("date", v.date), ("bool", v.bool), ("text", v.text), ("error", v.err)) if p is not None]
    number = _first(v.num, None if v.date is None else fx.serial(v.date), None if v.bool is None else v.bool.cast("double"), F.lit(None).cast("double"))
    said = _first(v.err, c.words(v))
    out = F.struct(F.coalesce(*kind).alias("kind"), number.alias("number"), said.alias("text"))
    return c.df.select(*[named(x) for x in df.columns], out.alias(name))


def holds(df: DataFrame, text: str, order: str = "mdy") -> DataFrame:
    """The rows for which the formula's value counts as true; errors, and texts that say neither true nor false, don't."""
    f = F.col("__formula")
    true = ((f["kind"] != "text") & (f["kind"] != "error") & (f["kind"] != "date") & (f["number"] != 0)) | ((f["kind"] == "text") & (F.upper(strip(f["text"])) == "TRUE"))
    return evaluated(df, text, order=order).where(true).drop("__formula")
