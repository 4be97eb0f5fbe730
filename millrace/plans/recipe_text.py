"""Recipes as text, a line a step.

Each step is declared once, as a template of words, slots and optional parts. Reading a line and writing it again both
follow the template, so what is written reads back as the same step. Steps run as the functions of millrace.operators,
which compose lazily; one that fails passes its input through and is reported.

    keep rows where "amount" > 100 and "region" in ("EMEA", "APAC")
    # a note
    #! sort by "amount" desc
    group by "region" calculate "count", "amount:sum"
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import functions as F

from millrace import operators as op
from millrace.functions import formula_text, transforms
from millrace.functions.predicates import COMPARED, row_text
from millrace.functions.search_text import Group, Not, Search, Term, condition, terms
from millrace.operators.frame import Frame

from . import insights, pipeline

#: The first line of a recipe; version 3 has trees of conditions or formulas. On reading, any maker's name may stand there.
HEADER = "# millrace recipe v{}"
MOST_LEVELS = 32
_TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<pattern>/(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])+/[a-z]*)|(?P<sign>->|<>|>=|<=|!=|==|[=<>,()*])|(?P<word>[^\s",()=<>*]+))')


class RecipeError(ValueError):
    """A line that is no step."""


@dataclass(frozen=True)
class Step:
    """op: a key of STEPS; args: by slot, None or False where an optional part is not there."""

    op: str
    args: dict
    muted: bool = False


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...]
    source: dict | None = None
    notes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def _tokens(line: str) -> list[Token]:
    out, at = [], 0
    while line[at:].strip():
        m = _TOKEN.match(line, at)
        if not m:
            out.append(Token("rest", line[at:].strip(), at, len(line)))  # only slots that take the rest of a line can read it
            break
        out.append(Token(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()))
        at = m.end()
    return out


class _Cursor:
    def __init__(self, line: str):
        self.line, self.tokens, self.at = line, _tokens(line), 0

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else Token("end", "", len(self.line), len(self.line))

    def fail(self, wanted: str) -> RecipeError:
        return RecipeError(f"{wanted} expected at {self.peek().text or 'the end'!r} of {self.line!r}")

    def sign(self, *signs: str) -> bool:
        if self.peek().kind == "sign" and self.peek().text in signs:
            self.at += 1
            return True
        return False

    def words(self, *words: str) -> bool:
        """Moves on if the next tokens are these words."""
        if all(self.peek(i).kind in ("word", "sign") and self.peek(i).text.lower() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def quoted(self) -> str:
        if self.peek().kind != "quoted":
            raise self.fail("a text in quotes")
        self.at += 1
        return json.loads(self.tokens[self.at - 1].text, strict=False)

    def value(self) -> str:
        if self.peek().kind == "word":
            self.at += 1
            return self.tokens[self.at - 1].text
        return self.quoted()

    def listed(self, one: Callable[[], object]) -> list:
        out = [one()]
        while self.sign(","):
            out.append(one())
        return out

    def rest(self) -> str:
        at, self.at = self.peek().start, len(self.tokens)
        return self.line[at:].strip()


def _q(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _qs(texts: Sequence[str] | str) -> str:
    return "*" if texts == "*" else ", ".join(map(_q, texts))


def _v(value: str) -> str:
    return value if re.fullmatch(r"-?\d+(\.\d+)?", value) else _q(value)


def _pattern(cursor: _Cursor) -> tuple[str, str]:
    if cursor.peek().kind != "pattern":
        raise cursor.fail("a pattern")
    cursor.at += 1
    source, _, flags = cursor.tokens[cursor.at - 1].text[1:].rpartition("/")
    return source, flags


def _say_pattern(p: tuple[str, str]) -> str:
    return f"/{re.sub(r'(?<!\\)((?:\\\\)*)/(?![^\[]*\])', r'\1\\/', p[0])}/{p[1]}"


# Conditions. Signs and words of comparisons; the first of a comparison is the one that is written.
_COMPARED = [("contains", "contains"), ("notContains", "does not contain"), ("wholeWord", "has word"), ("startsWith", "starts with"), ("endsWith", "ends with"), ("ne", "is not equal to"), ("eq", "is equal to"), ("in", "is one of"), ("isNotEmpty", "is not empty"), ("isEmpty", "is empty"), ("notEquals", "is not"), ("equals", "is"), ("equals", "="), ("equals", "=="), ("notEquals", "!="), ("notEquals", "<>"), ("gte", ">="), ("lte", "<="), ("gt", ">"), ("lt", "<"), ("lt", "before"), ("gt", "after"), ("between", "between"), ("in", "in"), ("matches", "matches"), ("matches", "regex")]
_SAID = {"in": "in"} | {k: w for k, w in reversed(_COMPARED) if k != "in"} | {"gt": ">", "lt": "<", "equals": "is", "notEquals": "is not", "matches": "matches"}


def _test(c: _Cursor) -> Term:
    if c.words("formula"):
        return Term("", "formula", _formula_of(c.rest()))
    column = "*" if c.words("any", "column") or c.words("*") else "@row" if c.words("row", "text") else c.quoted()
    found = next((k for k, w in _COMPARED if c.words(*w.split())), None)
    if found is None:
        raise c.fail("a comparison")
    if found == "matches":
        source, flags = _pattern(c)
        return Term(column, found, source, case_sensitive="i" not in flags)
    value = value2 = None
    if found == "in":
        boxed = c.sign("(")
        value = tuple(c.listed(c.value))
        if boxed and not c.sign(")"):
            raise c.fail(")")
    elif found not in ("isEmpty", "isNotEmpty"):
        value = c.value()
    if found == "between":
        if not (c.words("and") or c.words("to")):
            raise c.fail("and")
        value2 = c.value()
    return Term(column, found, value, value2, c.words("matchcase"))


def _tree(c: _Cursor, level: int = 0):
    """Tests joined by and or by or; both at one level need brackets."""
    if level > MOST_LEVELS:
        raise RecipeError("conditions are nested too deeply")

    def one():
        if c.words("not"):
            return Not(one())
        if c.sign("("):
            inside = _tree(c, level + 1)
            if not c.sign(")"):
                raise c.fail(")")
            return inside
        return _test(c)

    out, joiner = [one()], None
    while (word := "and" if c.words("and") else "or" if c.words("or") else None) is not None:
        if joiner not in (None, word):
            raise RecipeError("and and or are mixed; put brackets around one part")
        joiner = word
        out.append(one())
    return out[0] if len(out) == 1 else Group(joiner, tuple(out))


def _say_tree(tree, inside: bool = False) -> str:
    if isinstance(tree, Not):
        return f"not {_say_tree(tree.child, True)}"
    if isinstance(tree, Group):
        said = f" {tree.op} ".join(_say_tree(t, True) for t in tree.children)
        return f"({said})" if inside else said
    if tree.op == "formula":
        return f"formula {tree.value}"
    column = {"*": "any column", "@row": "row text"}.get(tree.column) or _q(tree.column)
    if tree.op == "matches":
        return f"{column} matches {_say_pattern((tree.value, '' if tree.case_sensitive else 'i'))}"
    value = {"in": lambda: f" ({', '.join(map(_v, tree.value))})", "between": lambda: f" {_v(tree.value)} and {_v(tree.value2)}"}.get(tree.op, lambda: "" if tree.value is None else f" {_v(tree.value)}")()
    return f"{column} {_SAID[tree.op]}{value}{' matchcase' if tree.case_sensitive else ''}"


def _formula_of(text: str) -> str:
    formula_text.parse(text)
    return text


def _sort_key(c: _Cursor) -> tuple[str, bool, str]:
    name = c.value()
    up = not c.words("desc")
    if up:
        c.words("asc")
    if c.words("as"):
        return name, up, c.value()
    return name, up, "auto"


def _one_word(*choices: str):
    def read(c: _Cursor) -> str:
        for w in choices or (c.peek().text.lower(),):
            if c.words(w):
                return w
        raise c.fail(" or ".join(choices) or "a word")

    return read, str


def _number(c: _Cursor) -> int:
    if not re.fullmatch(r"\d+", c.peek().text):
        raise c.fail("a number")
    c.at += 1
    return int(c.tokens[c.at - 1].text)


def _matched(c: _Cursor) -> tuple[str, str]:
    left = c.quoted()
    if not c.sign("="):
        raise c.fail("=")
    return left, c.quoted()


#: How the slots of templates are read and written.
SLOTS: dict[str, tuple[Callable[[_Cursor], object], Callable[[object], str]]] = {
    "name": (_Cursor.quoted, _q),
    "text": (_Cursor.quoted, _q),
    "names": (lambda c: "*" if c.sign("*") else c.listed(c.quoted), _qs),
    "find": (lambda c: _pattern(c) if c.peek().kind == "pattern" else c.quoted(), lambda v: _q(v) if isinstance(v, str) else _say_pattern(v)),
    "re": (_pattern, _say_pattern),
    "int": (_number, str),
    "ints": (lambda c: c.listed(lambda: _number(c)), lambda v: ",".join(map(str, v))),
    "words": (lambda c: c.listed(lambda: _one_word()[0](c)), ", ".join),
    "plain": (lambda c: c.listed(lambda: _one_word()[0](c)), ",".join),
    "what": (lambda c: _pattern(c) if c.peek().kind == "pattern" else _one_word("email", "phone", "url", "number", "date")[0](c), lambda v: v if isinstance(v, str) else _say_pattern(v)),
    "word": _one_word(),
    "keys": (lambda c: c.listed(lambda: _sort_key(c)), lambda v: ", ".join(f"{_q(n)} {'asc' if up else 'desc'}{'' if k == 'auto' else f' as {k}'}" for n, up, k in v)),
    "on": (lambda c: c.listed(lambda: _matched(c)), lambda v: ", ".join(f"{_q(a)} = {_q(b)}" for a, b in v)),
    "where": (_tree, _say_tree),
    "formula": (lambda c: _formula_of(c.rest()), str),
    "json": (lambda c: json.loads(c.rest()), lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))),
}
#: Slots whose values are columns.
_NAMES = {"name", "names", "keys"}


@dataclass(frozen=True)
class _Part:
    """A word, a slot, or an optional run of parts with a flag if it has no slot."""

    word: str = ""
    slot: str = ""
    kind: str = ""
    flag: str = ""
    parts: tuple[_Part, ...] = ()


def _template(text: str) -> tuple[_Part, ...]:
    """`words {slot:kind} {slot:a|b} [optional {slot:kind}] [flag: words]`."""
    out: list[_Part] = []
    for m in re.finditer(r"\[(?:(\w+): )?([^\]]*)\]|\{(\w+):([\w|-]+)\}|(\S+)", text):
        flag, inside, slot, kind, word = m.groups()
        if inside is not None:
            out.append(_Part(flag=flag or "", parts=_template(inside)))
        else:
            out.append(_Part(slot=slot or "", kind=kind or "", word=word or ""))
    return tuple(out)


def _slot(kind: str):
    return SLOTS[kind] if kind in SLOTS else _one_word(*kind.split("|"))


def _read(parts: Sequence[_Part], c: _Cursor, args: dict) -> None:
    for p in parts:
        if p.word:
            if not c.words(p.word):
                raise c.fail(p.word)
        elif p.slot:
            args[p.slot] = _slot(p.kind)[0](c)
        else:
            before, found = c.at, {}
            try:
                _read(p.parts, c, found)
                args |= {p.flag: True} if p.flag else found
            except RecipeError:
                c.at = before


def _write(parts: Sequence[_Part], args: Mapping) -> str:
    out = []
    for p in parts:
        if p.word:
            out.append(p.word)
        elif p.slot:
            out.append(_slot(p.kind)[1](args[p.slot]))
        elif (args.get(p.flag) if p.flag else all(args.get(x.slot) is not None for x in p.parts if x.slot)):
            out.append(_write(p.parts, args))
    return " ".join(out)


def _slots(parts: Sequence[_Part]) -> list[_Part]:
    return [s for p in parts for s in ([p] if p.slot else _slots(p.parts))]


Apply = Callable[[Frame, dict, Mapping[str, Frame]], Frame]


@dataclass(frozen=True)
class Kind:
    """templates: the first is the one that is written. apply: (frame, args, tables by name) to the step's result."""

    templates: tuple[tuple[_Part, ...], ...]
    apply: Apply
    columns: tuple[str, ...] = field(default=())


def _filtered(f: Frame, a: dict, _: Mapping) -> Frame:
    tree = a["where"]
    tests = terms(tree)
    if any(t.op == "formula" for t in tests):
        if not isinstance(tree, Term):
            raise ValueError("a formula is a condition of its own")
        made = formula_text.evaluated(f.df, tree.value, "__holds")
        x = F.col("__holds")
        yes = F.coalesce((x["kind"].isin("number", "bool") & (x["number"] != 0)) | (F.upper(x["text"]) == "TRUE"), F.lit(False))
        return f.with_df(made.where(yes if a["mode"] == "keep" else ~yes).drop("__holds"))
    missing = [t.column for t in tests if t.column not in ("*", "@row") and t.column not in f.columns]
    if missing:
        raise ValueError(f"no column {missing[0]!r}")
    rowed = any(t.column == "@row" for t in tests)
    df = f.df.withColumn("__row_text", row_text(f.df)) if rowed else f.df

    def placed(t):
        return Not(placed(t.child)) if isinstance(t, Not) else Group(t.op, tuple(map(placed, t.children))) if isinstance(t, Group) else replace(t, column="__row_text") if t.column == "@row" else t

    holds = condition(df, Search(placed(tree)), strict=True)
    return f.with_df(df.where(holds if a["mode"] == "keep" else ~holds).drop("__row_text"))


def _extract(f: Frame, a: dict, _: Mapping) -> Frame:
    what = {"preset": a["what"]} if isinstance(a["what"], str) else {"pattern": a["what"][0], "flags": a["what"][1]}
    return op.extract(f, a["column"], a["into"], every=bool(a.get("all")), **what)


def _replaced(f: Frame, a: dict, _: Mapping) -> Frame:
    regex = not isinstance(a["find"], str)
    find, case = (a["find"][0], "i" not in a["find"][1]) if regex else (a["find"], bool(a.get("matchcase")))
    return op.replace_text(f, a["columns"], find, a["new"], regex=regex, whole=bool(a.get("whole")), match_case=case)


def _cleaned(f: Frame, a: dict, _: Mapping) -> Frame:
    off = set(a.get("without") or ())
    return op.clean_text(f, a["columns"], **{k: k.replace("_", "-") not in off for k in ("nbsp", "zero_width", "quotes", "control", "nfc")})


def _converted(f: Frame, a: dict, _: Mapping) -> Frame:
    if a["to"] == "number":
        return op.convert_numbers(f, a["column"], a.get("locale") or "us", bool(a.get("fraction")))
    return op.normalize_dates(f, a["column"]) if a["to"] == "date" else op.rewrite(f, [a["column"]], lambda c: c)


def _split(f: Frame, a: dict, _: Mapping) -> Frame:
    return op.split_column(f, a["column"], a["on"], a.get("into") or (), a.get("max"), keep=not a.get("drop"))


def _structured(f: Frame, a: dict, _: Mapping) -> Frame:
    c, into, keep, how = a["column"], a.get("into") or (), bool(a.get("keep")), a["how"]
    if how == "whitespace-runs":
        return op.structure_spaces(f, c, into, keep=keep)
    if how == "character":
        return op.structure_delimited(f, c, a["sign"], into, keep=keep)
    if how == "fixed-width":
        return op.structure_fixed(f, c, a["cuts"], into, keep=keep)
    if how == "pattern":
        return op.structure_pattern(f, c, a["pattern"][0], into, keep=keep, flags=a["pattern"][1])
    separator = a.get("separator") or "="
    return op.structure_pairs(f, c, into or op.pair_names(f, c, separator), separator, keep=keep)


def _json(f: Frame, a: dict, _: Mapping) -> Frame:
    """All paths of the column, and _unparsed if some text is no JSON."""
    text = f.col(a["column"])
    bad = f.df.where(~f.blank(a["column"]) & F.try_parse_json(text).isNull()).limit(1).count() > 0
    return op.structure_json(f, a["column"], a.get("into"), keep=bool(a.get("keep")), unparsed=bad)


def _sorted(f: Frame, a: dict, _: Mapping) -> Frame:
    """A text column without a kind goes by what its first rows are."""
    open_ones = [n for n, _, k in a["keys"] if k == "auto"]
    kinds = insights.inferred(f.select(*open_ones)) if f.texts([n for n in open_ones if n in f.columns]) else {}
    return op.sort_rows(f, *[(n, up, kinds[n][0] if n in kinds and f.texts([n]) else k) for n, up, k in a["keys"]])


def _aggregated(f: Frame, a: dict, _: Mapping) -> Frame:
    metrics = [m if m == "count" else tuple(m.rsplit(":", 1)) for m in a["metrics"]]
    return op.aggregate(f, a["by"], metrics)


def _named_table(refs: Mapping[str, Frame], name: str) -> Frame:
    if name not in refs:
        raise ValueError(f"no table {name!r}")
    return refs[name]


def _joined(f: Frame, a: dict, refs: Mapping) -> Frame:
    how = set(a.get("normalize") or ())
    out = op.join(f, _named_table(refs, a["ref"]), a["on"], a["how"], a.get("bring"), a.get("duplicates") or "first", trimmed="trim" in how, folded="casefold" in how, numeric="numeric" in how)
    added = [c for c in out.columns if c not in f.columns and out.kind(c).typeName() == "string"]
    return out.rewritten({c: F.coalesce(out.col(c), F.lit("")) for c in added}) if added else out


def _compared(f: Frame, a: dict, refs: Mapping) -> Frame:
    columns = None if a["columns"] == "*" else a["columns"]
    return op.compare(f, _named_table(refs, a["ref"]), a["key"], columns, removed=bool(a.get("removed")), duplicates=a.get("duplicates") or "error")


def _formula(f: Frame, a: dict, _: Mapping) -> Frame:
    made = f.with_df(formula_text.evaluated(f.df, a["formula"], "__made"))
    out = op.add_column(made, a["name"], F.col("__made.text"), a.get("after"))
    return Frame(out.df.drop("__made"), out.order)


def _rows(f: Frame, a: dict, _: Mapping, keep: bool) -> Frame:
    """Rows by their place, from 0; allExcept turns the choice round."""
    ids, other = a["json"].get("rowIds", []), a["json"].get("mode") == "allExcept"
    listed = F.col("__pos").isin([i + 1 for i in ids])
    df = f.positioned()
    return f.with_df(df.where(listed if keep != other else ~listed).drop("__pos"))


def _overridden(f: Frame, a: dict, _: Mapping) -> Frame:
    column, cells = a["json"]["column"], {o["rowId"] + 1: o["value"] for o in a["json"]["overrides"]}
    table = f.df.sparkSession.createDataFrame([(k, v) for k, v in cells.items()], "__pos long, value string")
    out = op.override_cells(f.with_df(f.positioned()), column, table, "__pos")
    return Frame(out.df.drop("__pos"), out.order)


def _inferred(f: Frame, a: dict, _: Mapping) -> Frame:
    found = a["json"]["candidate"]
    change = (found["type"], *found.get("params", {}).values())
    return op.rewrite(f, [a["json"]["column"]], lambda c: F.coalesce(transforms.apply(change, c), c))


def _kind(apply: Apply, *templates: str) -> Kind:
    parts = tuple(map(_template, templates))
    return Kind(parts, apply, tuple(dict.fromkeys(s.slot for s in _slots(parts[0]) if s.kind in _NAMES)))


STEPS: dict[str, Kind] = {
    "filter_rows": _kind(_filtered, "{mode:keep|remove} rows where {where:where}"),
    "dedupe": _kind(lambda f, a, _: op.dedupe(f, a.get("on") or "*", bool(a.get("fold")), "last" if a.get("last") else "first"), "remove duplicates [by {on:names}] [fold: ignore case] [last: keep last]", "dedupe [by {on:names}] [fold: ignore case] [last: keep last]"),
    "drop_empty_rows": _kind(lambda f, a, _: op.drop_empty_rows(f, a.get("columns") or "*"), "remove empty rows [in {columns:names}]", "drop empty rows [in {columns:names}]"),
    "drop_empty_columns": _kind(lambda f, a, _: op.drop_empty_columns(f), "remove empty columns", "drop empty columns"),
    "remove_repeated_headers": _kind(lambda f, a, _: op.remove_repeated_headers(f), "remove repeated headers"),
    "skip_rows": _kind(lambda f, a, _: op.skip_rows(f, a["top"], a["bottom"]), "skip rows top {top:int} bottom {bottom:int}"),
    "promote_header": _kind(lambda f, a, _: op.promote_header(f, a["row"] - 1), "use row {row:int} as header"),
    "sort_rows": _kind(_sorted, "sort by {keys:keys}"),
    "split_to_rows": _kind(lambda f, a, _: op.split_to_rows(f, a["column"], a["on"], not a.get("spaces")), "split {column:name} on {on:text} into rows [spaces: keep spaces]"),
    "split_column": _kind(_split, "split {column:name} on {on:text} [into {into:names}] [max {max:int}] [drop: drop original]"),
    "structure_json": _kind(_json, "parse json in {column:name} [into {into:names}] [keep: keep original]"),
    "structure_fixed": _kind(_structured, "split {column:name} by {how:fixed-width} at {cuts:ints} [into {into:names}] [keep: keep original]"),
    "structure_pattern": _kind(_structured, "split {column:name} by {how:pattern} {pattern:re} [into {into:names}] [keep: keep original]"),
    "structure_pairs": _kind(_structured, "split {column:name} by {how:key-value|logfmt} [sep {separator:text}] [into {into:names}] [keep: keep original]"),
    "structure_character": _kind(_structured, "split {column:name} by {how:character} {sign:text} [into {into:names}] [keep: keep original]"),
    "structure_spaces": _kind(_structured, "split {column:name} by {how:whitespace-runs} [into {into:names}] [keep: keep original]"),
    "rename": _kind(lambda f, a, _: op.rename(f, a["column"], a["to"]), "rename {column:name} -> {to:text}", "rename {column:name} to {to:text}"),
    "drop_columns": _kind(lambda f, a, _: op.drop_columns(f, *a["columns"]), "delete columns {columns:names}", "drop columns {columns:names}"),
    "select_columns": _kind(lambda f, a, _: op.select_columns(f, *a["columns"]), "keep columns {columns:names}"),
    "duplicate_column": _kind(lambda f, a, _: op.duplicate_column(f, a["column"], a["name"]), "duplicate column {column:name} as {name:text}"),
    "reorder_columns": _kind(lambda f, a, _: op.reorder_columns(f, *a["columns"]), "order columns {columns:names}"),
    "merge_columns": _kind(lambda f, a, _: op.merge_columns(f, a["columns"], a["joiner"], a["into"], not a.get("blanks"), not a.get("drop")), "merge {columns:names} into {into:text} joined by {joiner:text} [blanks: keep blanks] [drop: drop originals]"),
    "extract": _kind(_extract, "extract {what:what} from {column:name} into {into:text} [all: all]"),
    "trim": _kind(lambda f, a, _: op.trim(f, a["columns"], not a.get("inner")), "trim {columns:names} [inner: keep inner]"),
    "clean_text": _kind(_cleaned, "clean text in {columns:names} [without {without:words}]"),
    "change_case": _kind(lambda f, a, _: op.change_case(f, a["columns"], a["style"]), "case {style:title|upper|lower|sentence} {columns:names}"),
    "replace_text": _kind(_replaced, "replace {find:find} with {new:text} in {columns:names} [whole: whole] [matchcase: matchcase]"),
    "normalize_dates": _kind(lambda f, a, _: op.normalize_dates(f, a["column"], a["style"]), "dates {column:name} -> {style:iso|us|eu|long|compact}", "normalize dates {column:name} -> {style:iso|us|eu|long|compact}"),
    "convert": _kind(_converted, "convert {column:name} to {to:number|date|text} [locale {locale:us|eu}] [fraction: percent-as-fraction]"),
    "fill_down": _kind(lambda f, a, _: op.fill_down(f, *(f.columns if a["columns"] == "*" else a["columns"])), "fill down {columns:names}"),
    "fill_blank": _kind(lambda f, a, _: op.fill_blank(f, a["columns"], a["value"]), "fill blank {columns:names} with {value:text}", "fill blanks {columns:names} with {value:text}"),
    "wide_to_long": _kind(lambda f, a, _: op.wide_to_long(f, a["ids"], a["columns"], *a["into"], bool(a.get("skip"))), "wide to long keep {ids:names} unpivot {columns:names} into {into:names} [skip: skip blanks]", "melt keep {ids:names} unpivot {columns:names} into {into:names} [skip: skip blanks]"),
    "long_to_wide": _kind(lambda f, a, _: op.long_to_wide(f, a["ids"], a["key"], a["value"], a.get("combine") or "error"), "long to wide {key:name} from {value:name} group by {ids:names} [combine {combine:word}]", "pivot {key:name} from {value:name} group by {ids:names} [combine {combine:word}]"),
    "aggregate": _kind(_aggregated, "group by {by:names} calculate {metrics:names}", "aggregate group by {by:names} calculate {metrics:names}"),
    "join": _kind(_joined, "join {ref:text} {how:left|inner|semi|anti} on {on:on} [normalize {normalize:plain}] [bring {bring:names}] [duplicates {duplicates:first|fanout}]"),
    "compare": _kind(_compared, "diff {ref:text} key {key:names} compare {columns:names} [removed: include-removed] [duplicates {duplicates:first}]", "compare with {ref:text} key {key:names} compare {columns:names} [removed: include-removed] [duplicates {duplicates:first}]"),
    "add_column": _kind(_formula, "add column {name:text} [after {after:name}] = {formula:formula}"),
    "remove_rows": _kind(partial(_rows, keep=False), "@remove-rows {json:json}"),
    "keep_rows": _kind(partial(_rows, keep=True), "@keep-rows {json:json}"),
    "override_cells": _kind(_overridden, "@override {json:json}"),
    "infer": _kind(_inferred, "@infer {json:json}"),
}


def parse_step(line: str) -> Step:
    """The step of a line; RecipeError says how far the best reading came."""
    muted, line = line.startswith("#!"), line.removeprefix("#!").strip()
    best: tuple[int, RecipeError] | None = None
    for name, kind in STEPS.items():
        for t in kind.templates:
            c, args = _Cursor(line), {}
            try:
                _read(t, c, args)
                if c.peek().kind != "end":
                    raise c.fail("the end")
                return Step(name, args, muted)
            except RecipeError as e:
                if best is None or c.at > best[0]:
                    best = c.at, e
    raise best[1]


def print_step(step: Step) -> str:
    return ("#! " if step.muted else "") + _write(STEPS[step.op].templates[0], step.args)


def parse(text: str) -> Recipe:
    """A recipe of lines. Blank lines and notes (#) are passed over, #! mutes a step, @source has where the data came from."""
    steps, source, notes = [], None, []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if line.startswith("@source "):
            source = json.loads(line.removeprefix("@source "))
        elif line.startswith("#") and not line.startswith("#!"):
            notes += [] if re.fullmatch(r"# \w+ recipe v[23]", line) else [line.removeprefix("#").strip()]
        elif line:
            try:
                steps.append(parse_step(line))
            except (RecipeError, formula_text.FormulaError, json.JSONDecodeError) as e:
                raise RecipeError(f"line {n}: {e}") from e
    return Recipe(tuple(steps), source, tuple(notes))


def to_text(recipe: Recipe) -> str:
    deep = any(s.op == "add_column" or any(t.op == "formula" for t in terms(s.args.get("where"))) or any(isinstance(x, Not | Group) for x in getattr(s.args.get("where"), "children", ())) or isinstance(s.args.get("where"), Not) for s in recipe.steps)
    source = [] if recipe.source is None else [f"@source {json.dumps(recipe.source, ensure_ascii=False, separators=(',', ':'))}"]
    return "\n".join([HEADER.format(3 if deep else 2), *source, *map(print_step, recipe.steps)])


def columns_of(step: Step) -> list[str]:
    """The columns that a step reads by name."""
    out: list[str] = []
    for slot in STEPS[step.op].columns:
        v = step.args.get(slot)
        out += [] if v is None or v == "*" or slot == "into" else [v] if isinstance(v, str) else [x[0] if isinstance(x, tuple) else x for x in v]
    out += [t.column for t in terms(step.args.get("where")) if t.column not in ("", "*", "@row")]
    out += [r for t in terms(step.args.get("where")) if t.op == "formula" for r in formula_text.references(formula_text.parse(t.value))]
    out += formula_text.references(formula_text.parse(step.args["formula"])) if "formula" in step.args else []
    out += [a for a, _ in step.args.get("on", []) if isinstance(step.args.get("on"), list)]
    return list(dict.fromkeys(out))


def remapped(step: Step, names: Mapping[str, str]) -> Step:
    """The step with columns under other names, formulas and conditions too."""
    new = lambda c: names.get(c, c)

    def tree(t):
        if isinstance(t, Not):
            return Not(tree(t.child))
        if isinstance(t, Group):
            return Group(t.op, tuple(map(tree, t.children)))
        return replace(t, value=formula(t.value)) if t.op == "formula" else replace(t, column=new(t.column))

    def formula(text: str) -> str:
        lowered = {k.lower(): v for k, v in names.items()}
        boxed = lambda c: "[" + c.replace("]", "]]") + "]"
        one = lambda m: m[0] if m[1] is None or m[1].replace("]]", "]").strip().lower() not in lowered else boxed(lowered[m[1].replace("]]", "]").strip().lower()])
        return re.sub(r'"(?:[^"]|"")*"|\[((?:[^\]]|\]\])*)\]', one, text)

    args = dict(step.args)
    for slot in STEPS[step.op].columns:
        v = args.get(slot)
        if v is not None and v != "*" and slot != "into":
            args[slot] = new(v) if isinstance(v, str) else [(new(x[0]), *x[1:]) if isinstance(x, tuple) else ":".join([new(x.rsplit(":", 1)[0]), *x.rsplit(":", 1)[1:]]) if slot == "metrics" else new(x) for x in v]
    if args.get("where") is not None:
        args["where"] = tree(args["where"])
    if "formula" in args:
        args["formula"] = formula(args["formula"])
    if isinstance(args.get("on"), list):
        args["on"] = [(new(a), b) for a, b in args["on"]]
    return replace(step, args=args)


#: Steps that run no job when they are built.
_LAZY = {"dedupe", "drop_empty_rows", "remove_repeated_headers", "split_to_rows", "structure_fixed", "structure_pattern", "rename", "drop_columns", "select_columns", "duplicate_column", "reorder_columns", "merge_columns", "extract", "trim", "clean_text", "change_case", "replace_text", "normalize_dates", "convert", "fill_blank", "wide_to_long"}


def _lazy(step: Step) -> bool:
    """Comparisons of text columns look for the column's number format, so conditions with one aren't lazy."""
    return step.op in _LAZY or (step.op == "filter_rows" and not any(t.op in (*COMPARED, "between", "formula") for t in terms(step.args["where"])))


def steps_of(recipe: Recipe | str, tables: Mapping[str, Frame] | None = None) -> list[pipeline.Step]:
    """The recipe's steps as functions, named by their places and lines."""
    recipe = parse(recipe) if isinstance(recipe, str) else recipe
    refs = tables or {}
    return [pipeline.Step(f"{k}: {print_step(replace(s, muted=False))}", lambda g, s=s: STEPS[s.op].apply(g, s.args, refs), s.muted, _lazy(s)) for k, s in enumerate(recipe.steps, 1)]


def run(f: Frame, recipe: Recipe | str, tables: Mapping[str, Frame] | None = None) -> pipeline.Outcome:
    """The recipe over a frame; tables has those that joins and comparisons name."""
    return pipeline.run(f, steps_of(recipe, tables))
