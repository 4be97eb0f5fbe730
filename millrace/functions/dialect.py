"""Patterns as people write them for the web, in the form that Spark's engine (java.util.regex) takes.

The two dialects share most of their syntax. What differs is rewritten token by token: names of groups, empty classes, dots
and line ends, white space beyond ASCII, word bounds, escapes that stand for themselves, lone braces, and signs that only one of
them reads inside a class. What can't be rewritten, or could run forever on a text, is refused when the step is built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_SPACE = r"\t\n\x0B\f\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_LINE_END = r"\n\r\u2028\u2029"
_BOUND = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
_TOKEN = re.compile(
    r"""(?P<back>\\k<(?P<of>\w+)>) | \\u\{(?P<point>[0-9A-Fa-f]{1,6})\} | (?P<code>\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\c[A-Za-z]) | (?P<number>\\[1-9]\d*) | (?P<property>\\[pP]\{[\w=]+\}) | \\(?P<escaped>.)
      | \(\?<(?P<name>[A-Za-z_$][\w$]*)> | (?P<inline>\(\?[imsu]+\)) | (?P<open>\((?:\?(?:[imsu]*:|[=!]|<[=!]))?) | (?P<close>\)) | (?P<none>\[\]) | (?P<all>\[\^\]) | (?P<class>\[\^?)
      | (?P<times>(?:[*+?]|\{\d+(?:,\d*)?\})\??) | (?P<sign>.)""",
    re.VERBOSE | re.DOTALL,
)
#: Escapes that mean the same in both; \A and \z, the ends of a text, are this library's addition. In a class b is a backspace.
_SAME = "dDwWnrtf"
_ENDS = "Az"


@dataclass(frozen=True)
class Pattern:
    """java: the pattern with its flags; names: for each group, the name it was given or None."""

    java: str
    names: tuple[str | None, ...]

    @property
    def groups(self) -> int:
        return len(self.names)

    def replacement(self, text: str) -> str:
        """$1, $<name>, $& and $$ in the engine's form; all else stands for itself."""

        def one(m: re.Match) -> str:
            if m["name"] is not None:
                return f"${self.names.index(m['name']) + 1}" if m["name"] in self.names else ""
            if m["digits"]:
                known = next((m["digits"][:k] for k in (2, 1) if 0 < int(m["digits"][:k] or 0) <= self.groups and len(m["digits"]) >= k), None)
                return rf"\${m['digits']}" if known is None else f"${int(known)}" + "".join(rf"\{d}" for d in m["digits"][len(known) :])
            return {"$&": "$0", "$$": r"\$"}.get(m[0], "\\" + m[0])

        return re.sub(r"\$<(?P<name>[^>]*)>|\$(?P<digits>\d{1,2})|\$[&$]|[\\$]", one, text)


def _inside(pattern: str, at: int) -> tuple[str, int]:
    """What stands in a class from at on, and where it ends."""
    out = []
    while at < len(pattern) and pattern[at] != "]":
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            long = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\c[A-Za-z]|\\[pP]\{[\w=]+\}").match(pattern, at)
            e = pattern[at + 1]
            if long:
                out.append(rf"\x{{{long[1]}}}" if long[1] else long[0])
            else:
                out.append({"s": _SPACE, "S": f"[^{_SPACE}]", "b": r"\x08", "v": r"\x0B", "0": r"\x00"}.get(e) or (f"\\{e}" if e in _SAME or not e.isalnum() else e))
            at = long.end() if long else at + 2
            continue
        out.append(f"\\{c}" if c in "[&^~" else c)
        at += 1
    if at == len(pattern):
        raise ValueError("a class is not closed")
    return "".join(out), at + 1


def translated(pattern: str, flags: str = "") -> Pattern:
    """The pattern for Spark, with flags i, m, s and u. ValueError if it has no form there, or repeats a group that itself repeats without bound."""
    if set(flags) - set("gimsuy"):
        raise ValueError(f"no such flags: {flags!r}")
    names = [m["name"] for m in _TOKEN.finditer(re.sub(r"\\.", "__", re.sub(r"(?<!\\)\[(?:\\.|[^\]\\])*\]", lambda m: "_" * len(m[0]), pattern))) if m["name"] or m["open"] == "("]
    many, lines = "s" in flags, "m" in flags
    out: list[str] = []
    open_groups: list[bool] = []  # whether each holds a repetition without bound
    at, closed = 0, False
    while at < len(pattern):
        m = _TOKEN.match(pattern, at)
        at, was = m.end(), closed
        closed = False
        if m["class"]:
            inside, at = _inside(pattern, at)
            out.append(f"{m['class']}{inside}]")
        elif m["name"] or m["open"]:
            open_groups.append(False)
            out.append("(" if m["name"] else m["open"])
        elif m["close"]:
            if not open_groups:
                raise ValueError("a group is closed that was not opened")
            closed = open_groups.pop()
            if closed and open_groups:
                open_groups[-1] = True
            out.append(")")
        elif m["times"]:
            endless = m["times"][0] in "*+" or re.match(r"\{\d+,\}", m["times"]) is not None
            if endless and was:
                raise ValueError("a repeated group repeats without bound, which can take forever")
            if endless and open_groups:
                open_groups[-1] = True
            out.append(m["times"])
        elif m["inline"]:
            out.append(m["inline"].replace("i", "iu"))
        elif m["back"]:
            if m["of"] not in names:
                raise ValueError(f"no group named {m['of']}")
            out.append(rf"(?:\{names.index(m['of']) + 1})")
        elif m["number"]:
            if int(m["number"][1:]) > len(names):
                raise ValueError(f"no group {m['number'][1:]}")
            out.append(f"(?:{m['number']})")
        elif m["point"]:
            out.append(rf"\x{{{m['point']}}}")
        elif m["code"] or m["property"]:
            out.append(m["code"] or m["property"])
        elif m["escaped"]:
            e = m["escaped"]
            out.append({"s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "b": f"(?:{_BOUND})", "B": f"(?!{_BOUND})", "v": r"\x0B", "0": r"\x00"}.get(e) or (f"\\{e}" if e in _SAME + _ENDS or not e.isalnum() else e))
        elif m["none"] or m["all"]:
            out.append("(?!)" if m["none"] else r"[\s\S]")
        else:
            c = m["sign"]
            out.append({".": r"[\s\S]" if many else f"[^{_LINE_END}]", "^": f"(?:^|(?<=[{_LINE_END}]))" if lines else "^", "$": f"(?=[{_LINE_END}]|\\z)" if lines else r"\z", "{": r"\{", "}": r"\}", "]": r"\]"}.get(c, c))
    if open_groups:
        raise ValueError("a group is not closed")
    java = ("(?iu)" if "i" in flags else "") + "".join(out)
    _accepted(java)
    return Pattern(java, tuple(names))


def _accepted(java: str) -> None:
    """ValueError if the engine that will run the pattern doesn't take it. Spark folds this without a job."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark.sql("SELECT * FROM VALUES ('') AS t(x)").select(F.col("x").rlike(java)).first()
        except PySparkException as e:
            raise ValueError(f"not a pattern: {java!r}") from e
