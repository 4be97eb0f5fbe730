"""Recipes as ordered Python steps; a step that fails passes its input through and is reported."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.functions.staging import stage
from millrace.functions.values import as_text, named
from millrace.operators.frame import Frame


@dataclass(frozen=True)
class Step:
    """A function of a Frame with a name; muted steps are passed over. lazy: it is sure to run no job of its own."""

    name: str
    apply: Callable[[Frame], Frame]
    muted: bool = False
    lazy: bool = False


@dataclass(frozen=True)
class Outcome:
    frame: Frame
    states: tuple[tuple[str, Frame], ...]
    errors: dict[str, str]


def run(f: Frame, steps: Sequence[Step]) -> Outcome:
    """Steps one after another, lazily: Catalyst sees the whole chain. Only errors in building a step are caught here; those of running it come with the action."""
    states, errors = [("input", f)], {}
    for s in steps:
        if not s.muted:
            try:
                f = s.apply(f)
            except Exception as e:  # noqa: BLE001 - any failing step is reported and passed over
                errors[s.name] = f"{type(e).__name__}: {e}"
        states.append((s.name, f))
    return Outcome(f, tuple(states), errors)


def counted(f: Frame, steps: Sequence[Step]) -> tuple[Outcome, list[dict]]:
    """The outcome, and (step, rows_in, rows_out, cells_changed) of each step that ran, counted by the one job that runs them all here.

    Rows are counted after each step, and the cells of columns that a step keeps under their names are compared with copies from before it; cells_changed is
    null where a step makes rows anew. A step that isn't lazy starts from a table written once, since
    jobs of its own (for a width, keys, a number format, places) would read counted rows in part or twice. The source is read once by counters. They
    keep filters from moving past them, so this is for runs that are to be reported.
    """

    def watch(g: Frame, name: str, copies: dict[str, str]) -> tuple[Frame, tuple[str, Observation, bool]]:
        there = {c: h for c, h in copies.items() if h in g.df.columns}
        kept = bool(copies) and len(there) == len(copies)
        apart = [F.when(as_text(named(c), g.kind(c)) != F.coalesce(named(h), F.lit("")), 1).otherwise(0) for c, h in there.items() if c in g.columns]
        observed = Observation()
        df = g.df.observe(observed, F.count(F.lit(1)).alias("n"), F.sum(sum(apart, F.lit(0))).alias("changed"))
        return Frame(df.drop(*copies.values()), g.order), (name, observed, kept)

    g, first = watch(f, "input", {})
    seen, states, errors = [first], [("input", g)], {}
    for k, s in enumerate(steps):
        if not s.muted:
            copies = {c: f"__was{k}_{i}" for i, c in enumerate(g.columns)}
            try:
                g = g if s.lazy else g.with_df(stage(g.df, "counted"))
                made = s.apply(g.with_df(g.df.withColumns({h: as_text(named(c), g.kind(c)) for c, h in copies.items()})))
                g, one = watch(made, s.name, copies)
                seen.append(one)
            except Exception as e:  # noqa: BLE001 - any failing step is reported and passed over
                errors[s.name] = f"{type(e).__name__}: {e}"
        states.append((s.name, g))
    g.df.write.format("noop").mode("overwrite").save()
    counts = [{"step": name, "rows_in": before.get["n"], "rows_out": o.get["n"], "cells_changed": (o.get["changed"] or 0) if kept else None} for (_, before, _), (name, o, kept) in zip(seen, seen[1:], strict=False)]
    return Outcome(g, tuple(states), errors), counts
