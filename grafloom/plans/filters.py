"""The relationship and label mini-languages, compiled to predicates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph


class Rules(NamedTuple):
    """Types by direction; any_out and any_in take every type."""

    any_out: bool
    any_in: bool
    out: frozenset[str]
    into: frozenset[str]
    both: frozenset[str]


def relationship_rules(filters: list[str], allow_both: bool = True) -> Rules:
    """``T>`` outgoing, ``<T`` incoming, ``T`` either, ``>`` and ``<`` of any type, ``<T>`` where both directions exist; none: all."""
    if not filters:
        return Rules(True, True, frozenset(), frozenset(), frozenset())
    any_out, any_in = ">" in filters, "<" in filters
    out, into, both = set(), set(), set()
    for f in filters:
        if f in ("<", ">"):
            continue
        starts, ends = f.startswith("<"), f.endswith(">")
        if starts and ends:
            if not allow_both:
                raise ValueError(f"{f}: a type can't be asked for in both directions here")
            both.add(f[1:-1])
        elif starts:
            into.add(f[1:])
        elif ends:
            out.add(f[:-1])
        else:
            out.add(f)
            into.add(f)
    return Rules(any_out, any_in, frozenset(out), frozenset(into), frozenset(both))


def steps(g: PropertyGraph, filters: list[str] | None, allow_both: bool = True) -> DataFrame:
    """(id, src, dst, type): steps that the rules allow, src being where one comes from; each edge at most once a direction."""
    r = relationship_rules(list(filters or []), allow_both)
    e = g.E.select("id", "src", "dst", "type")
    allowed = lambda every, types: F.lit(True) if every else F.col("type").isin(*types) if types else F.lit(False)
    one = e.filter(allowed(r.any_out, r.out))
    two = e.filter(allowed(r.any_in, r.into)).select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    found = one.union(two)
    if r.both:
        twin = e.filter(F.col("type").isin(*r.both))
        back = twin.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "type").distinct()
        found = found.union(twin.join(back, ["src", "dst", "type"], "left_semi").select("id", "src", "dst", "type"))
    return found.dropDuplicates(["id", "src", "dst"])


class Labels(NamedTuple):
    """What a node's labels say: blacklisted, end, terminated, whitelisted (booleans)."""

    valid: Column
    expand: Column


def label_rules(labels: Column, filters: list[str] | None) -> Labels:
    """``-L`` never, ``>L`` may end a path, ``/L`` ends it, ``+L`` or ``L`` allowed; end and terminator rules replace the whitelist for results."""
    sets: dict[str, list[str]] = {"-": [], ">": [], "/": [], "+": []}
    for f in filters or []:
        sets[f[0] if f[0] in "->/+" else "+"].append(f[1:] if f[0] in "->/+" else f)
    has = lambda k: F.coalesce(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in sets[k]])), F.lit(False)) if sets[k] else F.lit(False)
    black, end, stop = has("-"), has(">"), has("/")
    white = has("+") if sets["+"] else F.lit(True)
    plain = F.lit(not sets[">"] and not sets["/"])
    return Labels(~black & (end | stop | (plain & white)), ~black & ~stop & (end | white))
