"""Text, number, hash, distance and identifier functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import function, register
from .collections import _col, _guard


@function("text.join")
def join(strings, delimiter: str) -> Column:
    return F.array_join(_col(strings), delimiter)


@function("text.format")
def format_(text: str, params: list) -> Column:
    """{} takes the next parameter, {n} the n-th; {{ and }} are braces."""
    params, nxt, parts = [p if isinstance(p, Column) else F.lit(p) for p in params], 0, []
    for piece in re.split(r"(\{\{|\}\}|\{\d*\})", text):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{\d*\}", piece):
            n = int(piece[1:-1]) if len(piece) > 2 else nxt
            nxt += len(piece) == 2
            if n >= len(params):
                raise ValueError(f"{text!r} needs more than {len(params)} parameters")
            parts.append(params[n].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


@function("text.regexGroups")
def regex_groups(text, regex: str) -> Column:
    """[match, group 1, ...] of every match; empty groups are left out."""
    t, groups = _col(text), re.compile(regex).groups
    every = [F.regexp_extract_all(t, F.lit(regex), F.lit(i)) for i in range(groups + 1)]
    zipped = F.arrays_zip(*[c.alias(f"g{i}") for i, c in enumerate(every)])
    return F.transform(zipped, lambda m: F.filter(F.array(*[m[f"g{i}"] for i in range(groups + 1)]), lambda g: F.length(g) > 0))


@function("text.replace")
def replace(text, needle, replacement) -> Column:
    """Literal; an empty needle changes nothing."""
    n, r = (x if isinstance(x, Column) else F.lit(x) for x in (needle, replacement))
    return F.when(F.length(n) == 0, _col(text)).otherwise(F.replace(_col(text), n, r))


@function("text.regreplace")
def regreplace(text, regex: str, replacement: str) -> Column:
    return F.regexp_replace(_col(text), regex, replacement)


@function("text.distance")
def distance(one, two) -> Column:
    return F.levenshtein(_col(one), _col(two))


@function("text.indexOf")
def index_of(text, lookup, start: int = 0, end: int = -1) -> Column:
    """Byte offset of lookup's first place from start on that begins before end; -1 where there is none, null for null."""
    t = _col(text)
    needle = lookup if isinstance(lookup, Column) else F.lit(lookup)
    # Every byte is one character of ISO-8859-1 text.
    one = lambda c: F.decode(c, "ISO-8859-1")
    rest = F.substring(t.cast("binary"), start + 1, 1 << 30)
    at = F.position(one(needle.cast("binary")), one(rest))
    found = F.when(at == 0, F.lit(-1)).otherwise(at - 1 + start)
    if end >= 0:
        found = F.when(found < end, found).otherwise(F.lit(-1))
    return F.when(t.isNull() | needle.isNull(), F.lit(None)).otherwise(found).cast("long")


MODES = ("CEILING", "FLOOR", "UP", "DOWN", "HALF_EVEN", "HALF_DOWN", "HALF_UP", "UNNECESSARY")


@function("math.round")
def round_(value=0.0, precision: int = 0, mode: str = "HALF_UP") -> Column:
    """Rounding of value * 10**precision as a double."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    v = (value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)).cast("double")
    scale = float(10**precision)
    x = v * scale
    sign, size = F.signum(x), F.abs(x)
    whole, part = F.floor(size).cast("double"), F.abs(x) - F.floor(size)
    by_mode = {
        "CEILING": F.ceil(x).cast("double"), "FLOOR": F.floor(x).cast("double"), "UP": sign * F.ceil(size), "DOWN": sign * whole, "UNNECESSARY": x,
        "HALF_UP": sign * F.when(part >= 0.5, whole + 1).otherwise(whole), "HALF_DOWN": sign * F.when(part > 0.5, whole + 1).otherwise(whole),
        "HALF_EVEN": sign * F.when((part > 0.5) | ((part == 0.5) & (whole % 2 == 1)), whole + 1).otherwise(whole),
    }
    return by_mode[mode] / scale


@function("util_module.md5")
def md5(values) -> Column:
    """Of a value's text, or of a list's texts joined."""
    c = values if isinstance(values, Column) else _col(values)
    return F.md5(c.cast("string").cast("binary")) if not isinstance(values, list) else F.md5(F.array_join(F.transform(c, lambda v: v.cast("string")), "").cast("binary"))


@function("uuid_generator.get")
def uuid() -> Column:
    return F.expr("uuid()")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return radius * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _unit(metrics: str) -> float:
    if metrics.lower() not in ("m", "km"):
        raise ValueError("metrics is m or km")
    return 1.0 if metrics.lower() == "m" else 0.001


@function("distance_calculator.single")
def distance_single(start: Column, end: Column, metrics: str = "m", decimals: int = 2) -> Column:
    """Between two structs of lat and lng; a missing coordinate raises."""
    known = start["lat"].isNotNull() & start["lng"].isNotNull() & end["lat"].isNotNull() & end["lng"].isNotNull()
    d = haversine(start["lat"], start["lng"], end["lat"], end["lng"], 6371000.0) * _unit(metrics)
    return _guard(known, F.round(d, decimals), "both points need lat and lng")


@function("distance_calculator.multiple")
def distance_multiple(starts: Column, ends: Column, metrics: str = "m", decimals: int = 2) -> Column:
    """Pairwise over two arrays of structs, which must be of one length."""
    zipped = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: distance_single(p["a"], p["b"], metrics, decimals))
    return _guard(F.size(starts) == F.size(ends), zipped, "the lists differ in length")


@register("text.regex_rows", kind="function")
def regex_rows(df: DataFrame, text, regex: str) -> DataFrame:
    """(results): a row for each match's groups."""
    return df.select(F.explode(regex_groups(text, regex)).alias("results"))
