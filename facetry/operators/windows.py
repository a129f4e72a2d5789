"""Ordinal intervals and windows over facets, and sized profile ranges."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.units import count, short_count


_COUNT = r"(?:MAX|\d[\d_]*(?:\.\d+)?(?:[eE]\d+)?(?:\s*\^\s*\d+)?\s*[a-zA-Z]*)"
_INTERVAL = re.compile(rf"\s*(?P<open>[\[(])?\s*(?P<first>{_COUNT})(?:\s*(?:\.\.|[→,-])\s*(?P<last>{_COUNT}))?\s*(?P<close>[\])])?\s*")


@dataclass(frozen=True)
class Interval:
    """Ordinals from `lo` up to, without, `hi`."""

    lo: int
    hi: int

    @staticmethod
    def parse(text: str) -> Interval:
        """`1M`, `0..1000` (closed), `[0..1000)`, `(5..10)`, `[7]`; the ends may be set apart by `..`, `→`, `-` or `,`."""
        found = _INTERVAL.fullmatch(text or "")
        if found is None:
            raise ValueError(f"no interval: {text!r}")
        opening, first, last, closing = found.group("open", "first", "last", "close")
        match (opening, closing, last):
            case (None, None, None):
                return Interval(0, count(first))
            case ("[", "]", None):
                return Interval(count(first), count(first) + 1)
            case (None, None, _) | ("[" | "(", "]" | ")", str()):
                return Interval(count(first) + (opening == "("), count(last) + (closing != ")"))
        raise ValueError(f"brackets come in pairs, and a single ordinal is written [n]: {text!r}")

    @staticmethod
    def of(data) -> Interval:
        if isinstance(data, Interval):
            return data
        if isinstance(data, int):
            return Interval(0, data)
        if isinstance(data, dict):
            first = data["minIncl"] if "minIncl" in data else data["min_incl"]
            return Interval(int(first), int(data["maxExcl"] if "maxExcl" in data else data["max_excl"]))
        return Interval.parse(data)

    @property
    def size(self) -> int:
        return max(0, self.hi - self.lo)


def strict_range(text: str) -> Interval:
    """A range of record ordinals for the store tools: `n`, `a..b`, `[a,b)` and so on, whole numbers from 0, not empty."""
    body = text.strip()
    if not re.fullmatch(r"[\[(]?\s*\d+\s*((\.\.|,)\s*\d+\s*)?[\])]?", body) or (body[0] in "[(") != (body[-1] in "])"):
        raise ValueError(f"no ordinal range: {text!r}")
    out = Interval.parse(body)
    if out.hi <= out.lo:
        raise ValueError(f"an empty ordinal range: {text!r}")
    return out


class Window(tuple):
    """Intervals in the order in which their rows are numbered; empty for the whole facet."""

    @staticmethod
    def of(data) -> Window:
        if data is None or data == "" or isinstance(data, Window):
            return data if isinstance(data, Window) else Window()
        if isinstance(data, (list, tuple)):
            return Window(Interval.of(x) for x in data)
        if isinstance(data, str):
            wraps = re.findall(r"[\[(][^\])]*[\])]", data)
            inner = data.strip()[1:-1] if len(wraps) == 1 and wraps[0] == data.strip() else None
            if inner is not None and ".." in inner and "," in inner:
                # One wrapping around several closed ranges.
                return Window(Interval.of(x) for x in inner.split(","))
            return Window(Interval.of(x) for x in wraps) if len(wraps) > 1 else Window([Interval.of(data)])
        return Window([Interval.of(data)])

    def apply(self, facet: DataFrame, rows: int | None = None, ordinal: str = "ordinal") -> DataFrame:
        """The facet's rows in the window, numbered anew from 0 in the window's order.

        One scan whatever the number of intervals: the filter on the ordinal reaches the source. Overlapping intervals
        give their rows once for each. `rows`, where known, clips intervals that go beyond the end.
        """
        if not self:
            return facet
        parts, base = [], 0
        for i in self:
            hi = i.hi if rows is None else min(i.hi, rows)
            if hi > i.lo:
                parts.append((i.lo, hi, base))
                base += hi - i.lo
        if not parts:
            return facet.where("false")
        o = F.col(ordinal)
        inside = reduce(lambda a, b: a | b, [(o >= lo) & (o < hi) for lo, hi, _ in parts])
        places = [F.when((o >= lo) & (o < hi), o - lo + base) for lo, hi, base in parts]
        rest = [c for c in facet.columns if c != ordinal]
        hit = facet.where(inside)
        if len(parts) == 1:
            return hit.select(places[0].cast("long").alias(ordinal), *rest)
        return hit.select(F.explode(F.array_compact(F.array(*[x.cast("long") for x in places]))).alias(ordinal), *rest)


def get(facet: DataFrame, i: int, ordinal: str = "ordinal") -> DataFrame:
    return facet.where(F.col(ordinal) == i)


def get_range(facet: DataFrame, a: int, b: int, ordinal: str = "ordinal") -> DataFrame:
    """Rows from a up to b, in order; none where b is not above a."""
    return facet.where((F.col(ordinal) >= a) & (F.col(ordinal) < b)).orderBy(ordinal)


def mapped(facet: DataFrame, f: Callable[[Column], Column], value: str = "vector") -> DataFrame:
    """An element-wise projection; chains are fused by the optimizer."""
    return facet.withColumn(value, f(F.col(value)))


def concatenated(*facets: tuple[DataFrame, int], ordinal: str = "ordinal") -> DataFrame:
    """Facets one after the other: (frame, number of rows) each; ordinals go on."""
    out, base = None, 0
    for df, n in facets:
        shifted = df.withColumn(ordinal, (F.col(ordinal) + base).cast("long"))
        out, base = shifted if out is None else out.unionByName(shifted), base + n
    return out


def flattened(facet: DataFrame, value: str = "vector", ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, position, value) of every element."""
    return facet.select(ordinal, F.posexplode(value).alias("position", value))


def index_of(facet: DataFrame, vector: list, last: bool = False, value: str = "vector", ordinal: str = "ordinal") -> DataFrame:
    """One row: the first (or last) ordinal whose vector equals `vector`, or -1. NaN equals NaN, and -0.0 is not 0.0."""
    target = facet.schema[value].dataType
    kind = target.elementType.simpleString()
    v = F.array(*[F.lit(x).cast(kind) for x in vector])
    same = F.size(value) == len(vector)
    if isinstance(target.elementType, (T.FloatType, T.DoubleType)):
        sign = lambda c: F.transform(c, lambda x: F.when(x == 0, F.lit(1) / F.try_divide(F.lit(1.0), x)).isNull() & x.cast("string").startswith("-"))
        same &= (F.col(value) == v) & (sign(F.col(value)) == sign(v))
    else:
        same &= F.col(value) == v
    hit = facet.where(same)
    return hit.agg(F.coalesce((F.max if last else F.min)(ordinal), F.lit(-1)).cast("long").alias("ordinal"))


# --- sized profiles ------------------------------------------------------------------------------------------------

_RANGE = re.compile(r"\s*(fib:|mul:)?\s*([^./\s]+)\s*\.\.\s*([^/\s]+?)\s*(?:/\s*(\S+))?\s*")


def sizes_of(spec: str) -> list[int]:
    """Sizes that one range spec names: `10m`, `a..b`, `a..b/STEP`, `a..b/N`, `fib:a..b`, `mul:a..b/f`."""
    m = _RANGE.fullmatch(spec)
    if not m:
        return [count(spec)]
    prefix, a, b, divisor = m[1], count(m[2]), count(m[3]), m[4]
    if prefix == "fib:":
        out, x, y = [], 1, 1
        while 0 < a * x <= b:
            out.append(a * x)
            x, y = y, x + y
        return out
    if prefix == "mul:":
        factor, out, x = float(divisor or 2), [], a
        while x <= b:
            out.append(x)
            if int(x * factor) <= x:
                break
            x = int(x * factor)
        return out
    if divisor is None:
        return [a] if a == b else [a, b]
    n = count(divisor)
    if divisor[-1].isalpha():
        return list(range(a or n, b + 1, n)) if n > 0 else []
    step = (b - a) // n if n > 0 else 0
    return [a + step * i for i in range(1, n + 1)] if step > 0 else []


def sized_profiles(specs: list[str]) -> dict[str, int]:
    """Profile names and base counts of range specs, ascending, without repeats and zeros."""
    return {short_count(n): n for n in sorted({n for s in specs for n in sizes_of(str(s))}) if n > 0}
