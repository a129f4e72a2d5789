"""Attribute literals, attribute paths and name templates."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of typed literals, in the order in which they are tried; whole matches.
TYPES = (
    ("BYTE", r"[-+]?\d+[bB]"),
    ("LONG", r"[-+]?\d{10,}"),
    ("LONG", r"[-+]?\d+[lL]"),
    ("SHORT", r"[-+]?\d+[sS]"),
    ("INT", r"[-+]?\d+[iI]?"),
    ("FLOAT", r"(?![-+]?[\d.]{9})[-+]?\d+\.\d+"),
    ("DOUBLE", r"[-+]?\d+\.\d+"),
    ("FLOAT", r"[-+]?\d+(?:\.\d+)?[fF]"),
    ("DOUBLE", r"[-+]?\d+(?:\.\d+)?[dD]"),
)


def literal_type(text: str) -> str:
    return next((name for name, p in TYPES if re.fullmatch(p, text)), "STRING")


def literal_type_column(c: Column) -> Column:
    out = F.lit("STRING")
    for name, p in reversed(TYPES):
        out = F.when(c.rlike(rf"\A(?:{p})\z"), F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


@dataclass(frozen=True)
class Attribute:
    type: str
    value: object

    @staticmethod
    def parse(text: str) -> Attribute:
        """`(type)literal`, or a literal whose type its form tells."""
        m = re.fullmatch(r"\(\s*(\w+)\s*\)(.*)", text.strip(), re.S)
        kind, raw = (m[1].upper(), m[2].strip()) if m else (literal_type(text.strip()), text.strip())
        if kind in ("BYTE", "SHORT", "INT", "LONG"):
            return Attribute(kind, int(raw.rstrip("bBsSlLiI")))
        if kind in ("FLOAT", "DOUBLE"):
            return Attribute(kind, float(raw.rstrip("fFdD")))
        if kind == "STRING":
            return Attribute(kind, raw)
        raise ValueError(f"unknown literal type {kind}")


def attribute_path(text: str) -> tuple[str, str]:
    """(path, attribute) of `/group/group:attribute` or `.attribute`; the path is `/` where there is none."""
    m = re.fullmatch(r"(/|(?:/[^:/.]+)+)?[:.]?([a-zA-Z_]\w*)", text, re.A)
    if not m:
        raise ValueError(f"no attribute in {text!r}")
    return m[1] or "/", m[2]


def templatize(template: str, tokens: Mapping[str, object]) -> str:
    """`[name]` replaced by its value; `[name*]` may be unknown, with what else stands in its brackets, and goes then.

    Values keep letters, digits, `_` and `-`; other characters go. An unknown token raises.
    """

    def put(m: re.Match) -> str:
        inner = m[1]
        word = re.search(r"([A-Za-z_][A-Za-z0-9_]*)(\*?)", inner)
        if word is None:
            raise ValueError(f"no token in {m[0]!r}")
        value = tokens.get(word[1])
        if value is None:
            if word[2]:
                return ""
            raise KeyError(word[1])
        return inner[: word.start()] + re.sub(r"[^A-Za-z0-9_-]", "", str(value)) + inner[word.end() :]

    return re.sub(r"\[([^\]]*)\]", put, template)
