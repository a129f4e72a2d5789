"""Predicate trees over metadata records, compiled to Spark columns.

Evaluation is two-valued: a comparison is true or false, never null. The first comparand decides how a field is read;
a field of another kind fails every operator, NE too. Only EQ with a null comparand holds for a null or missing field.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operators and node kinds by their number in the binary form; symbols by operator.
OPERATORS = ("GT", "LT", "EQ", "NE", "GE", "LE", "IN", "MATCHES")
KINDS = ("PRED", "AND", "OR")
SYMBOLS = {"GT": ">", "LT": "<", "EQ": "=", "NE": "!=", "GE": ">=", "LE": "<=", "IN": "IN", "MATCHES": "MATCHES"}
# Comparand tags, the record dialect's leader and the mark of typed comparands.
INT, FLOAT, TEXT, BOOL, BYTES, NULL = range(6)
DIALECT, TYPED = 0x02, 0xFF

_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Leaf:
    """field op values; `field` is a name or a number; `legacy` values are plain longs without a type of their own."""

    field: str | int
    op: str
    values: tuple
    legacy: bool = False

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")


@dataclass(frozen=True)
class Junction:
    kind: str
    nodes: tuple

    def __post_init__(self):
        if self.kind not in ("AND", "OR"):
            raise ValueError(f"unknown junction {self.kind!r}")


Node = Leaf | Junction


def leaf(field: str | int, op: str, *values: Any) -> Leaf:
    return Leaf(field, op, values)


def all_of(*nodes: Node) -> Junction:
    return Junction("AND", nodes)


def any_of(*nodes: Node) -> Junction:
    return Junction("OR", nodes)


def family(value: Any) -> int:
    """The comparand tag of a Python value."""
    if value is None:
        return NULL
    for kind, tag in ((bool, BOOL), (int, INT), (float, FLOAT), (str, TEXT), ((bytes, bytearray), BYTES)):
        if isinstance(value, kind):
            return tag
    raise TypeError(f"no comparand for {type(value).__name__}")


# --- JSON form -----------------------------------------------------------------------------------------------------


def parse_json(text: str | dict) -> Node:
    """{field, op, values} or {op, nodes}; operators by name or symbol, one value unless IN, at least one node."""
    data = json.loads(text) if isinstance(text, str) else text
    op = str(data["op"]).strip()
    by_symbol = {s: n for n, s in SYMBOLS.items()} | {"==": "EQ", "<>": "NE", "&": "AND", "|": "OR"}
    name = by_symbol.get(op, op.upper())
    if "nodes" in data:
        if not data["nodes"]:
            raise ValueError("a junction needs at least one node")
        return Junction(name, tuple(parse_json(n) for n in data["nodes"]))
    values = data["values"] if isinstance(data["values"], list) else [data["values"]]
    if name != "IN" and len(values) != 1:
        raise ValueError(f"{name} takes one value")
    return Leaf(data["field"], name, tuple(values))


def to_json(node: Node) -> str:
    def plain(n: Node) -> dict:
        if isinstance(n, Junction):
            return {"op": n.kind, "nodes": [plain(x) for x in n.nodes]}
        return {"field": n.field, "op": n.op, "values": list(n.values)}

    return json.dumps(plain(node))


# --- evaluation ----------------------------------------------------------------------------------------------------


def resolve(node: Node, fields: list[str]) -> Node:
    """Field numbers replaced by the names of a layout."""
    if isinstance(node, Junction):
        return Junction(node.kind, tuple(resolve(n, fields) for n in node.nodes))
    return Leaf(fields[node.field], node.op, node.values, node.legacy) if isinstance(node.field, int) else node


def fields_of(node: Node) -> set:
    return {node.field} if isinstance(node, Leaf) else set().union(*(fields_of(n) for n in node.nodes))


_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "GT": lambda c, v: c > v, "LT": lambda c, v: c < v, "GE": lambda c, v: c >= v,
    "LE": lambda c, v: c <= v, "EQ": lambda c, v: c == v, "NE": lambda c, v: c != v,
}


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _as_long(c: Column, kind: T.DataType) -> Column:
    """A number truncated to a long; beyond the range the nearest long, NaN 0."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        inside = F.when(F.isnan(d), F.lit(0).cast("long")).when(d >= 2.0**63, F.lit(_LONG_MAX)).when(d <= -(2.0**63), F.lit(_LONG_MIN))
        return inside.otherwise(F.when(~F.isnan(d) & (d < 2.0**63) & (d > -(2.0**63)), d).cast("long"))
    return c.cast("long")


def _number(c: Column, kind: T.DataType, op: str, values: tuple, first: int) -> Column:
    if first == INT:
        field, use = _as_long(c, kind), [F.lit(v).cast("long") for v in values if family(v) == INT]
    elif first == FLOAT:
        field, use = c.cast("double"), [F.lit(float(v)) for v in values if family(v) == FLOAT]
        # Spark holds NaN equal to itself and above all numbers; here it compares with nothing.
        plain = _number_test(field, op, use)
        known = ~F.isnan(field) & (F.lit(op == "IN") | ~F.isnan(use[0]))
        return field.isNotNull() & (~known | plain) if op == "NE" else known & plain
    else:
        return F.lit(False)
    return _number_test(field, op, use)


def _number_test(field: Column, op: str, use: list[Column]) -> Column:
    return field.isin(*use) if op == "IN" else _COMPARE[op](field, use[0]) if op in _COMPARE else F.lit(False)


def _compile_leaf(node: Leaf, schema: T.StructType) -> Column:
    if isinstance(node.field, int):
        raise ValueError("numbered fields need resolve() with a layout first")
    has_null = not node.legacy and any(v is None for v in node.values)
    kind = next((f.dataType for f in schema.fields if f.name == node.field), None)
    if kind is None or isinstance(kind, T.NullType):
        return F.lit(node.op == "EQ" and has_null)
    c = F.col(f"`{node.field}`")
    absent = c.isNull() if node.op == "EQ" and has_null else F.lit(False)
    if not node.values:
        return absent
    first, test = family(node.values[0]), F.lit(False)
    if isinstance(kind, T.BooleanType):
        if node.legacy and node.op in ("EQ", "NE"):
            test = _COMPARE[node.op](c.cast("int"), F.lit(node.values[0]))
        elif first == BOOL and node.op in ("EQ", "NE"):
            test = _COMPARE[node.op](c, F.lit(node.values[0]))
    elif isinstance(kind, T.NumericType):
        test = _number(c, kind, node.op, node.values, first)
    elif isinstance(kind, T.StringType) and first == TEXT:
        texts = [v for v in node.values if family(v) == TEXT]
        if node.op == "IN":
            test = c.isin(*texts)
        elif node.op == "MATCHES":
            test = c.rlike(rf"\A(?:{texts[0]})\z")
        else:
            test = _COMPARE[node.op](c, F.lit(texts[0]))
    return _false_if_null(test) if node.op != "EQ" or not has_null else absent | _false_if_null(test)


def compile_predicate(node: Node, schema: T.StructType) -> Column:
    """A never-null boolean column; built from the schema once, so that Catalyst can fold it and push it to the scan."""
    if isinstance(node, Leaf):
        return _compile_leaf(node, schema)
    parts = [compile_predicate(n, schema) for n in node.nodes]
    if node.kind == "AND":
        return reduce(lambda a, b: a & b, parts, F.lit(True)) if len(parts) != 1 else parts[0]
    return reduce(lambda a, b: a | b, parts, F.lit(False)) if len(parts) != 1 else parts[0]


def where(records: DataFrame, node: Node) -> DataFrame:
    return records.where(compile_predicate(node, records.schema))


def solve(records: DataFrame, predicates: Iterable[tuple[int, Node]], ordinal: str = "ordinal") -> DataFrame:
    """(query, ordinal) of every record that meets each predicate, all predicates in one scan and without a shuffle."""
    hits = [F.when(compile_predicate(n, records.schema), F.lit(q).cast("long")) for q, n in predicates]
    if not hits:
        return records.select(F.lit(None).cast("long").alias("query"), F.col(ordinal).cast("long").alias("ordinal")).where("false")
    return records.select(F.explode(F.array_compact(F.array(*hits))).alias("query"), F.col(ordinal).cast("long").alias("ordinal"))


def result_indices(solved: DataFrame) -> DataFrame:
    """(query, ordinals): each query's ordinals in ascending order, as the result facet stores them."""
    return solved.groupBy("query").agg(F.sort_array(F.collect_list("ordinal")).alias("ordinals"))


# --- renderings ----------------------------------------------------------------------------------------------------


def _field(node: Leaf) -> str:
    return f"F{node.field}" if isinstance(node.field, int) else node.field


def _float_text(v: float) -> str:
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "Infinity" if v > 0 else "-Infinity"
    if v == 0 or 1e-3 <= abs(v) < 1e7:
        return repr(v) if "e" not in repr(v) else f"{v:f}"
    digits, _, power = f"{v!r}".partition("e")
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    whole, _, rest = digits.partition(".")
    if not power:
        # Decimal digits that Python writes out: one goes before the point.
        shift = len(whole) - 1 if whole != "0" else -(len(rest) - len(rest.lstrip("0")) + 1)
        all_digits = (whole + rest).strip("0") or "0"
        whole, rest, power = all_digits[0], all_digits[1:], str(shift)
    return f"{sign}{whole}.{rest.rstrip('0') or '0'}E{int(power)}"


def _literal(v: Any, quote: str, words: tuple[str, str, str], blob: str) -> str:
    tag = family(v)
    if tag == TEXT:
        return quote + v.replace(quote, "''" if quote == "'" else '\\"') + quote
    if tag == BOOL:
        return words[0] if v else words[1]
    return words[2] if tag == NULL else blob if tag == BYTES else _float_text(v) if tag == FLOAT else str(v)


def _sql_literal(v: Any) -> str:
    return _literal(v, "'", ("TRUE", "FALSE", "NULL"), "X'...'")


def render_sql(node: Node) -> str:
    """For reading: MATCHES shows as LIKE and a null comparand as = NULL; evaluation is compile_predicate()'s."""
    if isinstance(node, Junction):
        return f"({f' {node.kind} '.join(map(render_sql, node.nodes))})"
    if node.op == "IN":
        return f"{_field(node)} IN ({', '.join(map(_sql_literal, node.values))})"
    shown = _sql_literal(node.values[0]) if node.values else ""
    return f"{_field(node)} {'LIKE' if node.op == 'MATCHES' else SYMBOLS[node.op]} {shown}"


def render_cql(node: Node) -> str:
    """For reading only: junctions have no parentheses."""
    if isinstance(node, Junction):
        return f" {node.kind} ".join(map(render_cql, node.nodes))
    if node.op == "MATCHES":
        return f"{_field(node)} /* MATCHES */ '{node.values[0] if node.values and (node.legacy or family(node.values[0]) == TEXT) else ''}'"
    return render_sql(node)


def render_cddl(node: Node) -> str:
    if isinstance(node, Junction):
        return f"{node.kind} {{ {', '.join(map(render_cddl, node.nodes))} }}"
    names = {INT: "int", FLOAT: "float", TEXT: "tstr", BOOL: "bool", BYTES: "bstr", NULL: "null"}
    kind = names[family(node.values[0])] if node.values else "int"
    shown = [_literal(v, '"', ("true", "false", "null"), "h'...'") for v in node.values]
    return f"{_field(node)}: {kind} {SYMBOLS[node.op]} {shown[0] if len(shown) == 1 else '[' + ', '.join(shown) + ']'}"


RENDERERS: dict[str, Callable[[Node], str]] = {"sql": render_sql, "cql": render_cql, "cddl": render_cddl, "json": to_json}


# --- binary form ---------------------------------------------------------------------------------------------------


def _comparand(v: Any) -> bytes:
    tag = family(v)
    if tag == TEXT:
        raw = v.encode()
        return struct.pack("<BH", tag, len(raw)) + raw
    if tag == BYTES:
        return struct.pack("<BI", tag, len(v)) + bytes(v)
    forms = {INT: "<Bq", FLOAT: "<Bd", BOOL: "<B?"}
    return struct.pack(forms[tag], tag, v) if tag in forms else bytes([tag])


def encode(node: Node, named: bool = True, typed: bool = False) -> bytes:
    """A tree without its frame. Little-endian; fields by name or, with named=False, by number."""
    if isinstance(node, Junction):
        if len(node.nodes) > 255:
            raise ValueError("a junction holds at most 255 nodes")
        return bytes([KINDS.index(node.kind), len(node.nodes)]) + b"".join(encode(n, named, typed) for n in node.nodes)
    if named:
        raw = str(node.field).encode()
        head = struct.pack("<BH", 0, len(raw)) + raw
    else:
        head = bytes([0, node.field])
    head += struct.pack("<BH", OPERATORS.index(node.op), len(node.values))
    return head + (b"".join(map(_comparand, node.values)) if typed else struct.pack(f"<{len(node.values)}q", *node.values))


def frame(node: Node, typed: bool | None = None) -> bytes:
    """The framed form with named fields: dialect byte, the mark of typed comparands where needed, the tree."""

    def is_typed(n: Node) -> bool:
        return any(map(is_typed, n.nodes)) if isinstance(n, Junction) else not n.legacy

    typed = is_typed(node) if typed is None else typed
    return bytes([DIALECT, TYPED] if typed else [DIALECT]) + encode(node, True, typed)


_STRUCTS: dict[str, struct.Struct] = {}


class _Bytes:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str):
        known = _STRUCTS.get(form) or _STRUCTS.setdefault(form, struct.Struct("<" + form))
        out = known.unpack_from(self.raw, self.at)
        self.at += known.size
        return out[0] if len(out) == 1 else out

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("the record ends early")
        self.at += n
        return self.raw[self.at - n : self.at]


def _read_comparand(b: _Bytes):
    tag = b.take("B")
    if tag == TEXT:
        return b.bytes(b.take("H")).decode()
    if tag == BYTES:
        return b.bytes(b.take("I"))
    if tag == BOOL:
        return b.take("B") != 0
    if tag in (INT, FLOAT):
        return b.take("q" if tag == INT else "d")
    if tag != NULL:
        raise ValueError(f"unknown comparand tag {tag}")
    return None


def _read(b: _Bytes, named: bool, typed: bool) -> Node:
    kind = b.take("B")
    if kind >= len(KINDS):
        raise ValueError(f"unknown node kind {kind}")
    if kind:
        return Junction(KINDS[kind], tuple(_read(b, named, typed) for _ in range(b.take("B"))))
    field = b.bytes(b.take("H")).decode() if named else b.take("B")
    op, n = b.take("B"), b.take("H")
    values = tuple(_read_comparand(b) if typed else b.take("q") for _ in range(n))
    return Leaf(field, OPERATORS[op], values, legacy=not typed)


def decode(raw: bytes, named: bool = True, typed: bool = False) -> Node:
    """The tree of encode(); all bytes must be used."""
    b = _Bytes(raw)
    out = _read(b, named, typed)
    if b.at != len(raw):
        raise ValueError("bytes are left after the tree")
    return out


def unframe(raw: bytes) -> Node:
    if raw[:1] != bytes([DIALECT]):
        raise ValueError("not a predicate record")
    typed = raw[1:2] == bytes([TYPED])
    return decode(raw[1 + typed :], True, typed)


def detect_named(raw: bytes, fields: int) -> bool:
    """Whether a tree's fields are names, told from its first leaf: a field number is below the layout's count, and
    reading all bytes as numbered fields must succeed."""
    at = 0
    while raw[at] in (1, 2):
        at += 2
    if raw[at + 1] >= fields:
        return True
    try:
        decode(raw, named=False)
        return False
    except (ValueError, IndexError, struct.error):
        return True
