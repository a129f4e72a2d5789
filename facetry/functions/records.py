"""Metadata records: self-describing records of 29 types, fixed-layout records, result lists and ULIDs."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from enum import IntEnum
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import predicates

RECORD_DIALECT = 0x01


class Tag(IntEnum):
    """The wire tags."""

    STRING = 0
    LONG = 1
    DOUBLE = 2
    BOOL = 3
    BYTES = 4
    NULL = 5
    ENUM_STR = 6
    ENUM_ORD = 7
    LIST = 8
    NODE = 9
    TEXT = 10
    ASCII = 11
    INT = 12
    SHORT = 13
    DECIMAL = 14
    VARINT = 15
    FLOAT = 16
    HALF = 17
    MILLIS = 18
    NANOS = 19
    DATE = 20
    TIME = 21
    DATETIME = 22
    UUID1 = 23
    UUID7 = 24
    ULID = 25
    ARRAY = 26
    SET = 27
    MAP = 28

    # Enum's own hashes the name, in Python, at each lookup.
    __hash__ = int.__hash__


_TAGS = tuple(Tag)


# Names of types in the text form, and other names for them.
NAMES = {
    Tag.STRING: "string", Tag.LONG: "long", Tag.DOUBLE: "double", Tag.BOOL: "bool", Tag.BYTES: "byte", Tag.NULL: "null", Tag.ENUM_STR: "enum_str", Tag.ENUM_ORD: "enum_ord",
    Tag.LIST: "list", Tag.NODE: "node", Tag.TEXT: "text", Tag.ASCII: "ascii", Tag.INT: "int", Tag.SHORT: "smallint", Tag.DECIMAL: "decimal", Tag.VARINT: "varint",
    Tag.FLOAT: "float32", Tag.HALF: "half", Tag.MILLIS: "millis", Tag.NANOS: "nanos", Tag.DATE: "date", Tag.TIME: "time", Tag.DATETIME: "datetime",
    Tag.UUID1: "uuidv1", Tag.UUID7: "uuidv7", Tag.ULID: "ulid", Tag.ARRAY: "array", Tag.SET: "set", Tag.MAP: "map",
}
ALIASES = {"tstr": Tag.STRING, "bigint": Tag.LONG, "float64": Tag.DOUBLE, "boolean": Tag.BOOL, "bytes": Tag.BYTES, "blob": Tag.BYTES, "binary": Tag.BYTES, "short": Tag.SHORT, "float": Tag.FLOAT, "float16": Tag.HALF, "timestamp": Tag.DATETIME, "timeuuid": Tag.UUID1}
_BY_NAME = {n: t for t, n in NAMES.items()} | ALIASES

#: An instant as (seconds, nanoseconds), since Python's own clock stops at microseconds.
Instant = tuple[int, int]


@dataclass(frozen=True)
class Ulid:
    raw: bytes

    # Fixed value: the base-32 digits.
    DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

    def __post_init__(self):
        if len(self.raw) != 16:
            raise ValueError("a ULID has 16 bytes")

    @staticmethod
    def parse(text: str) -> Ulid:
        if len(text) != 26 or text[0] > "7":
            raise ValueError(f"no ULID: {text!r}")
        n = 0
        for c in text.upper().translate(str.maketrans("ILO", "110")):
            n = n << 5 | Ulid.DIGITS.index(c)
        return Ulid(n.to_bytes(16, "big"))

    def __str__(self) -> str:
        n = int.from_bytes(self.raw, "big")
        return "".join(self.DIGITS[n >> s & 31] for s in range(125, -1, -5))

    def __lt__(self, other: Ulid) -> bool:
        return self.raw < other.raw

    @property
    def millis(self) -> int:
        return int.from_bytes(self.raw[:6], "big")


@dataclass(frozen=True)
class Array:
    """A typed array: an element tag and values."""

    tag: Tag
    values: tuple


@dataclass(frozen=True)
class Record:
    """Fields in order: (name, tag, value)."""

    fields: tuple[tuple[str, Tag, Any], ...]
    enums: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @staticmethod
    def of(**values: Any) -> Record:
        return Record(tuple((k, infer(v), v) for k, v in values.items()))

    def get(self, name: str) -> Any:
        return next((v for n, _, v in self.fields if n == name), None)

    def has(self, name: str) -> bool:
        return any(n == name for n, _, _ in self.fields)

    def to_dict(self) -> dict[str, Any]:
        return {n: v for n, _, v in self.fields}

    def typed(self, name: str, tag: Tag) -> Any:
        """A field as a type that its own widens to; a missing field or a narrowing raises."""
        for n, t, v in self.fields:
            if n == name:
                if t != tag and tag not in WIDENS.get(t, ()):
                    raise TypeError(f"{name} is {NAMES[t]}, not {NAMES[tag]}")
                return float(v) if tag in (Tag.DOUBLE, Tag.FLOAT) and v is not None else v
        raise KeyError(name)

    def find(self, name: str, tag: Tag) -> Any:
        """typed(), or None where there is no such field or it has another type."""
        try:
            return self.typed(name, tag)
        except (KeyError, TypeError):
            return None

    def enum_name(self, name: str) -> str:
        """The text of an enum field that holds a number."""
        return dict(self.enums)[name][self.get(name)]

    def fingerprint(self) -> bytes:
        """The record without its values: equal for records of the same names and types in the same order."""
        return b"".join(struct.pack("<H", len(n.encode())) + n.encode() + bytes([t]) for n, t, _ in self.fields)

    def congruent(self, other: Record) -> bool:
        return self.fingerprint() == other.fingerprint()


# The types that a field may be read as besides its own.
WIDENS = {Tag.SHORT: (Tag.INT, Tag.LONG), Tag.INT: (Tag.LONG,), Tag.ENUM_ORD: (Tag.INT, Tag.LONG), Tag.HALF: (Tag.FLOAT, Tag.DOUBLE), Tag.FLOAT: (Tag.DOUBLE,), Tag.TEXT: (Tag.STRING,), Tag.ASCII: (Tag.STRING, Tag.TEXT), Tag.ENUM_STR: (Tag.STRING,)}


_EXACT = {type(None): Tag.NULL, bool: Tag.BOOL, float: Tag.DOUBLE, str: Tag.STRING, bytes: Tag.BYTES}


def infer(v: Any) -> Tag:
    known = _EXACT.get(type(v))
    if known is not None:
        return known
    for kind, tag in ((bool, Tag.BOOL), (int, Tag.LONG), (float, Tag.DOUBLE), (str, Tag.STRING), ((bytes, bytearray), Tag.BYTES), (Decimal, Tag.DECIMAL), (Record, Tag.NODE), (Array, Tag.ARRAY), (Ulid, Tag.ULID),
                      (dt.datetime, Tag.DATETIME), (dt.date, Tag.DATE), (dt.time, Tag.TIME), (list, Tag.LIST), ((set, frozenset), Tag.SET), (dict, Tag.MAP)):
        if isinstance(v, kind):
            return Tag.VARINT if tag == Tag.LONG and not -(1 << 63) <= v < 1 << 63 else tag
    if isinstance(v, uuid.UUID):
        return Tag.UUID1 if v.version == 1 else Tag.UUID7
    raise TypeError(f"no record type for {type(v).__name__}")


def _integer_bytes(n: int) -> bytes:
    """Big-endian two's complement, as short as can be."""
    return n.to_bytes(((n if n >= 0 else ~n).bit_length()) // 8 + 1, "big", signed=True)


def _iso(tag: Tag, v: Any) -> str:
    if tag == Tag.DATETIME and isinstance(v, dt.datetime):
        u = v.astimezone(dt.timezone.utc) if v.tzinfo else v
        digits = f".{u.microsecond:06d}" if u.microsecond % 1000 else f".{u.microsecond // 1000:03d}" if u.microsecond else ""
        return f"{u:%Y-%m-%dT%H:%M:%S}{digits}Z"
    if tag == Tag.TIME:
        return v.isoformat() if v.second or v.microsecond else f"{v:%H:%M}"
    return v if isinstance(v, str) else v.isoformat()


_FORMS = {Tag.LONG: "q", Tag.DOUBLE: "d", Tag.INT: "i", Tag.ENUM_ORD: "i", Tag.SHORT: "h", Tag.FLOAT: "f", Tag.HALF: "e", Tag.BOOL: "?", Tag.MILLIS: "q"}
_STRINGS = (Tag.STRING, Tag.TEXT, Tag.ASCII, Tag.ENUM_STR)


def _sized(raw: bytes) -> bytes:
    return struct.pack("<I", len(raw)) + raw


def _encode(tag: Tag, v: Any) -> bytes:
    if tag in _FORMS:
        return struct.pack("<" + _FORMS[tag], v)
    if tag in _STRINGS:
        if tag == Tag.ASCII:
            v.encode("ascii")
        return _sized(v.encode())
    if tag == Tag.BYTES:
        return _sized(bytes(v))
    if tag == Tag.NULL:
        return b""
    if tag == Tag.DECIMAL:
        sign, digits, exponent = v.as_tuple()
        unscaled = int("".join(map(str, digits))) * (-1 if sign else 1)
        return struct.pack("<i", -exponent) + _sized(_integer_bytes(unscaled))
    if tag == Tag.VARINT:
        return _sized(_integer_bytes(v))
    if tag == Tag.NANOS:
        return struct.pack("<qi", *v)
    if tag in (Tag.DATE, Tag.TIME, Tag.DATETIME):
        return _sized(_iso(tag, v).encode())
    if tag in (Tag.UUID1, Tag.UUID7):
        return struct.pack("<QQ", v.int >> 64, v.int & (1 << 64) - 1)
    if tag == Tag.ULID:
        return v.raw
    if tag == Tag.NODE:
        return _sized(encode(v))
    if tag == Tag.ARRAY:
        return bytes([v.tag]) + struct.pack("<I", len(v.values)) + b"".join(_encode(v.tag, x) for x in v.values)
    if tag == Tag.LIST:
        return struct.pack("<I", len(v)) + b"".join(map(_tagged, v))
    if tag == Tag.SET:
        return struct.pack("<I", len(v)) + b"".join(map(_tagged, sorted(v, key=_order)))
    return struct.pack("<I", len(v)) + b"".join(_tagged(k) + _tagged(v[k]) for k in sorted(v, key=_order))


def _order(v: Any):
    return (int(infer(v)), v)


def _tagged(v: Any) -> bytes:
    t = infer(v)
    return bytes([t]) + _encode(t, v)


def encode(r: Record) -> bytes:
    """Dialect byte, number of fields, then name, tag and value of each; little-endian."""
    out = struct.pack("<BH", RECORD_DIALECT, len(r.fields))
    for name, tag, v in r.fields:
        raw = name.encode()
        out += struct.pack("<H", len(raw)) + raw + bytes([Tag.NULL if v is None else tag]) + (b"" if v is None else _encode(tag, v))
    return out


def framed(r: Record) -> bytes:
    return _sized(encode(r))


def _take_tag(b: predicates._Bytes) -> Tag:
    n = b.take("B")
    return _TAGS[n] if n < len(_TAGS) else Tag(n)


def _decode(b: predicates._Bytes, tag: Tag) -> Any:
    if tag in _FORMS:
        return b.take(_FORMS[tag])
    if tag in _STRINGS:
        return b.bytes(b.take("I")).decode()
    if tag == Tag.BYTES:
        return b.bytes(b.take("I"))
    if tag == Tag.NULL:
        return None
    if tag == Tag.DECIMAL:
        scale = b.take("i")
        return Decimal(int.from_bytes(b.bytes(b.take("I")), "big", signed=True)).scaleb(-scale)
    if tag == Tag.VARINT:
        return int.from_bytes(b.bytes(b.take("I")), "big", signed=True)
    if tag == Tag.NANOS:
        return b.take("qi")
    if tag in (Tag.DATE, Tag.TIME, Tag.DATETIME):
        text = b.bytes(b.take("I")).decode()
        return {Tag.DATE: dt.date, Tag.TIME: dt.time, Tag.DATETIME: dt.datetime}[tag].fromisoformat(text)
    if tag in (Tag.UUID1, Tag.UUID7):
        hi, lo = b.take("QQ")
        return uuid.UUID(int=hi << 64 | lo)
    if tag == Tag.ULID:
        return Ulid(b.bytes(16))
    if tag == Tag.NODE:
        return decode(b.bytes(b.take("I")))
    if tag == Tag.ARRAY:
        kind = _take_tag(b)
        return Array(kind, tuple(_decode(b, kind) for _ in range(b.take("I"))))
    n = b.take("I")
    if tag == Tag.LIST:
        return [_decode(b, _take_tag(b)) for _ in range(n)]
    if tag == Tag.SET:
        out = [_decode(b, _take_tag(b)) for _ in range(n)]
        if len(set(out)) != n:
            raise ValueError("a set holds a value twice")
        return set(out)
    return {_decode(b, _take_tag(b)): _decode(b, _take_tag(b)) for _ in range(n)}


def decode(raw: bytes) -> Record:
    """The record of encode(); nested records may lack the dialect byte."""
    b = predicates._Bytes(raw)
    if raw[:1] == bytes([RECORD_DIALECT]):
        b.at = 1
    fields = []
    for _ in range(b.take("H")):
        name = b.bytes(b.take("H")).decode()
        tag = _take_tag(b)
        fields.append((name, tag, _decode(b, tag)))
    return Record(tuple(fields))


def unframed(raw: bytes) -> Iterator[Record]:
    """Records of a stream in which each has its length before it."""
    at = 0
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        if at + 4 + n > len(raw):
            raise ValueError("the stream ends inside a record")
        yield decode(raw[at + 4 : at + 4 + n])
        at += 4 + n


def decode_any(raw: bytes) -> Record | predicates.Node:
    """A record or a predicate of a mixed stream, told by its first byte."""
    if raw[:1] == bytes([RECORD_DIALECT]):
        return decode(raw)
    return predicates.unframe(raw)


# --- text form -----------------------------------------------------------------------------------------------------


def _java_float(v: float) -> str:
    return predicates._float_text(v)


def _short_float(v: float) -> str:
    return predicates._float_text(float(str(np.float32(v)))) if math.isfinite(v) else predicates._float_text(v)


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def _instant(seconds: int, nanos: int) -> str:
    t = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)
    digits = "" if not nanos else f".{nanos // 10**6:03d}" if nanos % 10**6 == 0 else f".{nanos // 1000:06d}" if nanos % 1000 == 0 else f".{nanos:09d}"
    return f"{t:%Y-%m-%dT%H:%M:%S}{digits}Z"


def _show(tag: Tag, v: Any, depth: int) -> str:
    if v is None:
        return "null"
    if tag in _STRINGS:
        return _quoted(v)
    if tag == Tag.DOUBLE:
        return _java_float(v)
    if tag in (Tag.FLOAT, Tag.HALF):
        return _short_float(v) + ("f" if tag == Tag.FLOAT else "h")
    if tag == Tag.BOOL:
        return str(v).lower()
    if tag == Tag.BYTES:
        return f"h'{bytes(v).hex()}'"
    if tag in (Tag.DECIMAL, Tag.VARINT):
        return f'{NAMES[tag]}("{v}")'
    if tag == Tag.MILLIS:
        return f'millis("{_instant(v // 1000, v % 1000 * 10**6)}")'
    if tag == Tag.NANOS:
        return f'nanos("{_instant(*v)}")'
    if tag in (Tag.DATE, Tag.TIME, Tag.DATETIME):
        return f'"{_iso(tag, v)}"'
    if tag in (Tag.UUID1, Tag.UUID7, Tag.ULID):
        return f'"{v}"'
    if tag == Tag.NODE:
        return format_record(v, depth)
    if tag == Tag.ARRAY:
        return f"[{', '.join(_show(v.tag, x, depth) for x in v.values)}]"
    if tag in (Tag.LIST, Tag.SET):
        inner = ", ".join(_show(infer(x), x, depth) for x in (v if tag == Tag.LIST else sorted(v, key=_order)))
        return f"[{inner}]" if tag == Tag.LIST else f"set [{inner}]"
    if tag == Tag.MAP:
        return "{ " + ", ".join(f"{_show(infer(k), k, depth)} => {_show(infer(x), x, depth)}" for k, x in v.items()) + " }"
    return str(v)


def format_record(r: Record, depth: int = 0) -> str:
    """`{ name: type = value, ... }`, a field a line."""
    lines = []
    for name, tag, v in r.fields:
        kind = f"[{NAMES[v.tag]}]" if tag == Tag.ARRAY else NAMES[tag]
        lines.append(f"{'  ' * (depth + 1)}{name}: {kind} = {_show(tag, v, depth + 1)}")
    return "{\n" + "".join(x + "\n" for x in (",\n".join(lines).split("\n") if lines else [])) + "  " * depth + "}"


#: The last form, a quote without an end, is an error; all other characters belong to a token or are spaces.
_LEXEME = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|h'[0-9a-fA-F]*'|=>|[{}\[\]:=,()]|[^\s{}\[\]:=,()"]+|")""")
_NUMBER = re.compile(r"[.fhE]")
_UUIDS, _REALS, _TIMES = (Tag.UUID1, Tag.UUID7), (Tag.FLOAT, Tag.HALF, Tag.DOUBLE), {Tag.DATE: dt.date, Tag.TIME: dt.time, Tag.DATETIME: dt.datetime}
_WRAPPED = {"decimal": lambda s: Decimal(s), "varint": int, "millis": lambda s: _parse_instant(s)[0] * 1000 + _parse_instant(s)[1] // 10**6, "nanos": lambda s: _parse_instant(s)}


def _parse_instant(s: str) -> Instant:
    whole, _, digits = s.rstrip("Z").partition(".")
    seconds = int((dt.datetime.fromisoformat(whole) - dt.datetime(1970, 1, 1)).total_seconds())
    return seconds, int((digits + "0" * 9)[:9]) if digits else 0


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _LEXEME.findall(text), 0
        if '"' in self.tokens:
            at = next(m.start() for m in _LEXEME.finditer(text) if m[1] == '"')
            raise ValueError(f"can't read the record at {text[at : at + 20]!r}")

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self, wanted: str | None = None) -> str:
        out = self.peek()
        if not out or wanted is not None and out != wanted:
            raise ValueError(f"expected {wanted or 'more'}, found {out or 'the end'}")
        self.at += 1
        return out

    def record(self) -> Record:
        fields = []
        self.next("{")
        while self.peek() != "}":
            name = self.next()
            self.next(":")
            if self.peek() == "[":
                self.next("[")
                kind = _BY_NAME[self.next()]
                self.next("]")
                self.next("=")
                self.next("[")
                fields.append((name, Tag.ARRAY, Array(kind, tuple(self.until("]", kind)))))
            else:
                word = self.next()
                tag = _BY_NAME.get(word)
                if tag is None:
                    raise ValueError(f"unknown type {word!r}")
                self.next("=")
                fields.append((name, tag, self.value(tag)))
            if self.peek() == ",":
                self.next()
        self.next("}")
        return Record(tuple(fields))

    def until(self, end: str, tag: Tag | None) -> list:
        out = []
        while self.peek() != end:
            out.append(self.value(tag))
            if self.peek() == ",":
                self.next()
        self.next(end)
        return out

    def value(self, tag: Tag | None) -> Any:
        t = self.peek()
        if tag == Tag.NODE:
            return self.record()
        if tag == Tag.MAP:
            self.next("{")
            out = {}
            while self.peek() != "}":
                k = self.value(None)
                self.next("=>")
                out[k] = self.value(None)
                if self.peek() == ",":
                    self.next()
            self.next("}")
            return out
        if t == "set":
            self.next()
            self.next("[")
            return set(self.until("]", None))
        if t == "[":
            self.next()
            return self.until("]", None)
        self.next()
        if t == "null":
            return None
        if t in _WRAPPED:
            self.next("(")
            inner = json.loads(self.next())
            self.next(")")
            return _WRAPPED[t](inner)
        if t[0] == '"':
            text = t[1:-1] if t.isprintable() and "\\" not in t else json.loads(t)
            if tag == Tag.STRING:
                return text
            if tag in _UUIDS:
                return uuid.UUID(text)
            if tag == Tag.ULID:
                return Ulid.parse(text)
            return _TIMES[tag].fromisoformat(text) if tag in _TIMES else text
        if t.startswith("h'"):
            return bytes.fromhex(t[2:-1])
        if t in ("true", "false"):
            return t == "true"
        if t in ("NaN", "Infinity", "-Infinity"):
            return float(t.replace("Infinity", "inf"))
        if tag in _REALS or _NUMBER.search(t):
            return float(t.rstrip("fh"))
        return int(t)


def parse_record(text: str) -> Record:
    p = _Parser(text)
    out = p.record()
    if p.peek():
        raise ValueError("text is left after the record")
    return out


# --- fixed layouts -------------------------------------------------------------------------------------------------

# Field types of a layout, by number.
FIELD_TYPES = ("TEXT", "INT", "FLOAT", "BOOL", "ENUM")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class MetadataLayout:
    """An ordered list of fields; records against it name them by number and leave nulls out."""

    fields: tuple[Field, ...]

    def encode(self) -> bytes:
        out = struct.pack("<H", len(self.fields))
        for f in self.fields:
            raw = f.name.encode()
            out += struct.pack("<BH", FIELD_TYPES.index(f.type), len(raw)) + raw
            if f.type == "ENUM":
                out += struct.pack("<H", len(f.values)) + b"".join(struct.pack("<H", len(v.encode())) + v.encode() for v in f.values)
        return out

    @staticmethod
    def decode(raw: bytes) -> MetadataLayout:
        b, out = predicates._Bytes(raw), []
        for _ in range(b.take("H")):
            kind = FIELD_TYPES[b.take("B")]
            name = b.bytes(b.take("H")).decode()
            values = tuple(b.bytes(b.take("H")).decode() for _ in range(b.take("H"))) if kind == "ENUM" else ()
            out.append(Field(name, kind, values))
        return MetadataLayout(tuple(out))

    def encode_record(self, values: dict[str, Any]) -> bytes:
        """Unknown fields raise, as does a text outside its enum."""
        names = [f.name for f in self.fields]
        if unknown := set(values) - set(names):
            raise KeyError(f"unknown fields {sorted(unknown)}")
        out = b""
        for i, f in enumerate(self.fields):
            v = values.get(f.name)
            if v is None:
                continue
            out += struct.pack("<HB", i, FIELD_TYPES.index(f.type))
            if f.type == "TEXT":
                out += _sized(v.encode())
            elif f.type == "ENUM":
                if v not in f.values:
                    raise ValueError(f"{f.name}: {v!r} is none of {f.values}")
                out += struct.pack("<I", f.values.index(v))
            else:
                out += struct.pack({"INT": "<q", "FLOAT": "<d", "BOOL": "<?"}[f.type], v)
        return out

    def decode_record(self, raw: bytes) -> dict[str, Any]:
        b, out = predicates._Bytes(raw), {f.name: None for f in self.fields}
        while b.at < len(raw):
            f = self.fields[b.take("H")]
            kind = FIELD_TYPES[b.take("B")]
            if kind == "TEXT":
                out[f.name] = b.bytes(b.take("I")).decode()
            elif kind == "ENUM":
                out[f.name] = f.values[b.take("I")]
            else:
                out[f.name] = b.take({"INT": "q", "FLOAT": "d", "BOOL": "?"}[kind])
        return out

    def struct_type(self) -> T.StructType:
        kinds = {"TEXT": T.StringType(), "INT": T.LongType(), "FLOAT": T.DoubleType(), "BOOL": T.BooleanType(), "ENUM": T.StringType()}
        return T.StructType([T.StructField(f.name, kinds[f.type], True, {"values": list(f.values)} if f.values else {}) for f in self.fields])


def encode_results(ordinals: list[int]) -> bytes:
    return struct.pack(f"<I{len(ordinals)}i", len(ordinals), *ordinals)


def decode_results(raw: bytes) -> list[int]:
    (n,) = struct.unpack_from("<I", raw)
    return list(struct.unpack_from(f"<{n}i", raw, 4))


def encode_frame(rows: DataFrame, layout: MetadataLayout) -> DataFrame:
    """(ordinal, data) of (ordinal, the layout's fields), in Arrow batches; decode_frame() undoes it."""
    import pyarrow as pa

    names = [f.name for f in layout.fields]

    def run(batches):
        for b in batches:
            ordinals, *columns = (c.to_pylist() for c in b.columns)
            yield pa.record_batch([pa.array(ordinals, pa.int64()), pa.array([layout.encode_record(dict(zip(names, v))) for v in zip(*columns)], pa.binary())], names=["ordinal", "data"])

    kinds = {f.name: f.dataType for f in layout.struct_type().fields}
    return rows.select(F.col("ordinal").cast("long"), *[F.col(n).cast(kinds[n]) for n in names]).mapInArrow(run, "ordinal long, data binary")


def decode_frame(rows: DataFrame, layout: MetadataLayout, data: str = "data") -> DataFrame:
    """(ordinal, the layout's fields) of (ordinal, data), in Arrow batches."""
    import pyarrow as pa

    schema = T.StructType([T.StructField("ordinal", T.LongType()), *layout.struct_type().fields])
    names = [f.name for f in layout.fields]
    arrow = {"TEXT": pa.string(), "INT": pa.int64(), "FLOAT": pa.float64(), "BOOL": pa.bool_(), "ENUM": pa.string()}

    def run(batches):
        for b in batches:
            found = [layout.decode_record(r) for r in b.column(1).to_pylist()]
            columns = [pa.array([x[n] for x in found], arrow[f.type]) for n, f in zip(names, layout.fields)]
            yield pa.record_batch([b.column(0), *columns], names=["ordinal", *names])

    return rows.select(F.col("ordinal").cast("long"), data).mapInArrow(run, schema)


def results_frame(rows: DataFrame, data: str = "data") -> DataFrame:
    """(query, ordinals) of stored result lists (ordinal, data)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([decode_results(r) for r in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["query", "ordinals"])

    return rows.select(F.col("ordinal").cast("long"), data).mapInArrow(run, "query long, ordinals array<int>")
