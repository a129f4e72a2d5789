"""Counts, byte sizes and durations written with units."""

from __future__ import annotations

import re

# Count units.
COUNTS = {"u": 1, "unit": 1, "k": 10**3, "kilo": 10**3, "m": 10**6, "mega": 10**6, "b": 10**9, "billion": 10**9, "g": 10**9, "giga": 10**9, "t": 10**12, "tera": 10**12, "p": 10**15, "peta": 10**15, "e": 10**18, "exa": 10**18}
# Byte units, decimal and binary.
BYTES = {"b": 1, "byte": 1, "kb": 10**3, "kilobyte": 10**3, "mb": 10**6, "megabyte": 10**6, "gb": 10**9, "gigabyte": 10**9, "tb": 10**12, "terabyte": 10**12, "pb": 10**15, "petabyte": 10**15, "eb": 10**18, "exabyte": 10**18,
         "kib": 2**10, "kibibyte": 2**10, "mib": 2**20, "mebibyte": 2**20, "gib": 2**30, "gibibyte": 2**30, "tib": 2**40, "tebibyte": 2**40, "pib": 2**50, "pebibyte": 2**50, "eib": 2**60, "exbibyte": 2**60}
# Duration units in nanoseconds.
NANOS = {"ns": 1, "nanoseconds": 1, "µs": 10**3, "us": 10**3, "microseconds": 10**3, "ms": 10**6, "milliseconds": 10**6, "s": 10**9, "seconds": 10**9, "m": 60 * 10**9, "minutes": 60 * 10**9,
         "h": 3600 * 10**9, "hours": 3600 * 10**9, "d": 86400 * 10**9, "days": 86400 * 10**9, "w": 604800 * 10**9, "weeks": 604800 * 10**9, "y": 31536000 * 10**9, "years": 31536000 * 10**9}
LONG_MAX = (1 << 63) - 1

_NUMBER = re.compile(r"\s*(\d+(?:\.\d+)?(?:E\d+)?)\s*([^\d\s]\S*)?\s*")


def _split(text: str, units: dict[str, int]):
    m = _NUMBER.fullmatch(text)
    if not m:
        return None
    number, unit = m[1], m[2]
    if unit is None:
        return number, 1
    if unit.lower() not in units:
        raise ValueError(f"unknown unit {unit!r} in {text!r}")
    return number, units[unit.lower()]


def count(text: str | int) -> int:
    """A whole count: `1000`, `1_000`, `10m`, `2^20`, `1E6`, `MAX`. Raises where the text is none."""
    if isinstance(text, int):
        return text
    spec = text.strip().replace("_", "")
    if spec == "MAX":
        return LONG_MAX
    power = re.fullmatch(r"(\d+)\s*\^\s*(\d+)\s*(\w*)", spec)
    if power:
        if power[1] == "2" and int(power[2]) > 63:
            raise ValueError("powers of two go up to 63")
        spec = f"{int(power[1]) ** int(power[2])}{power[3]}"
    got = _split(spec, COUNTS)
    if got is None:
        raise ValueError(f"no count: {text!r}")
    number, unit = got
    return int(number) * unit if number.isdigit() else int(float(number)) * unit


def size_in_bytes(text: str, unit: str = "b") -> float:
    got = _split(text, BYTES)
    if got is None:
        raise ValueError(f"no size: {text!r}")
    return float(got[0]) * got[1] / BYTES[unit.lower()]


def duration(text: str, unit: str = "ms") -> int:
    """A duration in whole `unit`s; a bare number already counts them."""
    m = _NUMBER.fullmatch(text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    if m[2] is None:
        return int(float(m[1]))
    return int(float(m[1]) * (_split(text, NANOS)[1] / NANOS[unit]))


def short_count(n: int) -> str:
    """A count with the largest of t, b, m, k that divides it."""
    for unit, scale in (("t", 10**12), ("b", 10**9), ("m", 10**6), ("k", 10**3)):
        if n >= scale and n % scale == 0:
            return f"{n // scale}{unit}"
    return str(n)
