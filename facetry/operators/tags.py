"""Tag filters: conditions on a map of tags, compiled to a column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TagFilter:
    """`all(...)` (the default), `any(...)` or `none(...)` over comma-separated `key`, `key:regex` or `key=regex`."""

    mode: str
    conditions: dict[str, str | None]

    @staticmethod
    def parse(spec: str | None) -> TagFilter:
        """An empty spec has no conditions. Another word than all, any or none before brackets raises; brackets with
        nothing in them are part of a key, as in `any()`."""
        text = _unquoted((spec or "").strip())
        m = re.fullmatch(r"\s*(\w+)\s*\((.+)\)\s*", text, re.S)
        if m and m[1].lower() not in ("all", "any", "none"):
            raise ValueError(f"a filter is all(...), any(...) or none(...): {spec!r}")
        mode, body = (m[1].lower(), m[2]) if m else ("all", text)
        out: dict[str, str | None] = {}
        for part in re.split(r", *", body) if body else []:
            key, found, value = re.match(r"([^:=]*)([:=]?)(.*)", part, re.S).groups()
            out[key] = _unquoted(value).strip() if found else None
        return TagFilter(mode, out)

    def matches(self, tags: dict[str, str | None]) -> bool:
        hits = sum(self._one(tags, k, v)[0] for k, v in self.conditions.items())
        return {"all": hits == len(self.conditions), "any": hits > 0, "none": hits == 0}[self.mode]

    def explain(self, tags: dict[str, str | None]) -> list[str]:
        """A line for each condition, saying what was compared and whether it held."""
        return [("held: " if ok else "failed: ") + said for ok, said in (self._one(tags, k, v) for k, v in self.conditions.items())] or [f"an empty filter on {tags}"]

    @staticmethod
    def _one(tags, key, pattern):
        use = key[:-1] if tags.get(key) is None and key.endswith("s") else key
        value = tags.get(use)
        said = f"filter {key}{'' if pattern is None else ':' + pattern} on tag {use}={value!r}"
        return (use in tags if pattern is None else value is not None and re.fullmatch(pattern, value) is not None), said

    def column(self, tags: Column) -> Column:
        """The same test on a map<string,string> column; a null map has no tags."""
        tags = F.coalesce(tags, F.create_map().cast("map<string,string>"))
        hits = F.lit(0)
        for key, pattern in self.conditions.items():
            use = F.lit(key)
            if key.endswith("s"):
                use = F.when(F.try_element_at(tags, F.lit(key)).isNull(), F.lit(key[:-1])).otherwise(use)
            value = F.try_element_at(tags, use)
            test = F.array_contains(F.map_keys(tags), use) if pattern is None else value.rlike(rf"\A(?:{pattern})\z")
            hits = hits + F.coalesce(test, F.lit(False)).cast("int")
        n = len(self.conditions)
        return {"all": hits == n, "any": hits > 0, "none": hits == 0}[self.mode]


_QUOTED = re.compile(r"""'([^']+|)'|"([^"]+|)\"""", re.S)


def _unquoted(text: str) -> str:
    """`text` without the quotes around it; one kind may stand within the other."""
    while found := _QUOTED.fullmatch(text):
        text = found[found.lastindex]
    return text
