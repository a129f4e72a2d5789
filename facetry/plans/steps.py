"""Command streams: steps of a manifest run in the order of their files, skipped where their output is fresh and whole.

A step is a map with `run` (the command), perhaps `id`, `after` and `on-partial`, and the command's options; `${name}`
takes a default of the stream or a value given when it is run.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.units import count
from ..operators import generators, integrity, neighbors, statistics
from ..sources import slab, storage, xvec

COMPLETE, PARTIAL, ABSENT = "complete", "partial", "absent"
INPUTS = ("base", "query", "source", "from", "indices")
OUTPUTS = ("output", "distances")


@dataclass(frozen=True)
class Step:
    id: str
    run: str
    options: dict
    after: tuple[str, ...] = ()
    on_partial: str = "restart"

    def files(self, names: tuple[str, ...]) -> list[str]:
        return [str(self.options[n]) for n in names if n in self.options]


@dataclass
class Stream:
    steps: list[Step]
    home: str = "."
    log: list[tuple[str, str]] = field(default_factory=list)


def parse(data: str | Mapping, values: Mapping[str, object] | None = None, home: str = ".") -> Stream:
    """The steps under `upstream`, with the facets' own after the shared ones. An unknown `${name}` raises."""
    data = yaml.safe_load(data) if isinstance(data, str) else data
    up = data.get("upstream") or {}
    known = {k: str(v) for k, v in (up.get("defaults") or {}).items()} | {k: str(v) for k, v in (values or {}).items()}

    def put(v):
        return re.sub(r"\$\{(\w+)\}", lambda m: known[m[1]], v) if isinstance(v, str) else v

    raw = list(up.get("steps") or [])
    for profile in (data.get("profiles") or {}).values():
        for facet in profile.values() if isinstance(profile, Mapping) else ():
            if isinstance(facet, Mapping):
                raw += [{"output": facet.get("source"), **s} for s in facet.get("upstream") or ()]
    steps, seen = [], set()
    for s in raw:
        name, n = str(s.get("id") or s["run"].replace(" ", "-")), 1
        base = name
        while name in seen:
            n += 1
            name = f"{base}-{n}"
        seen.add(name)
        options = {k: put(v) for k, v in s.items() if k not in ("run", "id", "after", "on-partial") and v is not None}
        after = s.get("after") or ()
        steps.append(Step(name, put(s["run"]), options, (after,) if isinstance(after, str) else tuple(after), s.get("on-partial", "restart")))
    return Stream(steps, home)


def ordered(steps: list[Step]) -> list[Step]:
    """Steps after those that they name and those that make their inputs; a circle raises."""
    makers = {f: s.id for s in steps for f in s.files(OUTPUTS)}
    graph = {s.id: {*s.after, *(makers[f] for f in s.files(INPUTS) if f in makers and makers[f] != s.id)} for s in steps}
    by = {s.id: s for s in steps}
    if unknown := set().union(*graph.values(), set()) - by.keys():
        raise KeyError(f"unknown steps {sorted(unknown)}")
    return [by[i] for i in TopologicalSorter(graph).static_order()]


def state(path: str) -> str:
    """Whether a file is there and whole, by its format."""
    if not os.path.exists(path):
        return ABSENT
    try:
        ext = path.rpartition(".")[2]
        if ext.rstrip("s") in xvec.ELEMENTS or ext in xvec.ELEMENTS:
            xvec.layout(path)
        elif ext == "slab":
            if slab.check(path):
                return PARTIAL
        elif ext in ("mrkl", "mref"):
            integrity.load(path)
        elif ext == "parquet" and os.path.isfile(path):
            n = storage.size(path)
            if n < 12 or storage.read_range(path, n - 4, 4) != b"PAR1":
                return PARTIAL
        elif ext == "json":
            yaml.safe_load(storage.read_range(path, 0, storage.size(path)))
    except Exception:
        return PARTIAL
    return COMPLETE


def fresh(outputs: list[str], inputs: list[str]) -> bool:
    if not outputs or any(state(o) != COMPLETE for o in outputs):
        return False
    oldest = min(os.path.getmtime(o) for o in outputs)
    return all(not os.path.exists(i) or os.path.getmtime(i) <= oldest for i in inputs)


COMMANDS: dict[str, Callable[[SparkSession, dict], None]] = {}


def command(name: str):
    def add(f):
        COMMANDS[name] = f
        return f

    return add


def _save(df, path: str) -> None:
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    xvec.write(df, parts, path.rpartition(".")[2])
    xvec.assemble(parts, path)
    shutil.rmtree(parts)


@command("generate vectors")
def _generate(spark, o):
    _save(generators.random_vectors(spark, count(str(o["count"])), int(o["dimension"]), lo=float(o.get("min", 0)), hi=float(o.get("max", 1)), seed=int(o.get("seed", 42))), o["output"])


@command("generate ivec-shuffle")
def _shuffle(spark, o):
    n = count(str(o["interval"]))
    order = generators.shuffled(spark.range(n).withColumnRenamed("id", "ordinal"), int(o.get("seed", 42)))
    _save(order.select(F.col("place").alias("ordinal"), F.array(F.col("ordinal").cast("int")).alias("vector")), o["output"])


@command("generate fvec-extract")
def _extract(spark, o):
    from ..operators.windows import Interval

    at = xvec.read(spark, o["indices"]).select(F.col("ordinal").alias("place"), F.col("vector")[0].cast("long").alias("ordinal"))
    r = Interval.parse(str(o["range"])) if "range" in o else Interval(0, 1 << 62)
    _save(generators.extract(xvec.read(spark, o["source"]), at, r.lo, r.hi), o["output"])


@command("compute knn")
def _knn(spark, o):
    found = neighbors.facets(neighbors.knn(xvec.read(spark, o["base"]), xvec.read(spark, o["query"]), int(o["neighbors"]), o.get("metric", "DOT_PRODUCT")))
    _save(found.select("ordinal", F.col("indices").cast("array<int>").alias("vector")), o["output"])
    if "distances" in o:
        _save(found.select("ordinal", F.col("distances").cast("array<float>").alias("vector")), o["distances"])


@command("convert file")
def _convert(spark, o):
    _save(xvec.read(spark, o["source"]), o["output"])


@command("cleanup cleanfvec")
def _clean(spark, o):
    rows = statistics.cleaned(xvec.read(spark, o["source"]))
    _save(xvec.dense(rows.select(F.col("ordinal").alias("row"), "vector"), "row").select("ordinal", "vector"), o["output"])


@command("slab import")
def _import(spark, o):
    slab.import_file(o["from"], o["output"], o.get("format"), o.get("namespace", ""))


@command("merkle create")
def _merkle(spark, o):
    shape = integrity.Shape.of(storage.size(o["source"]))
    hashes = [bytes.fromhex(r["hash"]) for r in integrity.file_chunks(spark, o["source"], shape).orderBy("chunk").collect()]
    integrity.save(o["output"], shape, integrity.tree(hashes))


def run(spark: SparkSession, stream: Stream, dry_run: bool = False) -> list[tuple[str, str]]:
    """Run the stream; returns (step, `skipped`, `planned` or `done`). The first failure ends it.

    A partial output is removed before its step is run again, unless the step resumes; an output that is partial after
    its step has ended is an error.
    """
    for s in ordered(stream.steps):
        options = {k: f"{stream.home}/{v}" if k in INPUTS + OUTPUTS and not str(v).startswith("/") else v for k, v in s.options.items()}
        at = Step(s.id, s.run, options, s.after, s.on_partial)
        if s.run not in COMMANDS:
            raise KeyError(f"unknown command {s.run!r}")
        outputs = at.files(OUTPUTS)
        if fresh(outputs, at.files(INPUTS)):
            stream.log.append((s.id, "skipped"))
            continue
        if dry_run:
            stream.log.append((s.id, "planned"))
            continue
        for o in outputs:
            if state(o) == PARTIAL and s.on_partial == "restart":
                os.remove(o)
        COMMANDS[s.run](spark, options)
        if wrong := [o for o in outputs if state(o) != COMPLETE]:
            raise RuntimeError(f"step {s.id} left {wrong} incomplete")
        stream.log.append((s.id, "done"))
    return stream.log
