"""Dataset manifests, profiles and catalogs: small driver-side objects that resolve to lazy DataFrames."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import count
from ..operators.distances import canonical
from ..operators.windows import Window, sized_profiles
from . import slab, sqlite, storage, xvec

# Facets, and other names for them.
FACETS = (
    "base_vectors", "base_content", "query_vectors", "query_terms", "query_filters", "neighbor_indices", "neighbor_distances",
    "metadata_predicates", "predicate_results", "metadata_layout", "metadata_content", "filtered_neighbor_indices", "filtered_neighbor_distances",
)
ALIASES = {
    "base": "base_vectors", "train": "base_vectors", "queries": "query_vectors", "test": "query_vectors", "query": "query_vectors",
    "indices": "neighbor_indices", "neighbors": "neighbor_indices", "ground_truth": "neighbor_indices", "gt": "neighbor_indices", "distances": "neighbor_distances",
    "meta_predicates": "metadata_predicates", "meta_results": "predicate_results", "meta_layout": "metadata_layout", "layout": "metadata_layout",
    "meta_content": "metadata_content", "content": "metadata_content", "meta_base": "metadata_content",
    "filtered_indices": "filtered_neighbor_indices", "filtered_gt": "filtered_neighbor_indices", "filtered_ground_truth": "filtered_neighbor_indices",
    "filtered_distances": "filtered_neighbor_distances", "filtered_neighbors": "filtered_neighbor_distances",
}
# The names of vector views; here `neighbors` are the distances.
VIEWS = {
    "base": ("base_vectors", "train"), "query": ("query_vectors", "queries", "test"), "indices": ("neighbor_indices", "ground_truth", "gt"), "neighbors": ("neighbor_distances", "distances"),
    "filtered_indices": ("filtered_neighbor_indices", "filtered_gt", "filtered_ground_truth"), "filtered_neighbors": ("filtered_neighbor_distances", "filtered_distances"),
}


def facet_name(name: str) -> str:
    """The canonical facet of a name, or the name itself."""
    low = name.lower().lstrip("/")
    return low if low in FACETS else ALIASES.get(low, name)


def view_name(name: str) -> str:
    low = name.lower()
    for view, others in VIEWS.items():
        if low == view or low in others:
            return view
    raise ValueError(f"no vector view named {name!r}")


@dataclass(frozen=True)
class Source:
    """`path[:namespace][:][window]`."""

    path: str
    namespace: str | None = None
    window: Window = Window()

    @staticmethod
    def of(data) -> Source:
        if isinstance(data, Source):
            return data
        if isinstance(data, Mapping):
            path = data.get("path") or data.get("source")
            return Source(path, data.get("namespace"), Window.of(data.get("window")))
        m = re.fullmatch(r"([^:\[(]+)(?::([^:\[(]+))?(?::?([\[(][^\])]+[\])]))?", data)
        return Source(m[1], m[2], Window.of(m[3])) if m else Source(data)

    @property
    def kind(self) -> str:
        ext = self.path.rpartition(".")[2].lower()
        return {"slab": "slab", "db": "sqlite", "sqlite": "sqlite", "parquet": "parquet"}.get(ext, "xvec")


@dataclass(frozen=True)
class View:
    source: Source
    window: Window = Window()

    @staticmethod
    def of(data) -> View:
        if isinstance(data, Mapping):
            source = Source.of(data["source"] if "source" in data else data)
            return View(source, Window.of(data.get("window")) if "source" in data else Window())
        return View(Source.of(data))

    @property
    def effective(self) -> Window:
        """The view's window, or else that of its source."""
        return self.window or self.source.window


@dataclass
class Profile:
    name: str
    views: dict[str, View]
    maxk: int | None = None
    base_count: int | None = None

    @staticmethod
    def of(name: str, data: Mapping, default: Profile | None = None) -> Profile:
        views = {facet_name(str(k)): View.of(v) for k, v in data.items() if k not in ("maxk", "base_count")}
        maxk = data.get("maxk")
        base = data.get("base_count")
        return Profile(name, views, None if maxk is None else int(maxk), None if base is None else count(base)).inherit(default)

    def inherit(self, default: Profile | None) -> Profile:
        """Facets and maxk that are missing, from the default profile; never its base count."""
        if default:
            self.views = self.views | {k: v for k, v in default.views.items() if k not in self.views}
            self.maxk = default.maxk if self.maxk is None else self.maxk
        return self


def profiles_of(data: Mapping) -> dict[str, Profile]:
    """`default` first, then the sized ones, then the rest, which take what they lack from `default`."""
    out: dict[str, Profile] = {}
    default = None
    if "default" in data:
        default = out["default"] = Profile.of("default", data["default"])
    if "sized" in data:
        sized = data["sized"]
        specs = sized.get("ranges") if isinstance(sized, Mapping) else sized
        facets = sized.get("facets") or {} if isinstance(sized, Mapping) else {}
        for name, n in sized_profiles([specs] if isinstance(specs, str) else list(specs)).items():
            views = {k: str(v).replace("${range}", f"[0..{n})").replace("${profile}", name) for k, v in facets.items()}
            p = Profile.of(name, views, default)
            p.base_count = n
            out[name] = p
    for name, v in data.items():
        if name not in ("default", "sized"):
            out[name] = Profile.of(name, v, default)
    return out


@dataclass
class Dataset:
    """A manifest: attributes, variables and profiles; facets are read relative to its folder."""

    name: str
    home: str
    attributes: dict
    profiles: dict[str, Profile]
    variables: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Dataset:
        """From `dataset.yaml` or its folder; `variables.yaml` beside it overrides variables of its own."""
        if not path.endswith((".yaml", ".yml")):
            path = path.rstrip("/") + "/dataset.yaml"
        home = path.rpartition("/")[0] or "."
        text = storage.read_range(path, 0, storage.size(path)).decode()
        data = yaml.safe_load(text) or {}
        variables = dict(data.get("variables") or {})
        try:
            beside = f"{home}/variables.yaml"
            variables |= yaml.safe_load(storage.read_range(beside, 0, storage.size(beside))) or {}
        except OSError:
            pass
        return Dataset(home.rpartition("/")[2], home, dict(data.get("attributes") or {}), profiles_of(data.get("profiles") or {}), variables, dict(data.get("tags") or {}))

    @property
    def distance_function(self) -> str:
        return canonical(self.attributes.get("distance_function"))

    def profile(self, name: str = "default") -> Profile:
        try:
            return self.profiles[name]
        except KeyError:
            raise KeyError(f"{self.name} has no profile {name!r}; it has {sorted(self.profiles)}") from None

    def facet(self, spark: SparkSession, facet: str, profile: str = "default") -> DataFrame:
        """A facet as a DataFrame: (ordinal, vector) for vector files, (ordinal, data) for stores, Parquet as it is."""
        p = self.profile(profile)
        kind = facet_name(facet)
        if kind not in p.views:
            raise KeyError(f"profile {profile!r} has no facet {kind!r}")
        view = p.views[kind]
        path = view.source.path if re.match(r"\w+://|/", view.source.path) else f"{self.home}/{view.source.path}"
        if view.source.kind == "slab":
            store = slab.Store.open(path)
            ns = view.source.namespace or (kind if kind in store.pages else store.namespace(None))
            df = slab.read(spark, path, ns).select("ordinal", "data")
        elif view.source.kind == "sqlite":
            df = sqlite.read(spark, path, view.source.namespace or kind)
        elif view.source.kind == "parquet":
            df = spark.read.parquet(path)
        else:
            df = xvec.read(spark, path)
        df = view.effective.apply(df)
        if kind == "base_vectors" and p.base_count is not None:
            df = df.where(F.col("ordinal") < p.base_count)
        if p.maxk is not None and kind.startswith(("neighbor", "filtered_neighbor")) and "vector" in df.columns:
            df = df.withColumn("vector", F.slice("vector", 1, p.maxk))
        return df

    def register(self, spark: SparkSession, profile: str = "default") -> list[str]:
        """Temporary views <dataset>__<profile>__<facet>."""
        names = []
        for kind in self.profile(profile).views:
            names.append(re.sub(r"\W", "_", f"{self.name}__{profile}__{kind}"))
            self.facet(spark, kind, profile).createOrReplaceTempView(names[-1])
        return names

    def token(self, spark: SparkSession, name: str, profile: str = "default") -> str | None:
        """Facts by name: counts, dimensions, max_k, distance_function, or an attribute."""
        name = name.lower()
        short = {"b": "base_vectors", "q": "query_vectors", "d": "dimensions", "k": "max_k", "mk": "max_k", "m": "model", "v": "vendor", "df": "distance_function"}
        name = short.get(name, name)
        if name in self.attributes:
            return str(self.attributes[name])
        if name == "distance_function":
            return self.distance_function
        views = self.profile(profile).views
        if name in FACETS and name in views:
            return str(self.facet(spark, name, profile).count())
        source = {"dimensions": "base_vectors", "max_k": "neighbor_indices", "filtered_max_k": "filtered_neighbor_indices"}.get(name)
        if source in views:
            row = self.facet(spark, source, profile).select(F.size("vector")).first()
            return None if row is None else str(row[0])
        return None


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    layout: dict
    dataset_type: str = "dataset.yaml"


def dataset_spec(text: str) -> tuple[str, str | None]:
    """(dataset, profile) of `dataset`, `dataset:profile` or `dataset.profile`; `\\` takes the next character as it is."""
    parts: list[str] = [""]
    text = (text or "").strip()
    if not text:
        raise ValueError("an empty dataset spec")
    plain = re.findall(r"\\(.)|([^\\])|(\\\Z)", text, re.S)
    for escaped, c, dangling in plain:
        if dangling:
            raise ValueError(f"{text!r} ends in an escape")
        if not escaped and c in ":.":
            if len(parts) == 2:
                raise ValueError(f"{text!r} has more than one separator")
            parts.append("")
        else:
            parts[-1] += escaped or c
    name, profile = parts[0].strip(), parts[1].strip() if len(parts) == 2 else ""
    if not name or "." in name:
        raise ValueError(f"{text!r} names no dataset")
    return name, profile or None


@dataclass
class Catalog:
    entries: list[Entry]

    @staticmethod
    def load(required: list[str], optional: list[str] = ()) -> Catalog:
        """The entries of `catalog.json` lists at paths or folders; missing optional ones are left out."""
        out = []
        for path in [*required, *optional]:
            full = path if path.endswith(".json") else path.rstrip("/") + "/catalog.json"
            try:
                data = json.loads(storage.read_range(full, 0, storage.size(full)))
            except OSError:
                if path in required:
                    raise
                continue
            home = full.rpartition("/")[0]
            for e in data:
                at = e["path"] if re.match(r"\w+://|/", e["path"]) else f"{home}/{e['path']}"
                out.append(Entry(e["name"], at, e.get("layout", {}), e.get("dataset_type", "dataset.yaml")))
        return Catalog(out)

    def find(self, name: str) -> Entry | None:
        """The entry of a name, whatever its case; several raise."""
        return self._one([e for e in self.entries if e.name.lower() == name.lower()], name)

    @staticmethod
    def _one(found: list[Entry], what: str) -> Entry | None:
        if len(found) > 1:
            raise ValueError(f"{what!r} names several datasets: {[e.name for e in found]}")
        return found[0] if found else None

    def glob(self, pattern: str) -> list[Entry]:
        """Entries whose name matches; `*` stays within a `/`, `**` doesn't."""
        regex = re.escape(pattern).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return [e for e in self.entries if re.fullmatch(regex, e.name)]

    def regex(self, pattern: str) -> list[Entry]:
        return [e for e in self.entries if re.fullmatch(pattern, e.name)]

    def match_one(self, pattern: str) -> Entry | None:
        """One entry by its exact name, a glob or a regular expression; several raise."""
        exact = self.find(pattern)
        return exact or self._one(self.glob(pattern) if any(c in pattern for c in "*?") else self._regex_or_none(pattern), pattern)

    def _regex_or_none(self, pattern: str) -> list[Entry]:
        try:
            return self.regex(pattern)
        except re.error:
            return []

    def suggest(self, part: str) -> list[str]:
        return sorted(e.name for e in self.entries if part.lower() in e.name.lower())

    def select(self, spec: str) -> tuple[Dataset, str]:
        """(dataset, profile) of a spec; an unknown name raises and says which ones are like it."""
        name, profile = dataset_spec(spec)
        e = self.find(name)
        if e is None:
            raise KeyError(f"no dataset {name!r}; like it: {self.suggest(name)}")
        return Dataset.load(e.path), profile or "default"

    def frame(self, spark: SparkSession) -> DataFrame:
        """(name, path, dataset_type, profiles, attributes) of the entries."""
        rows = [(e.name, e.path, e.dataset_type, sorted(e.layout.get("profiles", {})), {k: str(v) for k, v in e.layout.get("attributes", {}).items()}) for e in self.entries]
        return spark.createDataFrame(rows, "name string, path string, dataset_type string, profiles array<string>, attributes map<string,string>")

    @staticmethod
    def emit(folder: str) -> list[dict]:
        """Entries for the manifests below a local folder, written there as `catalog.json`."""
        out = []
        for d, _, names in sorted(os.walk(folder)):
            if "dataset.yaml" in names:
                with open(f"{d}/dataset.yaml") as f:
                    data = yaml.safe_load(f) or {}
                out.append({"layout": {k: data.get(k, {}) for k in ("attributes", "profiles")}, "dataset_type": "dataset.yaml", "name": os.path.basename(d), "path": os.path.relpath(f"{d}/dataset.yaml", folder)})
        with open(f"{folder}/catalog.json", "w") as f:
            json.dump(out, f, indent=1)
        return out


def catalog_sources(folder: str) -> tuple[list[str], list[str]]:
    """(required, optional) catalogs of `catalogs.yaml` in a settings folder: a list, or lists under those names; `~` is
    the home folder, and optional local ones that don't exist are left out."""
    path = f"{os.path.expanduser(folder)}/catalogs.yaml"
    if not os.path.exists(path):
        return [], []
    with open(path) as f:
        data = yaml.safe_load(f) or []
    required, optional = (data.get("required") or [], data.get("optional") or []) if isinstance(data, dict) else (data, [])
    full = [os.path.expanduser(p) for p in required]
    rest = [os.path.expanduser(p) for p in optional]
    return full, [p for p in rest if "://" in p or os.path.exists(p)]
