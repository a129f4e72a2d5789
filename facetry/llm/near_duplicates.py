"""MinHash near-duplicates (operator 3): SuperMinHash signatures, banding, verification on full sets, components.

Equal sets are one node first. A signature has, per place, the smallest of correlated ranks: each shingle visits the
places in a random order of its own and brings the rank of the visit plus a random fraction, and visiting ends once no
later visit can lower any place. Nodes that agree in a band share a bucket. Each bucket's most connected member is
compared with the others; buckets that this leaves in several components are compared in full, in blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, release, slices, small, sweep, written
from ._words import Words, mix
from .components import components

SHINGLE, PERCENT = 5, 85
#: A pair at exactly the wanted similarity shares no band with a probability of MISS at most; a band has ROWS places,
#: or fewer where a signature would need more than PLACES.
MISS, ROWS, PLACES = 1e-5, 4, 128
#: Members of a block of a bucket, and shingles of all of them, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def banding(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows) for a similarity of `percent`: 16 x 4 at 85, 22 x 4 at 80, 41 x 2 at 50."""
    if not 0 < percent <= 100:
        raise ValueError("a similarity is above 0 and up to 100 percent")
    for rows in range(ROWS, 0, -1):
        apart = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(miss) / math.log(apart)) if apart > 0 else 1
        if bands * rows <= PLACES:
            return bands, rows
    raise ValueError(f"a similarity of {percent} percent needs more than {PLACES} places")


def superminhash(values: np.ndarray, owner: np.ndarray, count: int, m: int) -> np.ndarray:
    """Signatures (count, m) of `count` sets: values are 64-bit hashes of their elements, owner the set of each, ascending.

    Place p of a set keeps the least visit + fraction over its elements. Element e's visits follow a Fisher-Yates
    shuffle driven by its own random numbers. A set is done after visit j once all its places are below j + 1.
    """
    signature = np.full((count, m), np.inf)
    flat = signature.reshape(-1)
    state = values.copy()
    order = None
    for j in range(m):
        if not len(owner):
            break
        state = state + _STEP
        drawn = mix(state)
        fraction = (drawn >> np.uint64(12)).astype(np.float64) / float(1 << 52)
        pick = j + ((drawn & np.uint64(0xFFF)).astype(np.int64) * (m - j) >> 12)
        if j == 0:
            place = pick
        else:
            at = np.arange(len(owner))
            place = order[at, pick]
            order[at, pick] = order[at, j]
            order[at, j] = place
        np.minimum.at(flat, owner * m + place, j + fraction)
        open_ = (signature >= j + 1).any(1)[owner]
        if j == 0:
            order = np.tile(np.arange(m, dtype=np.uint8), (int(open_.sum()), 1))
            first = place[open_]
            at = np.arange(len(first))
            order[at, first] = 0
            order[at, 0] = first
        else:
            order = order[open_]
        state, owner = state[open_], owner[open_]
    return signature


def shingle_sets(texts: list[str | None], size: int = SHINGLE):
    """(values, owner) of the distinct shingle hashes of each text, ascending by text and value."""
    w = Words(texts, lower=True)
    counts = np.diff(w.firsts)
    whole = w.windows(size)
    owner = np.repeat(np.arange(len(texts)), np.maximum(counts - size + 1, 0))
    at = np.concatenate([np.arange(f, f + c - size + 1) for f, c in zip(w.firsts, counts) if c >= size]) if len(owner) else np.empty(0, np.int64)
    values = whole[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        values, owner = np.r_[values, np.array([w.short(i) for i in short], np.uint64)], np.r_[owner, short]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def signed(docs: DataFrame, bands: int, rows: int, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_key binary, bands array<long>) of (doc_id, text); key and bands are null for empty sets."""
    m = bands * rows
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        kept("near_duplicates")
        for batch in small(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], 1 << 20):
                values, owner = shingle_sets(texts[lo:hi], size)
                n = np.bincount(owner, minlength=hi - lo)
                ends = np.cumsum(n)
                keys = [hashlib.blake2b(values[e - k : e].tobytes(), digest_size=16).digest() if k else None for e, k in zip(ends, n)]
                signature = superminhash(values, owner, hi - lo, m).view(np.uint64).reshape(hi - lo, bands, rows)
                band = np.zeros((hi - lo, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    band = mix(band * _STEP + signature[:, :, r])
                band = [b if k else None for b, k in zip(band.view(np.int64).tolist(), n)]
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(band, schema.field(3).type)], schema=schema)

    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, kinds)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles binary): the sorted distinct shingle hashes of (node, text)."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        kept("near_duplicates")
        for batch in small(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], 1 << 20):
                values, owner = shingle_sets(texts[lo:hi], size)
                ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array([values[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "node long, shingles binary")


def similar(a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """Whether two sorted sets of 64-bit values have 100 * intersection >= percent * union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def block_links(left: list, right: list | None, percent: int = PERCENT):
    """Links between members (node, component, shingles) of two blocks, or within one, that join different components.

    Returns at most one link for each union of components: a forest.
    """
    members = left + (right or [])
    root = {c: c for _, c, _ in members}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    sets = [np.frombuffer(s, np.uint64) for _, _, s in members]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    # Equal values stand together: each value's members are a column of the incidence.
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    width = int(column[-1]) + 1
    common = np.zeros((len(members), len(members)))
    for lo in range(0, width, 8192):
        a, b = np.searchsorted(column, [lo, lo + 8192])
        part = np.zeros((len(members), min(8192, width - lo)), np.float32)
        part[who[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    n = len(left)
    pairs = np.argwhere(np.triu(linked, 1)) if right is None else np.argwhere(linked[:n, n:]) + [0, n]
    for i, j in pairs:
        a, b = find(members[i][1]), find(members[j][1])
        if a != b:
            root[max(a, b)] = min(a, b)
            yield members[i][0], members[j][0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`.

    Sets are the distinct `size`-word shingles of the lower-cased text (A-Z), or all its words in one where they are
    fewer; a null text, or one without words, has the empty set, which links with nothing. Documents with similarity of
    `percent` or more are linked; component_id is the smallest linked id, kept whether that is the row's own. Rows of
    one id count as one document that has the links of all of them. A pair of exactly that similarity shares no band, and
    its link is lost, with a probability of `miss` at most; a smaller one costs more bands. A row with a null id has no component and is kept.
    Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    table = written(signed(rows, *banding(percent, miss), size=size), "signatures")
    usable = table.where("doc_id is not null and set_key is not null")
    # Copies of a set are combined in each task before they meet.
    nodes = usable.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").alias("node"), "n_shingles", "bands")).alias("n")).select("n.*")
    keys = usable.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    entries = written(nodes.select("node", "n_shingles", F.explode("bands").alias("key")), "bands")
    # What is joined on a bucket's key is written first: Spark can then split the partition of a large bucket.
    full = written(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "full")
    shared = written(entries.join(full, "key"), "buckets")
    release(entries, full)
    # The hub of a bucket is its member with the most places in buckets, weighted by their size; then the smallest id.
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = shared.join(weight, "node")
    hub = weighed.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n"))).alias("h")).select("key", "h.hub", "h.hub_n")
    hub = written(hub, "hubs")
    ratio = 100 * F.least("n_shingles", "hub_n") >= percent * F.greatest("n_shingles", "hub_n")
    pairs = shared.join(hub, "key").where("node <> hub").where(ratio).select("hub", "node").distinct()
    wanted = shared.select("node").distinct()
    sets = written(_sets(rows.withColumnRenamed("doc_id", "node").join(wanted.hint("shuffle_hash"), "node").select("node", "text"), size), "sets")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        kept("near_duplicates")
        for b in small(batches):
            keep = pa.array([similar(x, y, percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], schema=schema)

    facing = pairs.join(sets, "node").withColumnRenamed("shingles", "x").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("y")), "hub")
    links = written(facing.select("hub", "node", "x", "y").mapInArrow(verify, "a long, b long"), "verified")
    first = written(components(links), "components")
    # Buckets of three or more whose members are still in several components: everything in them is compared.
    placed = shared.where("size > 2").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("lo < hi").select("key", "blocks")
    mixed = written(mixed, "unsettled")
    rest = written(placed.select("key", "node", "component").join(mixed, "key"), "mixed")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    # A block meets every block of its bucket once: (low, high) names the meeting.
    meet = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component").join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        kept("near_duplicates")
        low = pdf["low"].iat[0]
        members = lambda x: list(zip(x["node"], x["component"], x["shingles"]))
        mine = pdf["own"] == low
        found = list(block_links(members(pdf[mine]), None if mine.all() else members(pdf[~mine]), percent))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    more = meet.groupBy("key", "low", "high").applyInPandas(compare, "a long, b long")
    second = written(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")
    release(shared, rest, sets, links, first, hub, mixed)
    sweep(docs.sparkSession)
    found = second.withColumnRenamed("component", "least")
    # Rows of one id may have several sets: their smallest component is that of the id.
    labels = written(keys.join(found, "node", "left").select("set_key", F.coalesce("least", "node").alias("least")), "labels")
    marked = table.join(labels, "set_key", "left")
    return marked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
