"""MinHash near-dedup with SetSketch registers.

Per document: its set of word shingles, a 128-bit fingerprint of that set, and 128 registers.  Register i holds the
truncated, exponentially spaced minimum ``clip(floor(1 - log_b(min_d h_i(d))), 0, q + 1)`` over the shingles d, with
h_i(d) independent exponentials; the maximum of two sketches is the sketch of the union.  The exponentials of a shingle
are the arrivals of one Poisson process dealt to random registers, so a shingle costs about one step once the registers
are full.

Documents with equal sets become one class first, so thousands of copies count once.  Classes meet in buckets of equal
register bands (32 bands of 4; a pair at similarity 0.8 meets with probability 1 - 5e-8).  Each bucket first compares
every member with one pivot.  A pair goes on if the joint likelihood of its register differences, with both set sizes
known, has its maximum at 0.8 less six standard errors at least; it is then confirmed on the full sets.  Buckets whose
members lie in one component by then are done.  In the others, all members meet those outside the bucket's largest
component, in blocks of 512 by 512, on their full sets; each block returns a spanning forest of its links.  So no bucket
is ever held in one task, none is capped, and no group's pairs are listed.

Defined results: a text without words has an empty set and links with nothing; repeated rows are copies; ids may be
null (such a row can be linked but never names its component unless all in it are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, hash128, pick_rows
from .graph import components
from .textkit import GOLDEN, map_arrow, mix64, shingle_set

REGISTERS = 128
BANDS = 32
BASE = 1.001
RATE = 20.0
TOP = 2**16 - 2
#: Members of a bucket that meet in one task, on either side.
BLOCK = 512
#: Shingles that are counted in one matrix product.
COLUMNS = 1 << 14
#: Shingles sketched together; keeps a worker's arrays within a few megabytes.
CHUNK = 1 << 18


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of some sets of 64-bit hashes: an array (len(sets), REGISTERS) of uint16."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    least = np.full(len(sets) * REGISTERS, np.inf)
    item = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    time, turn = np.zeros(len(item)), np.uint64(0)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        while len(item):
            turn += np.uint64(1)
            r = mix64(mix64(item + turn * GOLDEN) ^ item)
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            np.minimum.at(least, doc * REGISTERS + (r & np.uint64(REGISTERS - 1)).astype(np.int64), time)
            alive = time < least.reshape(-1, REGISTERS).max(1)[doc]
            item, doc, time = item[alive], doc[alive], time[alive]
        level = np.floor(1 - np.log(least / (REGISTERS * RATE)) / np.log(BASE))
    return np.clip(np.nan_to_num(level, neginf=0), 0, TOP + 1).astype(np.uint16).reshape(-1, REGISTERS)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def likeliest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood Jaccard similarity of pairs of sketches (rows of a and b) with set sizes n_a and n_b."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p_more, p_less = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
    p_equal = np.clip(1 - p_more - p_less, 1e-9, 1)
    best = (more * np.log(p_more) + less * np.log(p_less) + equal * np.log(p_equal)).argmax(1)
    return j[np.arange(len(j)), best]


def _lowest(threshold: float) -> float:
    return threshold - 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sets = [shingle_set(t, size) for t in texts]
            regs, part, held = [], [], 0
            for s in sets:
                part.append(s)
                held += len(s)
                if held >= CHUNK:
                    regs.append(registers(part))
                    part, held = [], 0
            regs = np.concatenate([*regs, registers(part)]) if part or regs else np.empty((0, REGISTERS), np.uint16)
            with np.errstate(over="ignore"):
                keys = np.arange(BANDS, dtype=np.uint64) + np.zeros((len(sets), 1), np.uint64)
                for i in range(REGISTERS // BANDS):
                    keys = mix64(keys * GOLDEN + regs.reshape(len(sets), BANDS, -1)[:, :, i])
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
            ], ["doc_id", "n", "fp", "regs", "bands"])

    return run


def _likely(threshold: float):
    """Keeps the pairs (a, b, n_a, n_b, regs_a, regs_b) whose likeliest similarity may reach the threshold."""
    low = _lowest(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            a, b = (np.array([np.frombuffer(x, np.uint16) for x in batch.column(i).to_pylist()]).reshape(-1, REGISTERS) for i in (4, 5))
            keep = (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-6) & (likeliest(a, b, n_a, n_b) >= low)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        sides = []
        for sets in (left, right):
            item, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            place = np.minimum(np.searchsorted(part, item), len(part) - 1)
            hit = part[place] == item
            m = np.zeros((len(sets), len(part)), np.float32)
            m[owner[hit], place[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _block_links(percent: int):
    """Links between the two sides of one block pair of a bucket, across components: a spanning forest of them."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_pylist()
        label = np.unique(np.array([c.hex() for c in t.column("component").to_pylist()]), return_inverse=True)[1]
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        n = np.array([len(x) for x in sets], float)
        minor = t.column("minor_side").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(~minor), np.flatnonzero(minor)
        out = []
        if len(left) and len(right):
            both = _intersections([sets[i] for i in left], [sets[i] for i in right])
            linked = (100 * both >= percent * (n[left][:, None] + n[right][None] - both)) & (label[left][:, None] != label[right][None])
            for x, y in zip(*np.nonzero(linked)):
                a, b = left[x], right[y]
                if label[a] != label[b]:
                    out.append((min(fp[a], fp[b]), max(fp[a], fp[b])))
                    label[label == label[b]] = label[a]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [shingle_set(t, size).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["fp", "set"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(fp, set) of the classes in ``wanted``: only their first texts are read."""
    wanted = cut(wanted.distinct(), "wanted-classes")
    texts = pick_rows(docs, classes.join(wanted, "fp", "left_semi"), "doc_id", "first_id").select("text")
    sets = map_arrow(texts, _set_rows(size), "fp binary, set binary")
    return cut(sets.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "shingle-sets")


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked."""
    sets = _full_sets(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))), docs, classes, size)
    left = sets.select(F.col("fp").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("fp").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    links = cut(map_arrow(both, _confirmed(percent), "a binary, b binary"), "links")
    discard(sets)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, fp, component_id, kept): per row its set size, class and component.

    Links are pairs with 100 * intersection >= percent * union of their sets of ``size``-word shingles.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    threshold = percent / 100
    sketch = cut(map_arrow(docs, _sketches(size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, fp binary, regs binary, bands array<long>"), "sketches")
    classes = cut(sketch.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n")), "classes")
    # the sketch of one row per class; equal sets have equal sketches
    first = sketch.join(classes.select("fp", F.col("first_id").alias("doc_id")), ["fp", "doc_id"], "left_semi")
    nameless = sketch.where("doc_id is null").join(classes.where("first_id is null"), "fp", "left_semi")
    first = first.unionByName(nameless).dropDuplicates(["fp"]).select("fp", "n", "regs", "bands")
    first = cut(first, "class-sketches")
    brief = cut(sketch.select("doc_id", "n", "fp"), "documents")
    discard(sketch)
    regs = first.select("fp", "n", "regs")
    entries = first.select("fp", F.explode("bands").alias("band"))
    buckets = cut(entries.groupBy("band").agg(F.count("*").alias("members"), F.min("fp").alias("pivot")).where("members > 1"), "buckets")
    crowded = cut(entries.join(buckets, "band").select("band", "fp", "members", "pivot"), "bucket-members")

    side = lambda c: regs.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))

    starred = cut(crowded.where("fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b")).distinct(), "pivot-pairs")
    joined = starred.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    likely = cut(map_arrow(joined, _likely(threshold), "a binary, b binary"), "likely-pairs")
    links = _confirm(likely, docs, classes, size, percent)
    linked = components(links, "a", "b")

    # In a bucket of two, the pair was compared; in others, those with the pivot only.
    members = crowded.where("members > 2").join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    members = cut(members.select("band", "fp", "members", "component"), "bucket-components")
    parts = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "component"))["component"]
    open_ = parts.groupBy("band").agg(largest.alias("major"), F.sum("n").alias("members"), F.count("*").alias("parts"), F.max("n").alias("most")).where("parts > 1")
    open_ = cut(open_.select("band", "major", (F.col("members") - F.col("most")).alias("minors")), "open-buckets")
    if open_.limit(1).count():
        members = cut(members.join(open_, "band"), "open-members")
        sets = _full_sets(members.select("fp"), docs, classes, size)
        blocks, minor_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("members", "minors"))
        place = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        minor = F.col("component") != F.col("major")
        left = members.select("*", place(blocks).alias("i"), every(minor_blocks).alias("j"), F.lit(False).alias("minor_side"))
        right = members.where(minor).select("*", every(blocks).alias("i"), place(minor_blocks).alias("j"), F.lit(True).alias("minor_side"))
        rows = left.unionByName(right).select("band", "i", "j", "fp", "component", "minor_side").join(sets, "fp")
        found = cut(rows.groupBy("band", "i", "j").applyInArrow(_block_links(percent), "a binary, b binary").distinct(), "block-links")
        discard(sets, members)
        links = links.unionByName(found)
        linked = components(links, "a", "b")

    named = classes.join(linked.withColumnRenamed("node", "fp"), "fp")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = cut(linked.join(names, "component").select(F.col("node").alias("fp"), "component_id"), "component-names")
    of_class = cut(classes.join(names, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("class_component")), "class-components")
    out = brief.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(of_class, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "fp", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, single_ids: bool = True) -> DataFrame:
    """The columns of ``docs``: of each component one row, that with the smallest id; every text without words stays.

    Rows are told apart by id and text, so null ids and ids that several texts share name no row but their own.  With
    ``single_ids``, an id other than null stays with one text even where texts of several components share it.
    """
    k1, k2 = hash128(F.col(text_col))
    key = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"))
    found = near_duplicates(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), size=size, percent=percent)
    found = cut(found.where("kept").select(F.col("doc_id").alias("__vicinity_key"), (F.col("n_shingles") > 0).alias("__vicinity_worded")), "near-dedup")
    rows = found.groupBy("__vicinity_key", "__vicinity_worded").agg(F.count("*").alias("n"))
    repeated = rows.where("__vicinity_worded and n > 1").limit(1).count()
    kept = rows.drop("n")
    if single_ids:
        several = found.where("__vicinity_worded and not __vicinity_key.nameless")
        several = several.groupBy("__vicinity_key.id").agg(F.min("__vicinity_key").alias("least"), F.max("__vicinity_key").alias("most")).where("least <> most")
        others = found.where("__vicinity_worded").join(several, F.col("__vicinity_key.id") == F.col("id")).where("__vicinity_key <> least").select("__vicinity_key")
        kept = kept.join(others, "__vicinity_key", "left_anti")
    out = docs.withColumn("__vicinity_own", key)
    out = out.join(kept.hint("shuffle_hash"), F.col("__vicinity_own") == F.col("__vicinity_key"))
    if repeated:
        out = out.where("__vicinity_worded").dropDuplicates(["__vicinity_own"]).unionByName(out.where("not __vicinity_worded"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
