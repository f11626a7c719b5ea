"""Benchmark decontamination, in DataFrame operations only.

Texts are lower-cased runs of letters and digits; their shingles are runs of five words, weighted by how often they
occur.  For every benchmark item, windows of the item's size slide over the documents by single words.  Each window and
item has a 64-bit SimHash of its weighted shingles, cut into ``BLOCKS`` blocks.  Fingerprints within ``RADIUS`` bits
differ by ``FLIPS`` bits at most in one block at least (pigeonhole: 7 * 3 > 20), so items are entered under every value
within that many flips of each of their blocks, and an equi-join on item, block number and block bits finds every such
pair, each under the first of its blocks.  Pairs within the radius are confirmed by the weighted Jaccard similarity of
their shingles, in full.

Windows that cannot reach the threshold for any item are never formed: a similarity of t needs t times the item's
shingles inside the window, which positions that hold one of the item's shingles bound from above.  That gate loses
nothing and says which item a window may match, and the index is asked about that item alone.  It is one scan of the
texts with the benchmark's shingles broadcast while they are few (counted first), and an ordinary join beyond that.
Counts per window start come from a sweep over where shingles enter and leave, never from a row per shingle and start.

Defined results: null, empty and wordless texts and items match nothing; an item of fewer than five words is one
shingle; a document shorter than an item is one window; equal rows are found once; nulls in ids are kept apart, those of
items too: an item is known by the hash of its id and text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash128

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 20
BLOCKS = 7
FLIPS = RADIUS // BLOCKS
#: Benchmark shingles that may be broadcast (about 24 bytes each).
BROADCAST_SHINGLES = 2_000_000


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingle_array(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` elements, in order; an empty array if there are fewer."""
    run = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)])
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), run)).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """Bit b of the fingerprint is the weighted majority of bit b over the shingles."""
    bit = lambda h, b: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long"))
    total = lambda b: F.aggregate(shingles, F.lit(0).cast("long"), lambda s, h: s + bit(h, b))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda acc, b: F.when(2 * total(b) > F.size(shingles), acc.bitwiseOR(one(b))).otherwise(acc))


EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
SPANS = list(zip(EDGES, EDGES[1:]))


def _block(fingerprint: Column, a: int, b: int) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, F.lit(a)).bitwiseAND(F.lit((1 << b - a) - 1).cast("long"))


def hamming_blocks(fingerprint: Column) -> Column:
    """The fingerprint in blocks of nearly equal width: an array of (block, bits)."""
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(fingerprint, a, b).alias("bits")) for i, (a, b) in enumerate(SPANS)])


def hamming_probes(fingerprint: Column) -> Column:
    """The same with every value within ``FLIPS`` bits of each block."""
    def near(i: int, a: int, b: int) -> Column:
        masks = [sum(1 << x for x in flips) for n in range(FLIPS + 1) for flips in combinations(range(b - a), n)]
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(i).alias("block"), _block(fingerprint, a, b).bitwiseXOR(m).alias("bits")))

    return F.concat(*[near(i, a, b) for i, (a, b) in enumerate(SPANS)])


def first_block(difference: Column) -> Column:
    """The first block in which fingerprints with this difference (exclusive or) differ by ``FLIPS`` bits at most."""
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(SPANS))):
        out = F.when(F.bit_count(_block(difference, a, b)) <= FLIPS, F.lit(i)).otherwise(out)
    return out


def index_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs of ``windows`` (fingerprint, i1, i2 and more) and ``items`` (i1, i2, item_fingerprint) that the index
    joins: within ``FLIPS`` bits in one block, each once, with their distance ``hamming``."""
    left = windows.withColumn("b", F.explode(hamming_blocks(F.col("fingerprint")))).select(*windows.columns, "b.block", "b.bits")
    right = items.select("i1", "i2", "item_fingerprint", F.explode(hamming_probes(F.col("item_fingerprint"))).alias("b")).select("i1", "i2", "item_fingerprint", "b.block", "b.bits")
    difference = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    return (left.join(right, ["i1", "i2", "block", "bits"]).where(F.col("block") == first_block(difference))
            .select(*windows.columns, F.bit_count(difference).alias("hamming")))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles as bags.  Only bags that repeat a shingle are counted
    shingle by shingle."""
    times = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    shared = F.array_intersect(a, b)
    once = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    both = F.when(once(a) | once(b), F.size(shared)).otherwise(F.aggregate(shared, F.lit(0), lambda s, v: s + F.least(times(a, v), times(b, v))))
    return both / (F.size(a) + F.size(b) - both)


def _sized_shingles(hashes: Column, size: Column, sizes: list[int]) -> Column:
    out = F.array().cast("array<bigint>")
    for k in sizes:
        out = F.when(size == k, shingle_array(hashes, k)).otherwise(out)
    return out


def windows_of(spots: DataFrame) -> DataFrame:
    """(k1, k2, n_words, size, start, items): the starts of item-sized windows that hold ``enough`` of an item's
    shingles, with those items (i1, i2).

    ``spots`` has a row for each position of a document (k1, k2, words) that holds a shingle of an item.  A position
    enters at the first start whose window reaches it and leaves after the start that it is; between two such events the
    count stays."""
    last = F.greatest(F.lit(0), F.col("words") - F.col("n_words"))
    event = lambda at, change: F.struct(at.alias("at"), F.lit(change).alias("change"))
    enter = F.greatest(F.lit(0), F.least(last, F.col("pos") - F.col("n_words") + F.col("size")))
    pair = ["k1", "k2", "i1", "i2"]
    events = spots.select(*pair, "n_words", "size", "enough", last.alias("last"), F.explode(F.array(event(enter, 1), event(F.col("pos") + 1, -1))).alias("e")).where("e.at <= last")
    steps = events.groupBy(*pair, "n_words", "size", "enough", "last", F.col("e.at").alias("at")).agg(F.sum("e.change").alias("change"))
    order = Window.partitionBy(*pair).orderBy("at")
    steps = steps.select(*pair, "n_words", "size", "enough", "at", F.sum("change").over(order).alias("held"), F.coalesce(F.lead("at").over(order) - 1, F.col("last")).alias("until"))
    starts = steps.where("held >= enough").select(*pair, "n_words", "size", F.explode(F.sequence("at", "until")).alias("start"))
    return starts.groupBy("k1", "k2", "n_words", "size", "start").agg(F.collect_list(F.struct("i1", "i2")).alias("items"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(k1, k2, doc_id, item_id, start_word, n_words, hamming, similarity): the best window of each document for each
    item that it holds.  (k1, k2) is the hash of id and text, a key of the row; items have such keys (i1, i2) inside."""
    k1, k2 = hash128(F.col("doc_id"), F.col("text"))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text")
    hashes = lambda text: F.transform(normal_words(text), lambda w: F.xxhash64(w))

    i1, i2 = hash128(F.col(item_col), F.col(item_text_col))
    bench = items.select(i1.alias("i1"), i2.alias("i2"), F.col(item_col).alias("item_id"), hashes(F.col(item_text_col)).alias("hashes")).where(F.size("hashes") > 0).dropDuplicates(["i1", "i2"])
    bench = bench.withColumn("n_words", F.size("hashes")).withColumn("size", F.least(F.lit(SHINGLE), F.col("n_words")))
    bench = bench.withColumn("shingles", _sized_shingles(F.col("hashes"), F.col("size"), list(range(1, SHINGLE + 1))))
    bench = cut(bench.select("i1", "i2", "item_id", "n_words", "size", "shingles", simhash(F.col("shingles")).alias("fingerprint")), "benchmark")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # five values at most

    # Positions that hold a shingle of some item.
    keys = cut(bench.select("size", F.explode(F.array_distinct("shingles")).alias("h"), "i1", "i2", "n_words", F.size("shingles").alias("n")).distinct(), "benchmark-shingles")
    few = keys.count() <= BROADCAST_SHINGLES
    hashed = docs.select("k1", "k2", hashes(F.col("text")).alias("hashes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"k1 long, k2 long, doc_id {kind}, item_id {bench.schema['item_id'].dataType.simpleString()}, start_word long, n_words long, hamming int, similarity double")
    # the shingles of all sizes in one array, one size after another: a place in it gives size and position
    each = hashed.select("k1", "k2", F.size("hashes").alias("words"), F.posexplode(F.concat(*[shingle_array(F.col("hashes"), k) for k in sizes])).alias("at", "h"))
    size, pos, begin = F.lit(sizes[0]), F.col("at"), F.lit(0)
    for before, k in zip(sizes, sizes[1:]):
        begin = begin + F.greatest(F.lit(0), F.col("words") - before + 1)
        size, pos = F.when(F.col("at") >= begin, k).otherwise(size), F.when(F.col("at") >= begin, F.col("at") - begin).otherwise(pos)
    each = each.select("k1", "k2", "words", size.alias("size"), pos.alias("pos"), "h")
    spots = each.join(F.broadcast(keys) if few else keys, ["size", "h"]).drop("h")
    # Most documents share a few phrases with some item: the whole document must hold enough of the item first.
    spots = cut(spots.select("k1", "k2", "words", "pos", "size", "i1", "i2", "n_words", "n").distinct(), "shared-shingles")
    enough = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    item_key = ["k1", "k2", "i1", "i2", "n_words"]
    held = spots.groupBy(*item_key).agg(F.count("*").alias("held"), F.max(enough).alias("enough")).where("held >= enough").select(*item_key)
    spots = spots.join(cut(held, "held-items"), item_key, "left_semi")
    windows = cut(windows_of(spots.withColumn("enough", enough)), "windows")

    # Fingerprints of the windows, from the documents that have one.
    named = windows.select("k1", "k2").distinct()
    texts = docs.join(named.hint("shuffle_hash"), ["k1", "k2"], "left_semi").select("k1", "k2", "doc_id", hashes(F.col("text")).alias("hashes")).dropDuplicates(["k1", "k2"])
    inside = F.slice(F.col("hashes"), F.col("start") + 1, F.col("n_words"))
    prints = windows.join(texts, ["k1", "k2"]).select("k1", "k2", "doc_id", "n_words", "start", "items", _sized_shingles(inside, F.col("size"), sizes).alias("shingles"))
    prints = cut(prints.withColumn("fingerprint", simhash(F.col("shingles"))), "window-fingerprints")

    asked = prints.select("k1", "k2", "n_words", "start", "fingerprint", F.explode("items").alias("item")).select("k1", "k2", "n_words", "start", "fingerprint", "item.i1", "item.i2")
    close = index_pairs(asked, bench.select("i1", "i2", F.col("fingerprint").alias("item_fingerprint"))).where(F.col("hamming") <= RADIUS)
    close = close.select("k1", "k2", "n_words", "start", "i1", "i2", "hamming")
    checked = (close.join(prints.select("k1", "k2", "doc_id", "n_words", "start", "shingles"), ["k1", "k2", "n_words", "start"])
               .join(bench.select("i1", "i2", "item_id", F.col("shingles").alias("item_shingles")), ["i1", "i2"])
               .withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles"))).where(F.col("similarity") >= threshold - 1e-12))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "hamming", "doc_id")).alias("best")
    return checked.groupBy("k1", "k2", "i1", "i2", "item_id", "n_words").agg(best).select(
        "k1", "k2", "best.doc_id", "item_id", (-F.col("best.before")).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "best.hamming", "best.similarity")


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents and the items they hold: where the best window starts and how similar it is."""
    return contaminated(docs, items).select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = cut(contaminated(docs, items, id_col, text_col).select(F.col("k1").alias("__vicinity_k1"), F.col("k2").alias("__vicinity_k2")).distinct(), "contaminated")
    k1, k2 = hash128(F.col(id_col), F.col(text_col))
    return docs.join(found.hint("shuffle_hash"), (k1 == F.col("__vicinity_k1")) & (k2 == F.col("__vicinity_k2")), "left_anti")
