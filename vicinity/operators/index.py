"""The similarity index: build, save, open, search.

Items are dealt to shards by a hash of their id.  A shard is one row that holds all a search needs of it: row ids, stored
vectors, signatures and trees, so a search never fetches items by joins.  Blocks of queries travel to the shards; a task
descends the trees, counts votes, prunes by signatures and scores what is left, and returns k rows a query.  As shards
are random samples of the items, the points and candidates that a search wants are shared out over the shards.
"""

from __future__ import annotations

import json
import os.path
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinity.functions import kernels, native
from vicinity.operators import exact, forest, linear
from vicinity.scratch import written

FORMAT = 2
TABLES = ("items", "shards")
#: Points that a query visits in every tree, over all shards, and candidates that stay for exact scoring.  Both are
#: raised with k.
REQUIRED_POINTS = 300
CANDIDATES = 200
#: Where a search does not say how many points it requires, its queries visit one in so many of a shard's, if that is
#: more: a fixed number would be an ever smaller share of the items, and recall would fall as they grow.
VISITED_SHARE = 10
#: Queries in a block, at most, and blocks that meet a shard in one task.
BLOCK = 256
BLOCKS_PER_TASK = 64


@dataclass(frozen=True)
class IndexConf:
    """``trees`` = 0 builds a brute-force index, without directions, signatures and trees.  ``storage`` is how shards keep
    vectors: "double", "float", "bf16" (16 bits) or "byte" (8 bits and a range for each vector)."""

    trees: int = 10
    directions: int | None = None
    signature_words: int = kernels.SIGNATURE_WORDS
    storage: str = "double"
    forest: forest.ForestConf = field(default_factory=forest.ForestConf)


class Shard:
    """A row of the shard table, unpacked."""

    def __init__(self, row: dict, dim: int, storage: str):
        self.ids = row["row_ids"]
        self.vectors = kernels.decode_vectors(row["vectors"], dim, storage)
        self.signatures = np.frombuffer(row["signatures"], np.int64).reshape(len(self.vectors), -1)
        self.trees = [forest.Tree.unpack(t) for t in row["trees"]]


class Index:
    """Unit items (row_id, name, label, vec) and, unless brute force, the shards that approximate search needs."""

    def __init__(self, items: DataFrame, dim: int, conf: IndexConf, vt: np.ndarray | None = None, shard_rows: DataFrame | None = None, shards: int = 0):
        self.items, self.dim, self.conf, self.vt, self.shard_rows, self.shards = items, dim, conf, vt, shard_rows, shards

    @property
    def signs(self) -> np.ndarray:
        return kernels.signature_signs(self.dim, self.conf.signature_words)

    # building and storing

    @staticmethod
    def build(items: DataFrame, conf: IndexConf = IndexConf()) -> Index:
        """``items`` as ``sources.items.ingest`` gives them: valid, unit, unique names."""
        if conf.storage not in kernels.STORAGES:
            raise ValueError(f"storage is one of {', '.join(kernels.STORAGES)}")
        items = items.select("row_id", "name", "label", "vec")
        first = items.select(F.size("vec").alias("dim")).limit(1).collect()
        dim = first[0]["dim"] if first else 0
        if first and dim < kernels.SPLIT:
            raise ValueError(f"vectors need {kernels.SPLIT} components at least")
        if conf.trees == 0 or not first:
            return Index(items, dim, IndexConf(trees=0, storage=conf.storage))
        gram, n = linear.gram_matrix(items)
        vt = linear.leading_directions(gram, n, conf.directions or linear.directions_for(dim))[1]
        fc = forest.ForestConf(**{**asdict(conf.forest), "trees": conf.trees})
        conf = IndexConf(conf.trees, len(vt), conf.signature_words, conf.storage, fc)
        shards = max(1, -(-n // fc.shard_rows))
        return Index(items, dim, conf, vt, written(_shard_rows(items, dim, conf, vt, shards), "shards"), shards)

    def save(self, path: str, overwrite: bool = False) -> None:
        """One folder: a Parquet table each, and the model as one row of JSON, written last: a folder without it is no
        index.  Paths inside are relative.  An index is not written over the folder that it reads."""
        spark = self.items.sparkSession
        mode = "overwrite" if overwrite else "errorifexists"
        model_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/model")
        files = model_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        target = files.makeQualified(model_path).getParent().toUri().getPath()
        read = [f for df in (self.items, self.shard_rows) if df is not None for f in df.inputFiles()]
        if any(os.path.dirname(os.path.dirname(urlparse(f).path)) == target for f in read):
            raise ValueError(f"{path} holds the index itself")
        if overwrite:
            files.delete(model_path, True)
        for name, df in zip(TABLES, (self.items, self.shard_rows)):
            if df is not None:
                df.write.mode(mode).parquet(f"{path}/{name}")
        model = {"format": FORMAT, "dim": self.dim, "conf": asdict(self.conf), "shards": self.shards, "vt": None if self.vt is None else self.vt.tolist()}
        spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/model")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        model = json.loads(spark.read.text(f"{path}/model").head()["value"])
        if model.get("format") != FORMAT:
            raise ValueError(f"{path} has index format {model.get('format')}, not {FORMAT}")
        conf = IndexConf(**{**model["conf"], "forest": forest.ForestConf(**model["conf"]["forest"])})
        items = spark.read.parquet(f"{path}/items")
        if conf.trees == 0:
            return Index(items, model["dim"], conf)
        return Index(items, model["dim"], conf, np.array(model["vt"]), spark.read.parquet(f"{path}/shards"), model["shards"])

    # what the index holds

    @property
    def dimension(self) -> int:
        return self.dim

    def lookup(self, name: str) -> DataFrame:
        return self.items.where(F.col("name") == name)

    def query_by_id(self, ids: DataFrame) -> DataFrame:
        """Queries (query_id, vec) from the items with the given row ids."""
        return self.items.join(ids.select(F.col("row_id")), "row_id", "left_semi").select(F.col("row_id").alias("query_id"), "vec")

    def signatures(self) -> DataFrame:
        """(row_id, sig) of every item, as the shards hold them."""
        words = self.conf.signature_words
        return self._unpacked(lambda s, shard: [s.ids, pa.array(list(s.signatures), pa.list_(pa.int64()))], ["row_id", "sig"], f"row_id {self._kind}, sig array<bigint>") if words else self.items.select("row_id")

    def stored_vectors(self) -> DataFrame:
        """(row_id, vec) of every item, as the storage gives them back."""
        return self._unpacked(lambda s, shard: [s.ids, pa.array(list(s.vectors.astype(float)), pa.list_(pa.float64()))], ["row_id", "vec"], f"row_id {self._kind}, vec array<double>")

    def trees(self) -> DataFrame:
        """(shard, tree, packed)."""
        return self.shard_rows.select("shard", F.posexplode("trees").alias("tree", "packed"))

    def leaves(self) -> DataFrame:
        """(shard, tree, leaf, row_ids)."""
        def run(s: Shard, shard: int) -> list:
            each = [(shard, t, i, s.ids.take(pa.array(tree.leaf(i))).to_pylist()) for t, tree in enumerate(s.trees) for i in range(len(tree.leaf_counts))]
            return [pa.array(c, k) for c, k in zip(zip(*each), [pa.int32(), pa.int32(), pa.int32(), pa.list_(s.ids.type)])]

        return self._unpacked(run, ["shard", "tree", "leaf", "row_ids"], f"shard int, tree int, leaf int, row_ids array<{self._kind}>")

    @property
    def _kind(self) -> str:
        return self.items.schema["row_id"].dataType.simpleString()

    def _unpacked(self, f: Callable, names: list[str], schema: str) -> DataFrame:
        dim, storage = self.dim, self.conf.storage

        def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            return pa.table(f(_shard_of(t, dim, storage), key[0].as_py()), names=names)

        return self.shard_rows.groupBy("shard").applyInArrow(run, schema)

    # search

    def queries(self, queries: DataFrame) -> DataFrame:
        """Valid queries of the right length, normalised; the others are left out and so find nothing."""
        vec = F.col("vec").cast("array<double>")
        return queries.select("query_id", vec.alias("vec")).where(native.is_valid(F.col("vec"), self.dim)).select("query_id", native.normalize(F.col("vec")).alias("vec"))

    def brute_force(self, queries: DataFrame, k: int) -> DataFrame:
        return exact.brute_force(self.items, self.queries(queries), k)

    def _probe(self, queries: DataFrame, each: Callable, schema: str) -> DataFrame:
        """``each(shard number, shard, ids, matrix)`` for every shard and every block of valid queries, as one frame.

        A shard meets its blocks in ``salts`` groups: as many as keep all cores busy, and enough for no group to hold
        more than BLOCKS_PER_TASK blocks, however many queries there are.  Queries are counted first, and read again."""
        spark = queries.sparkSession
        n, cores = queries.count(), spark.sparkContext.defaultParallelism
        size = max(32, min(BLOCK, -(-n * self.shards // cores)))
        blocks = max(1, -(-n // size))
        salts = min(blocks, max(-(-cores // self.shards), -(-blocks // BLOCKS_PER_TASK)))
        # few groups, each of some work: partitions enough that two hardly ever share one
        cells = self.shards * salts
        parts = cells if cells > 8 * cores else 4 * cells
        packed = exact.pack_queries(queries.repartition(blocks) if blocks > 1 else queries.coalesce(1), size).withColumn("salt", F.spark_partition_id() % salts)
        packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        left = self.shard_rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dim, storage = self.dim, self.conf.storage
        empty = pa.schema([(f.name, _arrow_type(f.dataType)) for f in _parsed(spark, schema)])

        def run(key: tuple[pa.Scalar, ...], mine: pa.Table, asked: pa.Table) -> pa.Table:
            if not mine.num_rows or not asked.num_rows:
                return empty.empty_table()
            shard = _shard_of(mine, dim, storage)
            out = []
            for ids, matrix in zip(asked.column("ids"), asked.column("matrix")):
                out.append(each(key[0].as_py(), shard, ids.values, np.frombuffer(matrix.as_buffer()).reshape(len(ids.values), -1)))
            return pa.concat_tables(out).cast(empty)

        left, packed = (df.repartition(parts, "shard", "salt").groupBy("shard", "salt") for df in (left, packed))
        return left.cogroup(packed).applyInArrow(run, schema)

    def _leaves_of(self, required: int, greedy: bool, one_in: int | None = None) -> Callable:
        """For a shard and a matrix of queries: per tree, the (query, leaf) pairs that are visited, which hold at least one
        in ``one_in`` of the shard's points if that is given."""
        vt, conf = self.vt, self.conf.forest
        least = -(-required // self.shards)

        def run(shard: Shard, q: np.ndarray):
            y = q @ vt.T
            share = max(least, -(-len(shard.vectors) // one_in)) if one_in else least
            for i, tree in enumerate(shard.trees):
                yield i, tree, *forest.take_leaves(tree, kernels.rotate(y, kernels.rotation_signs(len(vt), i, conf.seed)), share, greedy)

        return run

    def visited_leaves(self, queries: DataFrame, required: int = REQUIRED_POINTS, greedy: bool = False) -> DataFrame:
        """(query_id, shard, tree, leaf) that each query visits."""
        visit = self._leaves_of(required, greedy)

        def each(number: int, shard: Shard, ids: pa.Array, q: np.ndarray) -> pa.Table:
            parts = [(query, np.full(len(query), i), leaf) for i, _, query, leaf in visit(shard, q)]
            query, tree, leaf = (np.concatenate(x) for x in zip(*parts))
            return pa.table({"query_id": ids.take(pa.array(query)), "shard": pa.array(np.full(len(query), number), pa.int32()), "tree": pa.array(tree, pa.int32()), "leaf": pa.array(leaf, pa.int32())})

        return self._probe(self.queries(queries), each, f"query_id {_id_kind(queries)}, shard int, tree int, leaf int")

    def _candidates_of(self, k: int, required: int | None, keep: int | None, progressive: bool, greedy: bool) -> Callable:
        """For a shard and a matrix of queries: per query, the positions left after pruning, with their votes.  A shard
        whose visited leaves hold too few points for k is taken as a whole."""
        keep = max(keep or CANDIDATES, k)
        one_in = None if greedy or required else VISITED_SHARE
        required = 1 if greedy else max(required or REQUIRED_POINTS, 2 * k)
        visit, signs = self._leaves_of(required, greedy, one_in), self.signs
        # a shard's share of the candidates, with room for chance: no result may hang on how items were dealt
        share = min(keep, -(-keep // self.shards) + int(4 * (keep / self.shards) ** 0.5) if self.shards > 1 else keep)

        def run(shard: Shard, q: np.ndarray):
            n = len(shard.vectors)
            votes = np.zeros((len(q), n), np.uint16)
            for _, tree, query, leaf in visit(shard, q):
                at = forest.points(tree, query, leaf)
                votes[at] += 1  # a point is in one leaf of a tree, so no pair comes twice
            sig = kernels.signatures(q, signs)
            for i in range(len(q)):
                found = np.flatnonzero(votes[i])
                if len(found) < min(k, n) and not greedy:
                    found = np.arange(n)
                elif len(found) > share:
                    prune = kernels.prune if progressive else kernels.prune_at_once
                    found = found[prune(votes[i, found].astype(np.int64), shard.signatures, found, sig[i], share)]
                yield found, votes[i, found]

        return run

    def candidates(self, queries: DataFrame, k: int = 1, required: int | None = None, keep: int | None = None, progressive: bool = True, greedy: bool = False) -> DataFrame:
        """(query_id, row_id, votes) left after pruning."""
        prune = self._candidates_of(k, required, keep, progressive, greedy)

        def each(number: int, shard: Shard, ids: pa.Array, q: np.ndarray) -> pa.Table:
            found, votes = zip(*prune(shard, q))
            return pa.table({"query_id": ids.take(pa.array(np.repeat(np.arange(len(q)), [len(f) for f in found]))), "row_id": shard.ids.take(pa.array(np.concatenate(found))), "votes": np.concatenate(votes).astype(np.int64)})

        return self._probe(self.queries(queries), each, f"query_id {_id_kind(queries)}, row_id {self._kind}, votes long")

    def search(self, queries: DataFrame, k: int, required: int | None = None, keep: int | None = None, progressive: bool = True, greedy: bool = False) -> DataFrame:
        """(query_id, rank, row_id, cosine): approximate, or exact if there are no trees.  A query that is an item finds
        itself first.  k rows come back while the index has them; ``greedy`` takes one leaf a tree and may find fewer.

        Where vectors are not stored as doubles, shards give all candidates that may be among the k best by what storage
        is off at most, and the vectors of the items rank those: near copies are closer together than storage can tell."""
        exact._check_k(k)
        if self.conf.trees == 0:
            return self.brute_force(queries, k)
        prune = self._candidates_of(k, required, keep, progressive, greedy)
        storage = self.conf.storage
        exactly = storage == "double"

        def each(number: int, shard: Shard, ids: pa.Array, q: np.ndarray) -> pa.Table:
            query, rows, cosine = [], [], []
            order_ids = shard.ids.to_numpy(zero_copy_only=False)
            for i, (found, _) in enumerate(prune(shard, q)):
                score = kernels.scores(shard.vectors[found], q[i], exactly)
                if not exactly:
                    best = kernels.may_be_best(shard.vectors[found], q[i], k, storage)
                    found, score = found[best], score[best]
                elif len(found) > k:
                    edge = np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[score >= edge], score[score >= edge]  # ties at the cut are settled by row id
                    best = np.lexsort((order_ids[found], -score))[:k]
                    found, score = found[best], score[best]
                query.append(np.full(len(found), i))
                rows.append(found)
                cosine.append(score)
            return pa.table({"query_id": ids.take(pa.array(np.concatenate(query))), "row_id": shard.ids.take(pa.array(np.concatenate(rows))), "cosine": np.concatenate(cosine)})

        queries = self.queries(queries)
        scored = self._probe(queries, each, f"query_id {_id_kind(queries)}, row_id {self._kind}, cosine double")
        return exact.rank_within(scored, k) if exactly else exact.rescore(scored, self.items.select("row_id", F.col("vec").cast("array<double>").alias("vec")), queries, k)

    def search_all(self, k: int, **options) -> DataFrame:
        """The neighbours of every item."""
        return self.search(self.items.select(F.col("row_id").alias("query_id"), "vec"), k, **options)


def _id_kind(queries: DataFrame) -> str:
    return queries.schema["query_id"].dataType.simpleString()


def _parsed(spark: SparkSession, schema: str) -> list:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).fields


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _shard_of(t: pa.Table, dim: int, storage: str) -> Shard:
    column = lambda name: t.column(name).combine_chunks()[0]
    raw = {name: column(name).as_buffer() for name in ("vectors", "signatures")}
    return Shard({**raw, "row_ids": column("row_ids").values, "trees": [x.as_buffer() for x in column("trees").values]}, dim, storage)


def _shard_rows(items: DataFrame, dim: int, conf: IndexConf, vt: np.ndarray, shards: int) -> DataFrame:
    """(shard, row_ids, vectors, signatures, trees): one row a shard.  Vectors are shuffled once, into packed rows; each
    (shard, group of trees) is then built in a task of its own."""
    kind = items.schema["row_id"].dataType.simpleString()
    signs, fc, storage = kernels.signature_signs(dim, conf.signature_words), conf.forest, conf.storage

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("row_id")  # rows come in any order; trees must not depend on it
        x = kernels.matrix(t.column("vec").combine_chunks())
        row = [pa.array([key[0].as_py()], pa.int32()), pa.array([t.column("row_id").to_pylist()], pa.list_(t.schema.field("row_id").type)),
               *[pa.array([v], pa.binary()) for v in (kernels.encode_vectors(x, storage), kernels.signatures(x, signs).tobytes(), (x @ vt.T).tobytes())]]
        return pa.table(row, names=["shard", "row_ids", "vectors", "signatures", "projected"])

    dealt = items.select("row_id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int").alias("shard"))
    packed = written(dealt.groupBy("shard").applyInArrow(pack, f"shard int, row_ids array<{kind}>, vectors binary, signatures binary, projected binary"), "packed-shards")

    def grow(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        shard, part = key[0].as_py(), key[1].as_py()
        x = np.frombuffer(t.column("projected").combine_chunks()[0].as_buffer()).reshape(-1, len(vt))
        ids = range(part * fc.trees_per_task, min(fc.trees, (part + 1) * fc.trees_per_task))
        made = [forest.build_tree(kernels.rotate(x, kernels.rotation_signs(len(vt), i, fc.seed)), (fc.seed, shard, i), fc).pack() for i in ids]
        return pa.table({"shard": pa.array([shard] * len(made), pa.int32()), "tree": pa.array(ids, pa.int32()), "packed": pa.array(made, pa.binary())})

    parts = packed.select("shard", "projected", F.explode(F.sequence(F.lit(0), F.lit(-(-fc.trees // fc.trees_per_task) - 1))).alias("part"))
    grown = parts.groupBy("shard", "part").applyInArrow(grow, "shard int, tree int, packed binary")
    grown = grown.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("tree", "packed"))).alias("trees")).select("shard", F.col("trees.packed").alias("trees"))
    return packed.drop("projected").join(grown, "shard")


def count_votes(spots: DataFrame, weight_col: str | None = None) -> DataFrame:
    """(query_id, row_id, votes[, weight]): how often a point was met in visited leaves, and the sum of their weights."""
    more = [F.sum(weight_col).alias("weight")] if weight_col else []
    return spots.groupBy("query_id", "row_id").agg(F.count("*").alias("votes"), *more)


def at_least_kth(scored: DataFrame, keep: int, bits: int | None = None) -> DataFrame:
    """Rows (query_id, row_id, count) with a count of at least the keep-th largest of their query, less the slack of a
    count of ``bits`` bits if that is given, and of 1 at least; all rows with a count where a query has fewer.
    ``threshold`` is added.  The rule of ``kernels.threshold`` as a window."""
    order = Window.partitionBy("query_id").orderBy(F.desc("count"), "row_id")
    ranked = scored.withColumn("place", F.row_number().over(order))
    kth = F.max(F.when(F.col("place") == keep, F.col("count"))).over(Window.partitionBy("query_id")).cast("long")
    slack = F.lit(0) if bits is None else native.pruning_slack(kth, bits)
    return ranked.withColumn("threshold", F.greatest(F.lit(1).cast("long"), F.coalesce(kth - slack, F.lit(1).cast("long")))).where("count >= threshold").drop("place")
