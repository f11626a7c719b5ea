"""Exact nearest neighbours under cosine similarity.

Items are (row_id, name, label, vec) with unit ``vec``; queries are (query_id, vec).  Results are (query_id, rank,
row_id, cosine), ranked by cosine and then by row id, from rank 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.functions import kernels, native
from vicinity.scratch import written

#: Queries that go to every partition of the items at once, packed in one row.
QUERY_BLOCK = 1024
ITEM_BATCH = 2048
#: What a score of the matrix product may be off by: products of one item differ with its place in a batch.
TIE = 1e-9
#: Queries that the expression forms of search send to every task.
MOST_BROADCAST = 4096


def _check_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def rank_within(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by cosine, ties by row id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "row_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "cosine")


def with_few(queries: DataFrame, name: str) -> DataFrame:
    """A stated, small set of queries for a broadcast: counted, and refused beyond ``MOST_BROADCAST`` of them, for which
    ``brute_force`` is the way."""
    queries = written(queries, name)
    if queries.count() > MOST_BROADCAST:
        raise ValueError(f"more than {MOST_BROADCAST} queries: use brute_force, which sends them in blocks")
    return F.broadcast(queries)


def scored_pairs(items: DataFrame, queries: DataFrame) -> DataFrame:
    """All (query, item) cosines as expressions, for a stated, small set of queries."""
    q = with_few(queries.select("query_id", F.col("vec").alias("query_vec")), "few-queries")
    return items.join(q, F.lit(True)).select("query_id", "row_id", native.cosine_of_unit(F.col("query_vec"), F.col("vec")).alias("cosine"))


def top_k_native(items: DataFrame, queries: DataFrame, k: int, share: int = 16) -> DataFrame:
    """``brute_force`` as expressions: all pairs are scored, and those are ranked that reach what the k-th best of some
    items scores, so that no more than a few times k rows a query are sorted.

    One in ``share`` of the items gives that bound: the k-th largest of the best scores of groups of them, which is never
    above the k-th best of all.  Without k such groups all pairs are ranked.  Vectors are columns of a component each, whose
    products compile to plain code.  Queries are broadcast ``MOST_BROADCAST`` at a time."""
    _check_k(k)
    queries = written(queries.select("query_id", "vec"), "queries")
    first = items.select(F.size("vec").alias("dim")).limit(1).collect()
    dim, parts, groups = first[0]["dim"] if first else 0, max(1, -(-queries.count() // MOST_BROADCAST)), max(64, 4 * k)
    cells = lambda df, name, *keys: df.select(*keys, *[F.coalesce(F.get("vec", i), F.lit(0.0)).alias(f"{name}{i}") for i in range(dim)])
    x = cells(items, "x", "row_id").repartition(3 * items.sparkSession.sparkContext.defaultParallelism, "row_id")
    score = reduce(lambda a, b: a + b, [F.col(f"q{i}") * F.col(f"x{i}") for i in range(dim)], F.lit(0.0))

    def pairs(x: DataFrame, q: DataFrame, *keys: str) -> DataFrame:
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        every = [x.join(F.broadcast(cells(q.where(part == i) if parts > 1 else q, "q", "query_id", *keys)), F.lit(True)) for i in range(parts)]
        return reduce(DataFrame.unionByName, [p.select("query_id", "row_id", score.alias("cosine"), *keys) for p in every])

    some = pairs(x.where(F.pmod(F.xxhash64("row_id"), F.lit(share)) == 0), queries)
    best = some.groupBy("query_id", F.pmod(F.hash("row_id"), F.lit(groups)).alias("group")).agg(F.max("cosine").alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("best"))
    bound = best.withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select("query_id", F.col("best").alias("bound"))
    bounded = queries.join(bound, "query_id", "left").select("query_id", "vec", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    return rank_within(pairs(x, written(bounded, "bounded-queries"), "bound").where("cosine >= bound"), k)


def one_query(items: DataFrame, vec: list[float], k: int) -> DataFrame:
    """The neighbours of one vector: scored in the scan, then the top k of each partition, never a full sort."""
    _check_k(k)
    q = F.array(*[F.lit(float(x)) for x in vec])
    best = items.select("row_id", native.cosine_of_unit(q, F.col("vec")).alias("cosine")).orderBy(F.desc("cosine"), "row_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("cosine"), "row_id")).alias("rank"), "row_id", "cosine")


def pack_queries(queries: DataFrame, block: int = QUERY_BLOCK, kind: type = float) -> DataFrame:
    """(ids, matrix): blocks of queries as one row each, so that a partition of items meets a block as one matrix."""
    id_kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                vecs = kernels.matrix(part.column(1), kind)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(batch.column(0).type)), pa.array([vecs.tobytes()], pa.binary())], ["ids", "matrix"])

    return queries.select("query_id", "vec").mapInArrow(run, f"ids array<{id_kind}>, matrix binary")


def brute_force(items: DataFrame, queries: DataFrame, k: int, most_blocks: int = 64) -> DataFrame:
    """The k nearest items of every query.

    Queries travel in blocks; every partition of the items multiplies its batches with them and keeps k rows a query, so
    what is shuffled is partitions * k rows a query, whatever the number of items.  Blocks are broadcast; of more than
    ``most_blocks``, some at a time are, and the nearest items of their queries are written before the next ones go.
    """
    _check_k(k)
    blocks = pack_queries(queries)
    few = blocks.count() <= most_blocks
    kind, id_kind = items.schema["row_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}
        for batch in batches:
            # one row pairs a batch of items with a block of queries
            for ids, matrix, rows, data in zip(*(batch.column(i) for i in range(4))):
                ids, rows = ids.values, rows.values.to_numpy()
                raw = matrix.as_py()
                q = np.frombuffer(raw).reshape(len(ids), -1)
                x = np.frombuffer(data.as_py()).reshape(len(rows), -1)
                score = q @ x.T
                take = min(k, len(rows))
                top = np.argpartition(-score, take - 1, axis=1)[:, :take]
                # ties at the cut are settled by row id below: keep all of them
                edge = np.take_along_axis(score, top, 1).min(1, keepdims=True)
                found = [np.flatnonzero(s >= e - TIE) for s, e in zip(score, edge[:, 0])]
                # other blocks may hold the same vectors under other ids
                old = best.setdefault((raw, tuple(ids.to_pylist())), [ids, [(np.empty(0), np.empty(0, rows.dtype))] * len(ids)])
                merged = []
                for (s0, r0), v, f in zip(old[1], q, found):
                    # summed in one order wherever an item stands: equal vectors score the same to the last bit
                    s1, r1 = np.concatenate([s0, np.einsum("ij,j->i", x[f], v)]), np.concatenate([r0, rows[f]])
                    order = np.lexsort((r1, -s1))[:k]
                    merged.append((s1[order], r1[order]))
                old[1] = merged
        for ids, kept in best.values():
            n = [len(s) for s, _ in kept]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate([r for _, r in kept])), pa.array(np.concatenate([s for s, _ in kept]))], ["query_id", "row_id", "cosine"])

    schema = f"query_id {id_kind}, row_id {kind}, cosine double"
    if few:
        return rank_within(pack_items(items).join(F.broadcast(blocks), F.lit(True)).select(*MET).mapInArrow(run, schema), k)
    # both are read as often as there are parts; items are dealt anew, as a small table comes in few partitions
    packed = written(pack_items(items).repartition(items.sparkSession.sparkContext.defaultParallelism), "packed-items")
    blocks = written(blocks, "query-blocks")
    parts = -(-blocks.count() // max(1, most_blocks // 2))
    part = F.pmod(F.xxhash64("ids"), F.lit(parts))
    each = [packed.join(F.broadcast(blocks.where(part == i)), F.lit(True)).select(*MET).mapInArrow(run, schema) for i in range(parts)]
    return rank_within(reduce(DataFrame.unionByName, [written(e, "nearest") for e in each]), k)


#: The columns of a batch of items that meets a block of queries.
MET = ["ids", "matrix", "row_ids", "data"]


def met(packed: DataFrame, blocks: DataFrame, most_blocks: int = 64) -> DataFrame:
    """(ids, matrix, row_ids, data): every batch of items with every block of queries."""
    if blocks.count() <= most_blocks:
        pairs = packed.join(F.broadcast(blocks), F.lit(True))
    else:
        salts = 64
        pairs = (packed.withColumn("salt", F.pmod(F.hash("row_ids"), F.lit(salts)))
                 .join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "salt"))
    return pairs.select(*MET)


def largest_errors(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, error): the largest difference that a query's cosines have between the vectors ``vec`` and ``stored`` of
    items (row_id, vec, stored).  Pairs are met as matrices; what is shuffled is a row for each query and partition."""
    id_kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst: dict[tuple, tuple] = {}
        for batch in batches:
            for ids, matrix, rows, data in zip(*(batch.column(i) for i in range(4))):
                raw, ids = matrix.as_py(), ids.values
                q = np.frombuffer(raw).reshape(len(ids), -1)
                x, stored = np.split(np.frombuffer(data.as_py()).reshape(len(rows.values), -1), 2, axis=1)
                # 1 - |q - stored|^2 / 2 less 1 - |q - x|^2 / 2
                error = np.abs(q @ (stored - x).T + ((x * x).sum(1) - (stored * stored).sum(1)) / 2).max(1)
                key = raw, tuple(ids.to_pylist())
                worst[key] = ids, np.maximum(error, worst[key][1]) if key in worst else error
        for ids, error in worst.values():
            yield pa.RecordBatch.from_arrays([ids, pa.array(error)], ["query_id", "error"])

    packed = pack_items(vectors.select("row_id", F.concat("vec", "stored").alias("vec")))
    return met(packed, pack_queries(queries)).mapInArrow(run, f"query_id {id_kind}, error double").groupBy("query_id").agg(F.max("error").alias("error"))


def pack_items(items: DataFrame, batch: int = ITEM_BATCH, kind: type = float) -> DataFrame:
    """(row_ids, data): batches of items as one row each."""
    id_kind = items.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([kernels.matrix(part.column(1), kind).tobytes()], pa.binary())], ["row_ids", "data"])

    return items.select("row_id", "vec").mapInArrow(run, f"row_ids array<{id_kind}>, data binary")


def rescore(candidates: DataFrame, items: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Exact cosines of (query_id, row_id) candidates, sorted within each query; the k best, or all."""
    scored = (candidates.select("query_id", "row_id").join(items.select("row_id", "vec"), "row_id")
              .join(queries.select("query_id", F.col("vec").alias("query_vec")), "query_id")
              .select("query_id", "row_id", native.cosine_of_unit(F.col("query_vec"), F.col("vec")).alias("cosine")))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "row_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "rank", "row_id", "cosine")


def rank_all(items: DataFrame, queries: DataFrame, block: int = 32, most_batches: int = 128) -> DataFrame:
    """``rescore`` of every item for every query: exact cosines, all of them ranked.

    Up to ``most_batches`` batches of items are broadcast and a block of queries meets them in one task, which ranks them,
    so no pair is shuffled.  Beyond that, scored pairs are shuffled and ranked by a window."""
    kind, id_kind = items.schema["row_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    packed = written(pack_items(items), "packed-items")
    batches_of_items, n = packed.count(), queries.count()
    few = batches_of_items <= most_batches
    # some blocks a task, and tasks enough for all cores
    dealt = queries.repartition(max(queries.sparkSession.sparkContext.defaultParallelism, -(-n // (4 * block))))
    names, schema = ["query_id", "rank", "row_id", "cosine"], f"query_id {id_kind}, rank int, row_id {kind}, cosine double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for ids, matrix, rows, data in zip(*(batch.column(i) for i in range(4))):
                raw, ids, rows = matrix.as_py(), ids.values, rows.values
                # summed in one order wherever an item stands: equal vectors score the same to the last bit
                yield (raw, tuple(ids.to_pylist())), ids, rows, np.einsum("ij,kj->ik", np.frombuffer(raw).reshape(len(ids), -1), np.frombuffer(data.as_py()).reshape(len(rows), -1))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met_by: dict[tuple, list] = {}
        for key, ids, rows, score in scored(batches):
            parts = met_by.setdefault(key, [])
            parts.append((rows, score))
            if len(parts) < batches_of_items:
                continue
            del met_by[key]
            rows, score = pa.concat_arrays([r for r, _ in parts]), np.concatenate([s for _, s in parts], axis=1)
            first = np.argsort(rows.to_numpy(zero_copy_only=False), kind="stable")
            rows, score = rows.take(pa.array(first)), score[:, first]
            ranks = pa.array(np.arange(1, len(rows) + 1), pa.int32())
            for i, s in enumerate(score):
                order = np.argsort(-s, kind="stable")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(rows), i))), ranks, rows.take(pa.array(order)), pa.array(s[order])], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, rows, score in scored(batches):
            for i, s in enumerate(score):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(rows), i))), pa.nulls(len(rows), pa.int32()), rows, pa.array(s)], names)

    if few:
        pairs = pack_queries(dealt, block).join(F.broadcast(packed), F.lit(True)).select("ids", "matrix", "row_ids", "data")
        return pairs.mapInArrow(whole, schema)
    return rank_within(met(packed, pack_queries(dealt, block)).mapInArrow(each, schema), 2**31 - 1)


def decorate(results: DataFrame, items: DataFrame) -> DataFrame:
    """Results with the names and labels of their items."""
    return results.join(items.select("row_id", "name", "label"), "row_id").select("query_id", "rank", "row_id", "name", "label", "cosine")


def signature_top_k(items_sig: DataFrame, queries_sig: DataFrame, k: int, bits: int) -> DataFrame:
    """The k items whose signatures overlap most with each query's, with the cosine that the overlap suggests.  As in
    ``brute_force``, blocks of queries meet batches of items, and k rows a query and partition are shuffled."""
    _check_k(k)
    kind, id_kind = items_sig.schema["row_id"].dataType.simpleString(), queries_sig.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}
        for batch in batches:
            for ids, matrix, rows, data in zip(*(batch.column(i) for i in range(4))):
                raw, ids, rows = matrix.as_py(), ids.values, rows.values.to_numpy()
                q, x = np.frombuffer(raw, np.int64).reshape(len(ids), -1), np.frombuffer(data.as_py(), np.int64).reshape(len(rows), -1)
                same = np.zeros((len(q), len(x)), np.int32)
                for w in range(q.shape[1]):
                    same += kernels.popcount(~(q[:, w, None] ^ x[:, w]))
                take = min(k, len(x))
                edge = np.partition(same, len(x) - take, axis=1)[:, len(x) - take]
                old = best.setdefault((raw, tuple(ids.to_pylist())), [ids, [(np.empty(0, np.int32), np.empty(0, rows.dtype))] * len(ids)])
                merged = []
                for (s0, r0), s, e in zip(old[1], same, edge):
                    f = np.flatnonzero(s >= e)  # ties at the cut are settled by row id
                    s1, r1 = np.concatenate([s0, s[f]]), np.concatenate([r0, rows[f]])
                    order = np.lexsort((r1, -s1))[:k]
                    merged.append((s1[order], r1[order]))
                old[1] = merged
        for ids, kept in best.values():
            n = [len(s) for s, _ in kept]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate([r for _, r in kept])), pa.array(np.concatenate([s for s, _ in kept]))], ["query_id", "row_id", "overlap"])

    blocks = pack_queries(queries_sig.select("query_id", F.col("sig").alias("vec")), kind=np.int64)
    packed = pack_items(items_sig.select("row_id", F.col("sig").alias("vec")), kind=np.int64)
    same = met(packed, blocks).mapInArrow(run, f"query_id {id_kind}, row_id {kind}, overlap int")
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "row_id")
    return (same.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "row_id", "overlap", native.estimated_cosine(F.col("overlap"), bits).alias("cosine")))


def sample_ids(df: DataFrame, id_col: str, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, the same ones at every run: those with the least digests of seed and id.  Each
    partition passes on n rows at most."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def exclude_self(results: DataFrame) -> DataFrame:
    """Results without the query itself, ranked anew."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return results.where("row_id <> query_id").withColumn("rank", F.row_number().over(order))
