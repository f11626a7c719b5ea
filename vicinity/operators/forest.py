"""Space-partitioning trees over the rows of one shard: built from projected vectors, probed by blocks of queries.

A tree holds its nodes as arrays and its leaves as row positions of the shard, so it packs into one binary value and its
size is bounded by the shard's.  A block of queries descends a tree together, level by level, as matrix operations, each
query along its best paths; it takes leaves by descending score until they hold as many points as it wants.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vicinity.functions import kernels

LEAF_BOUND = 50
RETRIES = 10
#: Angles that differ by no more are one: products of the same rows may be off by some 1e-15 where a query takes its path.
CLOSE = 1e-10
NONE = -1
NOWHERE = np.float32(-np.inf)


@dataclass(frozen=True)
class ForestConf:
    trees: int = 10
    leaf_bound: int = LEAF_BOUND
    max_depth: int | None = None
    seed: int = kernels.TREE_SEED
    shard_rows: int = 24_576
    trees_per_task: int = 2
    #: "hadamard": 17-way split on random coordinates.  "data": 2-way split on the sign of a product with a data vector.
    strategy: str = "hadamard"


class Tree:
    """Nodes as arrays: children hold a node (>= 0), a leaf (-2 - leaf) or nothing (-1).  A child's number is above its
    parent's.  ``members`` lists the row positions of leaf 0, then of leaf 1, and so on."""

    def __init__(self, projections: np.ndarray, coords: np.ndarray, children: np.ndarray, leaf_counts: np.ndarray, members: np.ndarray):
        self.projections, self.coords, self.children, self.leaf_counts, self.members = projections, coords, children, leaf_counts, members
        self.starts = np.concatenate([[0], np.cumsum(leaf_counts)[:-1]]).astype(np.int64) if len(leaf_counts) else np.empty(0, np.int64)

    def pack(self) -> bytes:
        """Header of five sizes, then the arrays."""
        width = self.projections.shape[1] if len(self.projections) else 0
        head = np.array([len(self.projections), width, self.children.shape[1] if len(self.children) else 0, len(self.leaf_counts), len(self.members)], np.int64)
        parts = [(self.projections, np.float64), (self.coords, np.int32), (self.children, np.int32), (self.leaf_counts, np.int32), (self.members, np.int32)]
        return head.tobytes() + b"".join(x.astype(kind).tobytes() for x, kind in parts)

    @staticmethod
    def unpack(data: bytes) -> Tree:
        n, width, slots, leaves, rows = np.frombuffer(data, np.int64, 5).tolist()
        at, out = 40, []
        for kind, shape in ((np.float64, (n, width)), (np.int32, (n, width)), (np.int32, (n, slots)), (np.int32, (leaves,)), (np.int32, (rows,))):
            count = int(np.prod(shape))
            out.append(np.frombuffer(data, kind, count, at).reshape(shape))
            at += np.dtype(kind).itemsize * count
        return Tree(*out)

    def leaf(self, i: int) -> np.ndarray:
        return self.members[self.starts[i] : self.starts[i] + self.leaf_counts[i]]


def hadamard_split(x: np.ndarray, rows: np.ndarray, key: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs, coordinates, slot of each row): eight random coordinates with random signs, signed arg-max."""
    r = kernels.rng(*key)
    coords = np.sort(r.permutation(x.shape[1])[: kernels.SPLIT])
    signs = (r.integers(0, 2, kernels.SPLIT) * 2 - 1) / np.sqrt(kernels.SPLIT)
    return signs, coords, kernels.slots(kernels.split_outputs(x[rows], coords, signs))


def data_split(x: np.ndarray, rows: np.ndarray, key: tuple, most: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sum of at most 256 sampled rows with random signs as the direction; slot 1 where the product is not negative."""
    r = kernels.rng(*key)
    chosen = rows[r.permutation(len(rows))[:most]]
    w = ((r.integers(0, 2, len(chosen)) * 2 - 1)[:, None] * x[chosen]).sum(0)
    w = w / (np.sqrt(w @ w) + 1e-3)
    return w, np.arange(x.shape[1]), two_way(x[rows], w)


def two_way(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slot 1 where the product with ``w`` is not negative, else 0."""
    return (x @ w >= 0).astype(int)


def _between(z: np.ndarray, key: tuple) -> tuple[int, int, float, float] | None:
    """(i, j, a, b): the sign of a x_i + b x_j is not the same for all rows x of z, and about half of them have either;
    None if no row is found that points another way than a random one."""
    one = z[kernels.rng(*key, "between").integers(len(z))]
    length = np.sqrt((z * z).sum(1))
    other = z[np.argmin(np.where(length > 0, z @ one / np.where(length > 0, length, 1), np.inf))]
    cross = np.abs(np.outer(one, other) - np.outer(other, one))
    i, j = np.sort(np.unravel_index(cross.argmax(), cross.shape)).tolist()
    angle = np.sort(np.arctan2(z[:, j], z[:, i]))
    gaps = np.flatnonzero(np.diff(angle) > CLOSE)
    if i == j or not len(gaps):
        return None
    at = gaps[np.abs(gaps + 1 - len(z) / 2).argmin()]
    middle = (angle[at] + angle[at + 1]) / 2
    return i, j, -float(np.sin(middle)), float(np.cos(middle))


def data_between(x: np.ndarray, rows: np.ndarray, key: tuple) -> tuple | None:
    """A split that tells rows apart which all have the same side of sampled directions."""
    if (found := _between(x[rows], key)) is None:
        return None
    i, j, a, b = found
    w = np.zeros(x.shape[1])
    w[[i, j]] = a, b
    return w, np.arange(x.shape[1]), two_way(x[rows], w)


def hadamard_between(x: np.ndarray, rows: np.ndarray, key: tuple) -> tuple | None:
    """The same for rows whose largest output is the same on random coordinates.  Of four coordinates on the first or the
    last four places, two that are large make two of the outputs large, and the sign of the form in the other two says
    which is the larger one."""
    z, dim, half = x[rows], x.shape[1], kernels.SPLIT // 2
    for first, others in ((0, np.arange(dim - half, dim)), (half, np.arange(half))):
        part = z[:, first : first + dim - half]
        if (found := _between(part, key)) is None:
            continue
        i, j, a, b = found
        level = np.median(part, axis=0)
        large = [c for c in np.argsort(-np.abs(part).min(0), kind="stable").tolist() if c not in (i, j)][:2]
        if (level[large] == 0).any():
            continue
        scale = 4 * float((np.abs(a * part[:, i]) + np.abs(b * part[:, j])).max())
        weight = {i: a / scale, j: b / scale, **{c: 1 / level[c] for c in large}}
        coords = np.sort(np.concatenate([np.array(sorted(weight)) + first, others]))
        signs = np.array([weight.get(c - first, 0.0) if c not in others else 0.0 for c in coords.tolist()])
        at = kernels.slots(kernels.split_outputs(z, coords, signs))
        if (at != at[0]).any():
            return signs, coords, at
    return None


BETWEEN = {"hadamard": hadamard_between, "data": data_between}
SPLITS = {"hadamard": (hadamard_split, kernels.SLOTS), "data": (data_split, 2)}


def build_tree(x: np.ndarray, key: tuple, conf: ForestConf) -> Tree:
    """A tree over the rows of x.  Random choices hang on the node's path only."""
    split, slots = SPLITS[conf.strategy]
    projections, coords, children, leaves = [], [], [], []
    # the root is child 0 of a node that does not exist
    todo = [(np.arange(len(x)), (), None, 0)]
    while todo:
        rows, path, parent, slot = todo.pop()
        place = None
        if len(rows) >= conf.leaf_bound and (conf.max_depth is None or len(path) < conf.max_depth):
            for retry in range(RETRIES + 1):
                # rows that lie close together stay together in random splits; what differs among them tells them apart
                made = split(x, rows, (*key, path, retry)) if retry < RETRIES else BETWEEN[conf.strategy](x, rows, (*key, path))
                if made is not None and (made[2] != made[2][0]).any():
                    p, c, at = made
                    place = len(projections)
                    projections.append(p)
                    coords.append(c)
                    children.append(np.full(slots, NONE))
                    todo += [(rows[at == s], (*path, int(s)), place, int(s)) for s in np.unique(at)[::-1]]
                    break
        if place is None and len(rows):
            leaves.append(rows)
            place = -1 - len(leaves)
        if parent is not None:
            children[parent][slot] = place
    width = kernels.SPLIT if conf.strategy == "hadamard" else x.shape[1]
    return Tree(np.array(projections).reshape(-1, width), np.array(coords, int).reshape(-1, width), np.array(children, int).reshape(-1, slots),
                np.array([len(r) for r in leaves], np.int64), np.concatenate(leaves) if leaves else np.empty(0, np.int64))


_MATRIX = kernels.hadamard(np.eye(kernels.SPLIT)).astype(np.float32)


def _outputs(tree: Tree, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """(..., outputs) of nodes (...) for the queries q (..., dim): what decides the child there."""
    y = np.take_along_axis(q, tree.coords[nodes], -1) * tree.projections[nodes].astype(q.dtype)
    if tree.children.shape[1] == 2:
        return y.sum(-1, keepdims=True)
    return (y @ _MATRIX.astype(q.dtype)) / np.sqrt((y * y).sum(-1, keepdims=True) + q.dtype.type(kernels.EPS))


def _gains(o: np.ndarray, slots: int, greedy: bool) -> np.ndarray:
    """(..., slots): what a path gains by each child; -inf for children that the signs do not lead to.

    Each of eight outputs leads to the child of its sign and gains its size; ``greedy`` follows the largest only.  Of two
    children, the one of the product's sign gains the product's size and the other one nothing.
    """
    size = np.abs(o)
    if slots == 2:
        other = NOWHERE if greedy else np.float32(0)
        return np.concatenate([np.where(o >= 0, other, size), np.where(o >= 0, size, other)], axis=-1)
    if greedy:
        size = np.where(size == size.max(-1, keepdims=True), size, NOWHERE)
    # a query that is 0 in all eight coordinates goes where such points went
    none = np.where((o == 0).all(-1, keepdims=True), np.float32(0), NOWHERE)
    return np.concatenate([np.where(o > 0, size, NOWHERE), np.where(o < 0, size, NOWHERE), none], axis=-1)


def home_leaves(tree: Tree, q: np.ndarray) -> np.ndarray:
    """The leaf where each query would have been put as a point, or -1."""
    at, home = np.zeros(len(q), np.int64), np.full(len(q), NONE)
    on = np.arange(len(q)) if len(tree.children) else np.empty(0, np.int64)
    while len(on):
        o = _outputs(tree, q[on], at[on])
        slot = (o[:, 0] >= 0).astype(int) if tree.children.shape[1] == 2 else kernels.slots(o)
        child = tree.children[at[on], slot]
        home[on] = np.where(child <= -2, -2 - child, NONE)
        at[on] = child
        on = on[child >= 0]
    return home


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest scores of each row, in no order."""
    return np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)


def ranked_leaves(tree: Tree, q: np.ndarray, width: int, greedy: bool = False) -> tuple[np.ndarray, np.ndarray, bool]:
    """(leaves, scores, whole): for each query its best leaves in descending order, with NONE and -inf behind them.

    A leaf's score is what its path gains over the square root of its depth.  Each query follows its ``width`` best nodes
    of every level, all queries at once, so the work does not grow with the tree; ``whole`` says that no path was left.
    The query's home is always first, so an item finds itself.
    """
    n, slots = len(q), tree.children.shape[1] if len(tree.children) else 0
    if not slots:
        leaves = np.broadcast_to(np.arange(len(tree.leaf_counts)), (n, len(tree.leaf_counts)))
        return leaves, np.zeros(leaves.shape, np.float32), True
    home, q = home_leaves(tree, q), q.astype(np.float32)
    nodes, total = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
    found, scores, whole, depth = [home[:, None]], [np.where(home >= 0, np.float32(np.inf), NOWHERE)[:, None]], True, 0
    while nodes.shape[1]:
        depth += 1
        live = np.maximum(nodes, 0)
        reached = (total[:, :, None] + _gains(_outputs(tree, np.broadcast_to(q[:, None], (*nodes.shape, q.shape[1])), live), slots, greedy)).reshape(n, -1)
        child = tree.children[live].reshape(n, -1)
        leaf = np.where((child <= -2) & (-2 - child != home[:, None]), reached, NOWHERE)
        keep = _best(leaf, min(leaf.shape[1], 2 * width))
        found.append(-2 - np.take_along_axis(child, keep, 1))
        scores.append(np.take_along_axis(leaf, keep, 1) / np.float32(depth**0.5))
        inner = np.where(child >= 0, reached, NOWHERE)
        most = int((inner > NOWHERE).sum(1).max(initial=0))
        whole &= most <= width and int((leaf > NOWHERE).sum(1).max(initial=0)) <= keep.shape[1]
        keep = _best(inner, min(most, width)) if most else np.empty((n, 0), np.int64)
        nodes, total = np.take_along_axis(child, keep, 1), np.take_along_axis(inner, keep, 1)
        nodes = np.where(total > NOWHERE, nodes, NONE)
    leaves, scores = np.concatenate(found, axis=1), np.concatenate(scores, axis=1)
    order = np.argsort(-scores, axis=1, kind="stable")
    leaves, scores = np.take_along_axis(leaves, order, 1), np.take_along_axis(scores, order, 1)
    return np.where(scores > NOWHERE, leaves, NONE), scores, whole


def take_leaves(tree: Tree, q: np.ndarray, required: int, greedy: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) pairs, by query and descending score, until a query's leaves hold ``required`` points.  Where the
    paths followed do not hold them, twice as many are, up to all that the query's signs lead to."""
    if not len(tree.leaf_counts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = max(8, int(required / tree.leaf_counts.mean()) + 1)
    while True:
        leaves, scores, whole = ranked_leaves(tree, q, width, greedy)
        reached = leaves >= 0
        counts = np.where(reached, tree.leaf_counts[np.maximum(leaves, 0)], 0).astype(np.int64)
        held = np.cumsum(counts, axis=1)
        if whole or (held[:, -1] >= required).all():
            break
        width *= 2
    query, place = np.nonzero(reached & (held - counts < required))
    return query, leaves[query, place]


def points(tree: Tree, query: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row position) of all members of the leaves taken."""
    counts = tree.leaf_counts[leaf].astype(np.int64)
    ends = np.cumsum(counts)
    at = np.repeat(tree.starts[leaf] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)
    return np.repeat(query, counts), tree.members[at]
