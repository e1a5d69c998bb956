"""Embedding near-duplicates (operator 9): a forest of random-projection trees whose halves overlap.

Every node projects its vectors on a random direction and splits them at the median. Vectors near the split go to both sides:
a share `spill` of them, and all within `margin` of the distance along a random direction that linked vectors have. A node
that such a split doesn't shrink is a dense cluster and stays a leaf, and so is one of few vectors. Leaves hold one label only.

1. Each label is a cell of each tree. Cells of more than `cell_rows` vectors are split in rounds: a task fits the upper levels of
   a cell on a bounded sample of it, and its rows go down these levels to smaller cells. The driver fits nothing.
2. The task of a cell grows the rest of the tree on the cell's own vectors and tells the leaves of each.
3. Cells are dealt once more, with the leaves that each vector has in all trees. Vectors are compared within leaves in double
   precision. Each pair counts in the first leaf that both share, and dense slabs count by masks, without listing pairs. Cells send
   stars, not pairs, to the union of components. A cluster beyond `cell_rows` is compared in pairs of blocks, a task each.

Equal vectors of a label are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.llm.common import cut, local_components, valid_vectors
from proselake.llm.components import connected_components
from proselake.llm.hash_index import _rows

DEEPEST = 48
#: Pairs that are compared at once: a slab's products take 8 bytes each.
SLAB_CELLS = 1 << 22
SHRINK = 0.7


@dataclass
class Splitter:
    """How nodes split: overlap by share and by distance, and where splitting ends."""

    dims: int
    spill: float
    reach: float
    least_rows: int
    most_rows: int
    seed: int

    def direction(self, tree: int, node: int, attempt: int) -> np.ndarray:
        v = np.random.default_rng((self.seed, tree, node, attempt)).standard_normal(self.dims)
        return v / np.linalg.norm(v)

    def leaf_rows(self, n: int) -> int:
        """Rows of the largest leaf of a cell of n rows that isn't a cluster: the root of n, within bounds."""
        return min(self.most_rows, max(self.least_rows, int(n**0.5)))

    def split(self, x: np.ndarray, tree: int, node: int) -> tuple[int, float, float] | None:
        """(attempt, low, high): rows up to high go left, rows over low go right. None if no direction shrinks the node."""
        for attempt in range(3):
            p = x @ self.direction(tree, node, attempt)
            low, mid, high = np.quantile(p, [0.5 - self.spill, 0.5, 0.5 + self.spill])
            low, high = min(low, mid - self.reach), max(high, mid + self.reach)
            if max((p <= high).sum(), (p > low).sum()) <= SHRINK * len(p):
                return attempt, float(low), float(high)
        return None

    def halves(self, x: np.ndarray, own: np.ndarray, tree: int, node: int, how: tuple[int, float, float]) -> list[tuple[int, np.ndarray]]:
        p = x[own] @ self.direction(tree, node, how[0])
        return [(2 * node, own[p <= how[2]]), (2 * node + 1, own[p > how[1]])]

    def grow(self, x: np.ndarray, tree: int, node: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the whole tree below a node; leaf numbers hold the tree."""
        rows, leaves, todo, small = [], [], [(node, np.arange(len(x)))], self.leaf_rows(len(x))
        while todo:
            at, own = todo.pop()
            how = self.split(x[own], tree, at) if len(own) > small and at >> DEEPEST == 0 else None
            if how is None:
                rows.append(own)
                leaves.append(np.full(len(own), (tree << 50) | at))
            else:
                todo += self.halves(x, own, tree, at, how)
        return np.concatenate(rows), np.concatenate(leaves)

    def upper(self, sample: np.ndarray, tree: int, node: int, levels: int) -> dict[int, tuple[int, float, float]]:
        """Splits of the upper levels below a node, as far as the sample tells: by node."""
        out, todo = {}, [(node, np.arange(len(sample)), levels)]
        while todo:
            at, own, more = todo.pop()
            how = self.split(sample[own], tree, at) if more and len(own) >= 64 and at >> DEEPEST == 0 else None
            if how:
                out[at] = how
                todo += [(n, o, more - 1) for n, o in self.halves(sample, own, tree, at, how)]
        return out


def _unit(col) -> np.ndarray:
    x = _rows(col)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shared_before(held: list[list[int]], leaf: int) -> np.ndarray | None:
    """Rows by earlier leaves, as 0 and 1; None if there are none."""
    seen: dict[int, int] = {}
    where = [(k, seen.setdefault(x, len(seen))) for k, own in enumerate(held) for x in own if x < leaf]
    if not where:
        return None
    m = np.zeros((len(held), len(seen)), np.float32)
    m[tuple(zip(*where))] = 1
    return m


def _links(leaf: int, x: np.ndarray, y: np.ndarray, same: bool, held_x: list, held_y: list, least: float, n_x: np.ndarray, n_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of x, links of y, u, v): how many rows, n_x and n_y of each, every vector links with first in this leaf, and edges
    among the rows of x, then y, that join whatever is linked. Slabs of x meet all of y; the pairs of a dense slab are never
    listed: they are counted by products of masks, and its edges are stars."""
    links_x, links_y, us, vs = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), [], []
    slab = max(16, min(1024, SLAB_CELLS // max(1, len(y))))
    for at in range(0, len(x), slab):
        mask = x[at : at + slab] @ y.T >= least
        if same:
            mask &= np.arange(len(y))[None, :] > np.arange(at, at + len(mask))[:, None]
        rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        if not len(rows):
            continue
        mask = mask[np.ix_(rows, cols)]
        both = _shared_before([held_x[at + r] for r in rows] + [held_y[c] for c in cols], leaf)
        first = mask if both is None else mask & ~(both[: len(rows)] @ both[len(rows) :].T > 0)
        links_x[at + rows] += (first @ n_y[cols].astype(np.float64)).astype(np.int64)
        links_y[cols] += (n_x[at + rows].astype(np.float64) @ first).astype(np.int64)
        u, v = _stars(mask, at + rows, len(x) + cols)
        us.append(u)
        vs.append(v)
    none = [np.zeros(0, np.int64)]
    return links_x, links_y, np.concatenate(us or none), np.concatenate(vs or none)


def _stars(mask: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of a mask's: the pairs themselves if they are few, else one for each row and column, to the
    smallest number that labels reach when they go to and fro."""
    if np.count_nonzero(mask) <= 32 * (len(rows) + len(cols)):
        i, j = np.nonzero(mask)
        return rows[i], cols[j]
    of_row, of_col, far = rows.copy(), cols.copy(), np.iinfo(np.int64).max
    while True:
        row = np.minimum(of_row, np.where(mask, of_col[None, :], far).min(1))
        col = np.minimum(of_col, np.where(mask, row[:, None], far).min(0))
        if (row == of_row).all() and (col == of_col).all():
            return np.concatenate([rows, cols]), np.concatenate([row, col])
        of_row, of_col = row, col


def _split_rounds(cells: DataFrame, how: Splitter, kind: str, cell_rows: int, sample_rows: int, levels: int, broadcast_cells: int) -> DataFrame:
    """Cells (label, tree, node, e, vec) split until each has at most `cell_rows` rows or can't be split; with `rows` of those that can't."""
    where = ["label", "tree", "node"]
    done = None
    while True:
        sizes = cut(cells.groupBy(*where).count().where(F.col("count") > cell_rows))
        n = sizes.count()
        if not n:
            rest = cells.withColumn("rows", F.lit(None).cast("long"))
            return rest if done is None else done.unionByName(rest)

        def fit(t: pa.Table) -> pa.Table:
            label, tree, node = (t[c][0].as_py() for c in where)
            found = how.upper(_unit(t["vec"]), tree, node, levels)
            cols = list(zip(*((at, *s) for at, s in found.items()))) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64())
            arrays = [pa.array([list(c)], pa.list_(k)) for c, k in zip(cols, kinds)]
            return pa.table([pa.array([label], pa.string()), pa.array([tree], pa.int32()), pa.array([node], pa.int64()), *arrays], names=[*where, "at", "attempt", "low", "high"])

        few = F.broadcast(sizes) if n <= broadcast_cells else sizes
        sample = cells.join(few, where).where(F.pmod(F.xxhash64("e", "node"), F.ceil(F.col("count") / sample_rows)) == 0)
        splits = cut(sample.select(*where, "vec").groupBy(*where).applyInArrow(fit, "label string, tree int, node long, at array<long>, attempt array<int>, low array<double>, high array<double>"))
        splits = sizes.join(splits, where, "left")

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _unit(b.column(4))
                tree, node = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                rows, ends = [], []
                own: dict[tuple, list[int]] = {}
                for k, cell in enumerate(zip(b.column(0).to_pylist(), tree.tolist(), node.tolist())):
                    own.setdefault(cell, []).append(k)
                for (_, t, start), mine in own.items():
                    splits_of = [b.column(k)[mine[0]].as_py() for k in (5, 6, 7, 8)]
                    split = dict(zip(splits_of[0], zip(*splits_of[1:])))
                    todo = [(start, np.array(mine))]
                    while todo:
                        at, o = todo.pop()
                        if at in split and len(o):
                            todo += how.halves(x, o, t, at, split[at])
                        else:
                            rows.append(o)
                            ends.append(np.full(len(o), at))
                rows, ends = np.concatenate(rows), np.concatenate(ends)
                took = pa.Table.from_batches([b]).take(pa.array(rows))
                yield from pa.table([took.column(0), took.column(1), pa.array(ends), took.column(3), took.column(4)], names=["label", "tree", "node", "e", "vec"]).to_batches()

        joined = cells.join(F.broadcast(splits) if n <= broadcast_cells else splits, where, "left")
        stuck = joined.where(F.col("count").isNotNull() & (F.coalesce(F.size("at"), F.lit(0)) < 1)).select(*where, "e", "vec", F.col("count").alias("rows"))
        done = cut(stuck) if done is None else cut(done.unionByName(stuck))
        small = joined.where(F.col("count").isNull()).select(*where, "e", "vec")
        split = joined.where(F.size("at") >= 1).select("label", "tree", "node", "e", "vec", "at", "attempt", "low", "high")
        cells = cut(small.unionByName(split.mapInArrow(descend, f"label string, tree int, node long, e long, vec {kind}")))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, trees: int = 6, spill: float = 0.05, margin: float = 0.6, least_rows: int = 32, most_rows: int = 512, cell_rows: int = 32_768, block_rows: int = 8192, sample_rows: int = 4096, levels: int = 6, broadcast_cells: int = 1000, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    n_links counts the other rows of the same label with cosine `least` or more that were found; component_id is the smallest
    id reachable. Rows with a null label, a vector that is null, zero or holds null or non-finite components, or a null id
    link with nothing and are their own component (null, and not kept, for a null id). Vectors of other lengths than the
    commonest link only with their equals. Rows that repeat an id stay; they count as rows. An empty table: no rows.

    least_rows, most_rows: bounds of a leaf, which is as large as the root of its cell between them. Rounds of splitting are only
    needed for labels of more than `cell_rows` vectors; the trees below are grown at every size.
    """
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    usable = valid_vectors(every, "vec").where("label IS NOT NULL AND vec_id IS NOT NULL")
    entries = usable.groupBy("label", "vec").agg(F.min("vec_id").alias("key"), F.count(F.lit(1)).alias("n"))
    entries = cut(entries.withColumn("e", F.monotonically_increasing_id()))
    sizes = entries.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    alone = every.select("vec_id", "label", "vec")
    if sizes is None:
        return alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dims, kind = sizes["d"], dict(entries.dtypes)["vec"]
    # what linked unit vectors differ by along a random direction, typically
    how = Splitter(dims, spill, margin * (2 - 2 * least) ** 0.5 / dims**0.5, least_rows, most_rows, seed)
    fit = entries.where(F.size("vec") == dims)
    where = ["label", "tree", "node"]
    cells = fit.select("label", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"), "e", "vec")
    cells = _split_rounds(cells, how, kind, cell_rows, sample_rows, levels, broadcast_cells)

    def grow(t: pa.Table) -> pa.Table:
        label, tree, node = (t[c][0].as_py() for c in where)
        t = t.sort_by("e")
        rows, leaves = how.grow(_unit(t["vec"]), tree, node)
        order = np.lexsort((leaves, rows))
        rows, leaves = rows[order], leaves[order]
        held = np.split(leaves, np.flatnonzero(np.diff(rows)) + 1)
        n = t.num_rows
        return pa.table([pa.array([label] * n, pa.string()), pa.array([tree] * n, pa.int32()), pa.array([node] * n, pa.int64()), t["e"], pa.array(held, pa.list_(pa.int64()))], names=[*where, "e", "leaves"])

    told = "label string, tree int, node long, e long, leaves array<long>"
    grown = cells.where("rows IS NULL").select(*where, "e", "vec").groupBy(*where).applyInArrow(grow, told).withColumn("rows", F.lit(None).cast("long"))
    whole = F.array(F.shiftleft(F.col("tree").cast("long"), 50).bitwiseOR(F.col("node")))
    grown = grown.unionByName(cells.where("rows IS NOT NULL").select(*where, "e", whole.alias("leaves"), "rows"))
    homes = grown.groupBy("e").agg(F.collect_list(F.struct("tree", "node", "leaves", "rows")).alias("homes"))
    placed = fit.select("label", "e", "key", "vec", "n").join(homes, "e").withColumn("held", F.array_sort(F.flatten("homes.leaves")))
    placed = placed.withColumn("home", F.explode("homes"))
    placed = placed.withColumn("blocks", F.coalesce(F.ceil(F.col("home.rows") / (block_rows // 2)), F.lit(1)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("label", "home.tree", "home.node", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "e", "key", "vec", "n", "held", "home.leaves")

    def compare(t: pa.Table) -> pa.Table:
        one, two = t["one"][0].as_py(), t["two"][0].as_py()
        t = t.sort_by([("key", "ascending"), ("e", "ascending")])
        key, n, block = t["key"].to_numpy(), t["n"].to_numpy(), t["block"].to_numpy()
        x, held = _unit(t["vec"]), t["held"].to_pylist()
        rows = np.repeat(np.arange(len(key)), [len(v) for v in t["leaves"].to_pylist()])
        leaf = t["leaves"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((rows, leaf))
        rows, leaf = rows[order], leaf[order]
        links, us, vs = np.zeros(len(key), np.int64), [], []
        starts = np.flatnonzero(np.concatenate(([True], np.diff(leaf) != 0)))
        for at, own in zip(leaf[starts].tolist(), np.split(rows, starts[1:])):
            a, b = (own, own) if one == two else (own[block[own] == one], own[block[own] == two])
            if len(own) < 2 or not len(a) or not len(b):
                continue
            of_a, of_b, u, v = _links(at, x[a], x[b], one == two, [held[k] for k in a], [held[k] for k in b], least, n[a], n[b])
            links[a] += of_a
            links[b] += of_b
            nodes = np.concatenate([a, b])
            us.append(nodes[u])
            vs.append(nodes[v])
        label = local_components(len(key), np.concatenate(us), np.concatenate(vs)) if us else np.arange(len(key))
        told = (links > 0) | (label != np.arange(len(key)))
        return pa.table([t["e"].filter(pa.array(told)), pa.array(key[told]), pa.array(links[told]), pa.array(key[label[told]])], names=["e", "key", "links", "to"])

    found = cut(placed.groupBy(*where, "one", "two").applyInArrow(compare, "e long, key long, links long, to long"))
    comps = connected_components(found.select(F.col("key").alias("src"), F.col("to").alias("dst"))).withColumnRenamed("node", "key")
    links = found.groupBy("e").agg(F.sum("links").alias("links"))
    # an id with several vectors or labels has several entries; its rows are joined by vector and label
    by_entry = entries.join(links, "e", "left").join(comps, "key", "left")
    by_entry = by_entry.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "key").alias("component"))
    valid = usable.join(by_entry, ["label", "vec"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    is_usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rest = alone.where(~is_usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
