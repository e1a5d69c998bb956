"""SimHash near-duplicates (operator 2): fingerprints of word shingles, linked through sharded BK-trees.

Distinct fingerprints are dealt to shards by the pigeonhole principle: of radius + 1 equal parts of the 64 bits, two
fingerprints within `radius` differing bits agree on one at least, so every part is a shard key. A shard of more than `shard_codes`
is dealt to shards of its own by the parts of the bits that are left, and so on, which loses no pair and bounds every shard.
Each shard holds a BK-tree (children keyed by their integer Hamming distance to the parent); a search follows only edges
within the radius. A shard's tree is built where its members meet and isn't broadcast: broadcasting passes through the driver,
and fingerprints of all documents may not.

Copies collapse to one fingerprint before the shuffle; links leave a shard as stars, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.llm.common import cut, local_components
from proselake.llm.components import connected_components

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the whole text; 0 for a text that is null or has no words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles = iter((b" ".join(w),))
        n = 1
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
        n = len(w) - words + 1
    digests = map(xxhash.xxh64_digest, shingles, repeat(SEED))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        block = b"".join(islice(digests, min(CHUNK, n - at)))
        bits = np.unpackbits(np.frombuffer(block, np.uint8)).reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp) and the columns to carry: fp is the fingerprint's 64 bits as a signed long. Other columns aren't read."""
    names = [f"carry_{k}" for k in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), words) for t in b.column(1)]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), fp, *b.columns[2:]], names=["id", "fp", *names])

    kinds = dict(docs.dtypes)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    return own.mapInArrow(run, ", ".join(["id long", "fp long", *(f"{n} {kinds[c]}" for c, n in zip(carry, names))]))


class BKTree:
    """Codes by Hamming distance: children keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> int:
        self.codes.append(code)
        self.children.append({})
        new = len(self.codes) - 1
        if new:
            at = 0
            while True:
                d = (self.codes[at] ^ code).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = new
                    break
                at = nxt
        return new

    def within(self, code: int, radius: int) -> list[int]:
        """Places of the codes within the radius, following only edges that can hold one."""
        found, todo = [], [0] if self.codes else []
        while todo:
            at = todo.pop()
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                todo += [c for e, c in kids.items() if d - radius <= e <= d + radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found


def _tree_links(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    tree, us, vs = BKTree(), [], []
    for k, code in enumerate(codes.tolist()):
        for m in tree.within(code, radius):
            us.append(k)
            vs.append(m)
        tree.add(code)
    return np.array(us, np.int64), np.array(vs, np.int64)


def _shard_stars(shard: np.ndarray, codes: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Star edges of whole shards, which stand together."""
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    sizes = np.diff(np.append(starts, len(shard)))
    for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        c = np.sort(codes[s : s + n].view(np.int64))
        u, v = _tree_links(c.view(np.uint64), radius)
        if len(u):
            label = local_components(n, u, v)
            moved = label != np.arange(n)
            src.append(c[moved])
            dst.append(c[label[moved]])
    return src, dst


def parts(mask: int, n: int) -> list[int]:
    """Masks that add one of n equal parts of the bits that the mask leaves out."""
    left = [b for b in range(64) if not mask >> b & 1]
    bounds = [len(left) * k // n for k in range(n + 1)]
    return [mask | sum(1 << b for b in left[s:e]) for s, e in zip(bounds, bounds[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(codes: DataFrame, radius: int = 2, shard_codes: int = 512, broadcast_rows: int = 100_000) -> DataFrame:
    """(fp, mask, value): the shards of each distinct code; value are its bits under the mask. No shard has more than `shard_codes`."""
    masks = parts(0, radius + 1)

    def dealt(rows: DataFrame, of: Column) -> DataFrame:
        return rows.select("fp", F.explode(of).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))

    done, rest = None, dealt(codes.select("fp"), F.array(*(F.lit(_signed(m)).cast("long") for m in masks)))
    while True:
        large = cut(rest.groupBy("mask", "value").count().where(F.col("count") > shard_codes).select("mask", "value"))
        n = large.count()
        if not n:
            return rest if done is None else done.unionByName(rest)
        few = F.broadcast(large) if n <= broadcast_rows else large
        small = rest.join(few, ["mask", "value"], "left_anti").select("fp", "mask", "value")
        done = small if done is None else done.unionByName(small)
        finer = F.create_map(*(x for m in masks for x in (F.lit(_signed(m)).cast("long"), F.array(*(F.lit(_signed(k)).cast("long") for k in parts(m, radius + 1))))))
        rest = cut(dealt(rest.join(few, ["mask", "value"], "left_semi"), finer[F.col("mask")]).distinct())  # two ways can lead to one mask
        masks = sorted({k for m in masks for k in parts(m, radius + 1)})


def shard_links(codes: DataFrame, radius: int = 2, shard_codes: int = 512) -> DataFrame:
    """(src, dst) star edges that connect all distinct codes (column fp) within `radius` bits, directly or in steps."""
    if not 0 <= radius <= 7 or shard_codes < 1 << (radius + 1):
        raise ValueError("0 <= radius <= 7 and shards of 2 ** (radius + 1) codes at least are required")
    # rows of one shard stand together in one partition, next to those of others
    keyed = shards(codes, radius, shard_codes).repartition("mask", "value").sortWithinPartitions("mask", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k = np.zeros((0, 2), np.int64)
        held_c = np.zeros(0, np.uint64)

        def out(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(c):
                change = np.concatenate(([False], (k[1:] != k[:-1]).any(1)))
                s, d = _shard_stars(np.cumsum(change), c, radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s)), pa.array(np.concatenate(d))], names=["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)], 1)
            held_k = np.concatenate([held_k, k])
            held_c = np.concatenate([held_c, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = np.flatnonzero((held_k != held_k[-1]).any(1))
            whole = last[-1] + 1 if len(last) else 0
            yield from out(held_k[:whole], held_c[:whole])
            held_k, held_c = held_k[whole:], held_c[whole:]
        yield from out(held_k, held_c)

    return keyed.select("fp", "mask", "value").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, component_id, n_same, component) and the columns to carry: component_id is the smallest id reachable over links of
    `radius` bits or fewer, component the smallest fingerprint, n_same the rows with the same one.

    Null or empty texts have fingerprint zero and link like any other. A row with a null id keeps its row; it takes the
    component of its fingerprint and is never its smallest id. Repeated rows stay. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words, carry))
    reps = cut(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n_same")))
    comps = connected_components(shard_links(reps.select("fp"), radius))
    reps = reps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = reps.groupBy("component").agg(F.min("low").alias("component_id"))
    reps = reps.join(lows, "component").select("fp", "component_id", "n_same", "component")
    found = fps.join(reps, "fp").select("id", "fp", "component_id", "n_same", "component", *(f"carry_{k}" for k in range(len(carry))))
    return found.withColumnsRenamed({f"carry_{k}": c for k, c in enumerate(carry)})
