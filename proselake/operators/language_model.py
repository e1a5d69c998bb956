"""An interpolated Kneser-Ney model of word sequences as tables, and the loss of every token under it.

Counts, continuation counts and their discounts come from aggregates; a gram's probability is worked out from its counts and
its shorter tail's, and what training never saw backs off the same way. Tokens are never shuffled: groups of texts send each
distinct gram and context once to its bucket, packed, and get the counts back as small numbers in the same order. The driver
holds two numbers for each order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.sources.files import materialized

#: Stands before a text's first token; no token holds its characters.
PAD = "<s>"


#: Characters of texts that are counted or scored together; a longer text stands alone.
GROUP = 1 << 24
PACKED = "bucket int, keys binary, numbers binary"


@dataclass(frozen=True)
class Model:
    order: int
    counts: dict[int, DataFrame]  # gram, n
    contexts: dict[int, DataFrame]  # context, total, kinds
    discounts: dict[int, float]
    total: int
    unknown: float
    facts: DataFrame  # packed by buckets: n of grams, total and kinds of contexts (with a space before them)
    buckets: int

    def probability(self, k: int, n, total, kinds, lower):
        """Of grams of k words that were seen n times, from their tails'; works on columns and arrays."""
        d = self.discounts[k]
        return (n - d) / total + d * kinds / total * lower


def tail(gram: Column) -> Column:
    """A gram without its first word."""
    return F.substring(gram, F.instr(gram, F.lit(" ")) + 1, F.length(gram))


def context(gram: Column, words: int) -> Column:
    """A gram of so many words without its last."""
    return F.substring_index(gram, " ", words - 1)


def _keys(lowered: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[pa.Array, np.ndarray]]]:
    """Text and place of each token; and the distinct grams of 1 to `order` words and the contexts of 1 to order - 1 words before
    them, each kind in the order of its words, with the one that each token has."""
    found = [re.findall(T.TOKEN, t or "") for t in lowered]
    sizes = np.array([len(f) for f in found], np.int64)
    doc = np.repeat(np.arange(len(found)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pads = [PAD] * (order - 1)
    coded = pa.array([w for f in found for w in (*pads, *f)], pa.string()).dictionary_encode()
    by_word = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(by_word)
    rank = np.empty(len(words), np.int64)
    rank[by_word.to_numpy()] = np.arange(len(words))
    ids = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    ends = np.arange(len(doc)) + (doc + 1) * (order - 1)

    def sequences(last: np.ndarray, most: int) -> list[tuple[pa.Array, np.ndarray]]:
        out = []
        for k in range(most):
            own = ids[last - k]
            if k:
                texts, of = out[-1]
                pair, of = np.unique(own * len(texts) + of, return_inverse=True)
                out.append((pc.binary_join_element_wise(words.take(pa.array(pair // len(texts))), texts.take(pa.array(pair % len(texts))), " "), of.ravel()))
            else:
                pair, of = np.unique(own, return_inverse=True)
                out.append((words.take(pa.array(pair)), of.ravel()))
        return out

    if not len(doc):
        return doc, place, []
    marked = [(pc.binary_join_element_wise("", c, " "), of) for c, of in sequences(ends - 1, order - 1)]
    return doc, place, [*sequences(ends, order), *marked]


def _dealt(keys: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys, ascending)."""
    b = np.fromiter(map(zlib.crc32, keys.cast(pa.binary()).to_pylist()), np.int64, len(keys)) % buckets
    order = np.argsort(b, kind="stable")
    at = np.flatnonzero(np.diff(b[order], prepend=-1))
    for s, e in zip(at, np.append(at[1:], len(b))):
        yield int(b[order[s]]), order[s:e]


def _packed(keys: pa.Array) -> bytes:
    return zlib.compress("\n".join(keys.to_pylist()).encode(), 1)


def _unpacked(blob: bytes) -> pa.Array:
    return pa.array(zlib.decompress(blob).decode().split("\n"), pa.string())


def _numbers(x: np.ndarray) -> bytes:
    """Columns of whole numbers, byte by byte, as most are small."""
    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(x, "<i8").view("u1").reshape(*x.shape, 8).transpose(0, 2, 1)).tobytes(), 1)


def _of_numbers(blob: bytes, columns: int) -> np.ndarray:
    x = np.frombuffer(zlib.decompress(blob), "u1").reshape(columns, 8, -1)
    return np.ascontiguousarray(x.transpose(0, 2, 1)).view("<i8")[:, :, 0]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names=names)


_KINDS = [pa.int32(), pa.binary(), pa.binary()]
_NAMES = ["bucket", "keys", "numbers"]


def _rows(keys: pa.Array, numbers: np.ndarray, buckets: int) -> pa.Table:
    return _batch([(b, _packed(keys.take(pa.array(k))), _numbers(numbers[:, k])) for b, k in _dealt(keys, buckets)], _NAMES, _KINDS)


def _summed(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The keys of packed rows in order, with their numbers added up."""
    parts = [(_unpacked(k), _of_numbers(n, 2)) for k, n in zip(t["keys"].to_pylist(), t["numbers"].to_pylist())]
    numbers = np.concatenate([n for _, n in parts], 1)
    every = pa.table([pa.concat_arrays([k for k, _ in parts]), pa.array(numbers[0]), pa.array(numbers[1])], names=["key", "a", "b"])
    every = every.group_by("key").aggregate([("a", "sum"), ("b", "sum")]).sort_by("key")
    return every["key"].combine_chunks(), np.stack([every["a_sum"].to_numpy(), every["b_sum"].to_numpy()])


def _counted(texts: DataFrame, order: int, text_col: str, buckets: int) -> DataFrame:
    """(bucket, keys, numbers): how often each gram of `order` words occurs, packed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(part: list[str]) -> list[pa.RecordBatch]:
            _, _, keys = _keys(part, order)
            if not keys:
                return []
            grams, of = keys[order - 1]
            n = np.bincount(of, minlength=len(grams))
            return _rows(grams, np.stack([n, np.zeros_like(n)]), buckets).to_batches()

        part, size = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                part.append(t)
                size += len(t)
                if size >= GROUP:
                    yield from told(part)
                    part, size = [], 0
        yield from told(part)

    def add(t: pa.Table) -> pa.Table:
        keys, numbers = _summed(t)
        return _batch([(t["bucket"][0].as_py(), _packed(keys), _numbers(numbers))], _NAMES, _KINDS)

    lowered = texts.select(F.lower(F.col(text_col)).alias("text")).where("text IS NOT NULL")
    return lowered.mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(add, PACKED)


def _grams(packed: DataFrame) -> DataFrame:
    """(gram, n) of packed counts."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch["keys"].to_pylist(), batch["numbers"].to_pylist()):
                yield pa.RecordBatch.from_arrays([_unpacked(k), pa.array(_of_numbers(n, 2)[0])], ["gram", "n"])

    return packed.mapInArrow(unpack, "gram string, n long")


def _repacked(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows (key, a, b) packed, those of an Arrow batch together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for batch in batches:
            part.append(batch)
            size += batch.num_rows
            if size >= 1 << 20:
                yield from packed(part)
                part, size = [], 0
        if part:
            yield from packed(part)

    def packed(part: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(part).sort_by("key")
        return _rows(t["key"].combine_chunks(), np.stack([t["a"].to_numpy(), t["b"].to_numpy()]), buckets).to_batches() if t.num_rows else []

    return rows.mapInArrow(pack, PACKED)


def discount(counts: DataFrame) -> float:
    """n1 / (n1 + 2 n2) from the counts of counts; a half where nothing was counted once, as unseen grams need a share."""
    r = counts.agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).first()
    return r["one"] / (r["one"] + 2 * r["two"]) if r["one"] else 0.5


def _parts(texts: DataFrame, text_col: str) -> int:
    return max(texts.sparkSession.sparkContext.defaultParallelism * 2, (texts.agg(F.sum(F.length(text_col))).first()[0] or 0) // GROUP)


def fit(texts: DataFrame, order: int = 3, text_col: str = "text") -> Model | None:
    """A model of all texts; None if they have no token.

    The longest grams go by how often they occur, shorter ones by how many different words precede them. A word that was never
    seen has the share that all words leave it. Null texts count as empty.
    """
    buckets = _parts(texts, text_col)
    packed = materialized(_counted(texts, order, text_col, buckets))
    counts, contexts = {order: _grams(packed)}, {}
    for k in range(order - 1, 0, -1):
        counts[k] = materialized(counts[k + 1].groupBy(tail(F.col("gram")).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    total = counts[1].agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).first()
    if not total["n"]:
        return None
    d = {k: discount(counts[k]) for k in counts}
    unknown = d[1] * total["words"] / total["n"] / (total["words"] + 1)
    facts = packed
    for k in range(1, order):
        facts = facts.unionByName(_repacked(counts[k].select(F.col("gram").alias("key"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")), buckets))
        of = counts[k + 1].groupBy(context(F.col("gram"), k + 1).alias("context"))
        contexts[k + 1] = materialized(of.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))
        facts = facts.unionByName(_repacked(contexts[k + 1].select(F.concat(F.lit(" "), "context").alias("key"), F.col("total").alias("a"), F.col("kinds").alias("b")), buckets))
    return Model(order, counts, contexts, d, total["n"], unknown, facts, buckets)


def probabilities(model: Model, asked: DataFrame) -> DataFrame:
    """(gram, p) of distinct grams of the model's order: what was seen as it is, all else by its tail."""
    rows = asked.withColumn(f"_g{model.order}", F.col("gram"))
    for k in range(model.order - 1, 0, -1):
        rows = rows.withColumn(f"_g{k}", tail(F.col(f"_g{k + 1}")))
    p: Column = F.lit(model.unknown)
    for k in range(1, model.order + 1):
        rows = rows.join(model.counts[k].select(F.col("gram").alias(f"_g{k}"), F.col("n").alias(f"_n{k}")), f"_g{k}", "left")
        n = F.col(f"_n{k}")
        if k > 1:
            own = model.contexts[k].select(F.col("context").alias(f"_c{k}"), F.col("total").alias(f"_t{k}"), F.col("kinds").alias(f"_k{k}"))
            rows = rows.withColumn(f"_c{k}", context(F.col(f"_g{k}"), k)).join(own, f"_c{k}", "left")
            share = model.probability(k, F.greatest(F.coalesce(n, F.lit(0)), F.lit(model.discounts[k])), F.col(f"_t{k}"), F.col(f"_k{k}"), p)
            p = F.coalesce(share, p)
        else:
            p = F.coalesce(F.greatest(n - model.discounts[1], F.lit(0.0)) / model.total + model.unknown, p)
    return rows.select("gram", p.alias("p"))


def losses(model: Model, texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, at, loss): minus the logarithm of each token's probability."""
    order, buckets, d, total, unknown = model.order, model.buckets, model.discounts, model.total, model.unknown
    probability = Model(order, {}, {}, d, total, unknown, None, buckets).probability  # without tables, for the tasks
    groups = _parts(texts, text_col)
    own = texts.select(*keys, F.lower(F.col(text_col)).alias("_text")).where("_text IS NOT NULL")
    rows = own.withColumn("_g", F.pmod(F.xxhash64("_text", *keys), F.lit(groups)).cast("int"))

    def ask(t: pa.Table) -> pa.Table:
        _, _, kinds = _keys(t["_text"].to_pylist(), order)
        every = pa.concat_arrays([pa.array([], pa.string()), *(k for k, _ in kinds)])
        return _batch([(b, t["_g"][0].as_py(), _packed(every.take(pa.array(k)))) for b, k in _dealt(every, buckets)], ["bucket", "_g", "asked"], [pa.int32(), pa.int32(), pa.binary()])

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            known, numbers = _summed(right) if right.num_rows else (pa.array([], pa.string()), np.zeros((2, 0), np.int64))
            numbers = np.concatenate([numbers, np.zeros((2, 1), np.int64)], 1)
            asked = [_unpacked(blob) for blob in left["asked"].to_pylist()]
            place = pc.index_in(pa.concat_arrays(asked), value_set=known).fill_null(len(known)).to_numpy()
            ends = np.cumsum([len(x) for x in asked])
            out = [(b, g, _numbers(numbers[:, place[e - len(x) : e]])) for b, g, x, e in zip(left["bucket"].to_pylist(), left["_g"].to_pylist(), asked, ends)]
        return _batch(out, ["bucket", "_g", "told"], [pa.int32(), pa.int32(), pa.binary()])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, place, kinds = _keys(left["_text"].to_pylist(), order)
        loss = np.zeros(0)
        if kinds:
            every = pa.concat_arrays([k for k, _ in kinds])
            told = dict(zip(right["bucket"].to_pylist(), right["told"].to_pylist()))
            numbers = np.empty((2, len(every)), np.int64)
            for b, k in _dealt(every, buckets):
                numbers[:, k] = _of_numbers(told[b], 2)
            start = np.cumsum([0, *(len(k) for k, _ in kinds)])
            got = [numbers[:, start[i] + of] for i, (_, of) in enumerate(kinds)]
            n = got[0][0]
            p = np.where(n > 0, np.maximum(n - d[1], 0) / total + unknown, unknown)
            for k in range(2, order + 1):
                n, (of, different) = got[k - 1][0], got[order + k - 2]
                p = np.where(of > 0, probability(k, np.maximum(n, d[k]), np.maximum(of, 1), different, p), p)
            loss = -np.log(p)
        return pa.table([*(left[k].take(pa.array(doc)) for k in keys), pa.array(place, pa.int32()), pa.array(loss, pa.float64())], names=[*keys, "at", "loss"])

    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)
    asked = rows.groupBy("_g").applyInArrow(ask, "bucket int, _g int, asked binary")
    told = asked.groupBy("bucket").cogroup(model.facts.groupBy("bucket")).applyInArrow(tell, "bucket int, _g int, told binary")
    return rows.groupBy("_g").cogroup(told.groupBy("_g")).applyInArrow(score, f"{kinds}, at int, loss double")
