"""Mixing sources to target weights (operator 7): Pfair scheduling of blocks, with DataFrame functions only.

Each source is cut into blocks of about equal size. Block i (from 0) of a source with share s of a period of H slots is
released at floor(i * H / s) and due by ceil((i + 1) * H / s); earliest deadline first, among released blocks, fills the
slots. The shares are the exact weights as whole numbers and sum to H, so every block meets its deadline and no source is
ever a whole block away from its weight. A short period is laid out once by the driver and repeated; under weights with a
long one, the driver lays out the slots of the whole stream, a row for each block.

When a source has no block left, a new phase begins in which the others share the slots by their weights. Every document
is in the stream once. The driver sees the number of blocks of each source, never rows. Documents find their phase by their
source and its place by their block's number in the period, so that no table with a row for each block is made or sent where
periods repeat; blocks grow with the data once there would be more than `most_blocks`, which bounds a layout to the end.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.llm.common import cut, session_of, shuffle_partitions


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole shares of the period: largest remainders, at least one each."""
    total = sum(weights.values())
    exact = {s: Fraction(w) * period / Fraction(total) for s, w in weights.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(shares.values()) >= period:
            break
        shares[s] += 1
    return shares


def exact_shares(weights: dict[str, Fraction]) -> dict[str, int]:
    """Weights as the smallest whole numbers in the same proportion."""
    unit = math.lcm(*(w.denominator for w in weights.values()))
    whole = {s: int(w * unit) for s, w in weights.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def one_period(shares: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, list[int]]:
    """Slots of each source's blocks in a period of as many slots as there are shares, earliest deadline first.

    blocks: the period ends early, with the last block of the first source that runs out.
    """
    h = sum(shares.values())
    slots: dict[str, list[int]] = {s: [] for s in shares}
    later = [(0, -(-h // n), s) for s, n in shares.items()]  # release, deadline, source
    heapq.heapify(later)
    ready: list[tuple[int, str]] = []
    t = -1
    while (t := t + 1) < h:
        while later and later[0][0] <= t:
            _, due, s = heapq.heappop(later)
            heapq.heappush(ready, (due, s))
        due, s = heapq.heappop(ready)
        assert t < due
        slots[s].append(t)
        i = len(slots[s])
        if blocks and i == blocks[s]:
            break
        if i < shares[s]:
            heapq.heappush(later, (i * h // shares[s], -(-(i + 1) * h // shares[s]), s))
    return slots


def phases(blocks: dict[str, int], shares: dict[str, int], period: int = 1000) -> list[dict]:
    """Phases of the whole stream, for each source in each: phase, first block, end block, first slot, share, period and pattern.

    pattern, release and deadline hold for the first `share` blocks of the phase; the next ones are `period` slots later. A
    phase whose shares sum to more than `period` is laid out to its end: its share is all its blocks. A phase ends with the
    last block of the first source that runs out, so there are as many phases as sources at most.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    start, out, phase = 0, [], 0
    while left:
        own = {s: shares[s] for s in left}
        h = sum(own.values())
        repeated = h <= period
        slots = one_period(own, None if repeated else left)
        if repeated:
            length = min((n - 1) // own[s] * h + slots[s][(n - 1) % own[s]] + 1 for s, n in left.items())
        else:
            length = sum(map(len, slots.values()))
        for s in list(left):
            n = length // h * own[s] + sum(t < length % h for t in slots[s]) if repeated else len(slots[s])
            some = range(len(slots[s]))
            window = {"release": [i * h // own[s] for i in some], "deadline": [min(-(-(i + 1) * h // own[s]), 1 << 62) for i in some]}
            if n:
                out.append({"source": s, "phase": phase, "first": done[s], "end": done[s] + n, "slot": start, "share": max(1, len(slots[s])), "period": h if repeated else length, "pattern": slots[s], **window})
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start, phase = start + length, phase + 1
    return out


def _local(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(kinds), kinds.values())], names=list(kinds)))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, block_size: int = 1 << 16, period: int = 1000, most_blocks: int = 1_000_000) -> DataFrame:
    """`docs` with block, last_block, release, deadline, slot and nth: ordered by (slot, nth) they are the mixed stream.

    weights: target weight by source (a null source is the key ''); those without one, or all, weigh as much as they
    hold (their share of all). Decimal weights are exact. period: the longest period that is laid out once and repeated.
    size: what blocks measure, by default characters of `text`; null counts as 0. block_size: the least size of a block; with
    more than `most_blocks` of them, blocks are as large as makes that many. A document stands in the block in which it begins
    and goes on to last_block: a long one fills the slots of all blocks between, and no slot is without text. nth counts within
    a block. Documents come in the order of a hash of their id, ties in that of their text and size; rows alike in all three
    may change places. Columns of the six names are replaced. No documents: no rows.
    """
    spark = session_of(docs)
    size = F.coalesce(F.char_length("text") if size is None else size, F.lit(0)).cast("long")
    others = [c for c in docs.columns if c not in ("block", "last_block", "release", "deadline", "slot", "nth")]
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")  # 60 bits
    parts = max(64, 4 * shuffle_partitions(spark))
    ranged = F.floor(hashed / F.lit(float((1 << 60) // parts + 1))).cast("int")  # an even share of a source's hashes
    tie = F.xxhash64(*(c for c in ("text",) if c in docs.columns), F.col("_size"))
    rows = docs.select(*others).withColumns({"_source": source, "_hash": hashed, "_part": ranged, "_size": size + 1}).withColumn("_tie", tie)
    sums = cut(rows.groupBy("_source", "_part").agg(F.sum("_size").alias("_sum")))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_source", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    totals = {r["_source"]: r["n"] for r in sums.groupBy("_source").agg(F.sum("_sum").alias("n")).collect()}
    block_size = max(block_size, -(-sum(totals.values()) // most_blocks))
    blocks = {s: -(-n // block_size) for s, n in totals.items()}
    wanted = {s: Fraction(str((weights or {}).get(s, Fraction(totals[s], sum(totals.values()))))) for s in totals}
    if any(w <= 0 for w in wanted.values()):
        raise ValueError("weights must be over 0")
    plan = phases(blocks, exact_shares(wanted), period=period) if blocks else []
    long = pa.int64()
    steps = [(p["source"], p["phase"], p["first"], p["end"], p["slot"], p["share"], p["period"]) for p in plan]
    steps = _local(spark, steps, dict(_source=pa.string(), _phase=long, _first=long, _end=long, _begin=long, _share=long, _period=long))
    cells = [(p["source"], p["phase"], k, *x) for p in plan for k, x in enumerate(zip(p["pattern"], p["release"], p["deadline"]))]
    cells = _local(spark, cells, dict(_source=pa.string(), _phase=long, _k=long, _at=long, _release=long, _deadline=long))
    within = Window.partitionBy("_source", "_part").orderBy("_hash", F.col(id_col), "_tie")
    placed = rows.withColumn("_own", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(bases, ["_source", "_part"])
    last = F.col("_base") + F.col("_own")
    placed = placed.withColumns({"block": F.floor((last - F.col("_size")) / F.lit(block_size)).cast("long"), "last_block": F.floor((last - 1) / F.lit(block_size)).cast("long"), "nth": (last - F.col("_size")).cast("long")})
    in_phase = (F.col("block") >= F.col("_first")) & (F.col("block") < F.col("_end"))
    placed = placed.alias("r").join(steps.alias("s"), (F.col("r._source") == F.col("s._source")) & in_phase).drop(F.col("s._source"))
    # blocks k, k + share, k + 2 * share ... of a phase stand at the same place of the period
    of_phase = F.col("block") - F.col("_first")
    placed = placed.withColumns({"_k": of_phase % F.col("_share"), "_turn": F.floor(of_phase / F.col("_share")).cast("long")})
    placed = placed.withColumn("_begin", F.col("_begin") + F.col("_turn") * F.col("_period"))
    placed = placed.join(cells, ["_source", "_phase", "_k"])
    begin = F.col("_begin")
    return placed.select(*others, "block", "last_block", (begin + F.col("_release")).alias("release"), (begin + F.col("_deadline")).alias("deadline"), (begin + F.col("_at")).alias("slot"), "nth")
