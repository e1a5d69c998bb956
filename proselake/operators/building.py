"""Whole flows: the labelled data set and its splits, pairs from rewrites, question scenarios, rollout summaries and gates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import dataset as D
from proselake.operators import detectors

#: Held-out shares of groups, by salt.
HELD_OUT = {"val": 0.15, "test": 0.5}


def grouped(rows: DataFrame, prefix: str, source: str | None = None, label: int | None = None, real: bool | None = None, keep_group: bool = False) -> DataFrame:
    """Rows in the labelled form: groups by the text's hash (or an own group where it is kept), fixed source, label or realness."""
    have = set(rows.columns)
    own = F.col("group_id") if keep_group and "group_id" in have else F.lit(None)
    said = {"source": source, "label": label, "is_real": real}
    cols = {c: F.lit(v) if v is not None else F.col(c) if c in have else F.lit(d) for (c, v), d in zip(said.items(), (prefix, 0, True))}
    more = [F.col("idx")] if "idx" in have else []
    return rows.select("text", cols["label"].cast("int").alias("label"), cols["source"].alias("source"), F.coalesce(own, D.text_group(prefix, "text")).alias("group_id"), cols["is_real"].alias("is_real"), *more)


def of_genre(rows: DataFrame, genres=("plain", "technical")) -> DataFrame:
    return rows.where(F.col("genre").isin(*genres))


def splits(pool: DataFrame, human: DataFrame) -> DataFrame:
    """Deduplicated rows with `split`: train and val come from the pool only, calibration and test from human rows only.

    pool and human have prio and idx (see dataset.pool). Human rows whose key the pool holds are leaks and go.
    """
    p = D.first_of_each(pool).drop("key")
    h = D.without_leaks(D.first_of_each(human).drop("key"), p)
    side = lambda salt, yes, no: F.when(D.held_out(F.col("group_id"), HELD_OUT[salt], salt), yes).otherwise(no)
    return p.withColumn("split", side("val", "val", "train")).unionByName(h.withColumn("split", side("test", "test", "calibration")))


@dataclass
class Axis:
    """An axis of style: prompts by direction (system, user, temperature) and how a rewrite becomes a pair."""

    name: str
    prompts: dict[str, tuple[str, str, float]]
    bands: dict[str, int] = field(default_factory=dict)
    accepts: Callable[[Column, Column], Column] | None = None

    def improves(self) -> bool:
        return "improve" in self.prompts

    def messages(self, direction: str, seed: Column, note: Column | None = None) -> Column:
        """The prompt of a direction as chat messages; {orig} and {desc} are filled in."""
        system, user, _ = self.prompts[direction]
        body = F.replace(F.replace(F.lit(user), F.lit("{desc}"), F.lit("") if note is None else note), F.lit("{orig}"), seed)
        return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))

    def pairs(self, rewrites: DataFrame) -> DataFrame:
        """Pairs of accepted rewrites (source, seed, direction, made): the seed is the real pole, neg when it was made worse."""
        good = D.clean_rewrite(F.col("made"), F.col("seed")) if self.accepts is None else F.when(self.accepts(F.col("seed"), F.col("made")), F.col("made"))
        worse = F.col("direction") == "worsen"
        r = rewrites.withColumn("_good", good).where("_good IS NOT NULL")
        band = D.band("seed", self.bands) if self.bands else F.lit(None).cast("string")
        return r.select(
            F.when(worse, F.col("seed")).otherwise(F.col("_good")).alias("neg"), F.when(worse, F.col("_good")).otherwise(F.col("seed")).alias("pos"), D.pair_group("seed").alias("group_id"), "source",
            F.when(worse, "neg").otherwise("pos").alias("real"), F.when(worse, band).otherwise("better").alias("intensity"),
        )


AXES: dict[str, Axis] = {}


def register_axis(axis: Axis) -> Axis:
    AXES[axis.name] = axis
    return axis


def weights(text: str | None, axes: list[str]) -> dict[str, float]:
    """Weights by axis from a comma list; 1 each without one."""
    if not text:
        return dict.fromkeys(axes, 1.0)
    found = [float(x) for x in text.split(",")]
    if len(found) != len(axes):
        raise ValueError(f"{len(found)} weights for {len(axes)} axes")
    return dict(zip(axes, found))


def primer(examples: DataFrame, order: str) -> DataFrame:
    """One row: solved examples as one text, in order; empty without any."""
    block = F.concat(T.strip("passage"), F.lit("\n"), T.strip("question"), F.lit("\nAnswer: "), F.col("answer"))
    rows = examples.agg(F.array_sort(F.collect_list(F.struct(order, block.alias("b")))).alias("r"))
    joined = F.array_join(F.transform("r", lambda r: r["b"]), "\n\n")
    return rows.select(F.when(F.size("r") > 0, F.concat(F.lit("Solved examples:\n\n"), joined, F.lit("\n\nNow answer this question:\n"))).otherwise("").alias("primer"))


def question_scenarios(rows: DataFrame, system: str, n: int = 100, shots: int = 0, order: str = "row") -> DataFrame:
    """Single-word questions in turn from each task as scenarios: id, system, user_turns, checks. `shots` first rows are the primer.

    rows: (task, row, passage, question, answer).
    """
    from proselake.operators.grading import single_word

    singles = rows.where(single_word(F.col("answer")))
    first = singles.orderBy(order).limit(shots)
    rest = singles.join(first.select(F.col(order).alias("_o")), F.col(order) == F.col("_o"), "left_anti")
    turns = D.round_robin(rest, "task", order, n)
    place = F.row_number().over(Window.orderBy("depth", "task")) - 1  # n rows at most
    user = F.concat("primer", T.strip("passage"), F.lit("\n"), T.strip("question"))
    q = turns.withColumn("k", place).crossJoin(primer(first, order))  # one row
    check = F.struct(F.array(F.lower("answer")).alias("expect"), F.array().cast("array<string>").alias("reject"))
    return q.select(F.format_string("q_t%s_%d", F.col("task").cast("string"), "k").alias("id"), F.lit(system).alias("system"), F.array(user).alias("user_turns"), F.array(check).alias("checks"))


def rollout_summary(replies: DataFrame, keys: list[str], scorer: Callable[[Column], Column]) -> DataFrame:
    """(keys, score, wps, struct, opener, intra, sentences): means over the replies of a variant or scenario."""
    r = replies.withColumn("_id", F.monotonically_increasing_id())
    s = T.sentences("text")
    score = T.ratio(F.aggregate(F.transform(s, scorer), F.lit(0.0), lambda a, x: a + x), F.size(s))
    base = r.groupBy(*keys).agg(F.avg(score).alias("score"), F.avg(T.words_per_sentence("text")).alias("wps"), F.sum(F.size(s)).alias("sentences"))
    lines = r.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("l")).where(F.col("l").rlike(r"\S"))
    struct = lines.groupBy(*keys).agg(F.avg(F.col("l").rlike(r"^\s*(\*\*|#{1,3}\s|\d+\.\s|[-*•]\s)").cast("double")).alias("struct"))
    tagged = r.withColumn("_key", F.struct(*keys, "_id"))
    out = base.join(struct, keys, "left")
    for name, of in (("opener", detectors.opener_repeat), ("intra", detectors.intra_repeat)):
        mean = of(tagged, "_key").groupBy(*(F.col(f"_key.{k}").alias(k) for k in keys)).agg(F.avg("rate").alias(name))
        out = out.join(mean, keys, "left")
    return out.select(*keys, "score", "wps", "sentences", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("struct", "opener", "intra")))


def narration_score(replies: DataFrame, keys: list[str], scorer: Callable[[Column], Column], terms: list[str], apart: bool = False) -> DataFrame:
    """(keys, score, density): mean sentence score and lexicon density of the narration alone; 0 without narration."""
    s = T.narration_sentences("text")
    r = replies.select(*keys, F.transform(s, scorer).alias("p"), F.array_join(s, " ").alias("t"))
    c = r.groupBy(*keys).agg(F.sum(F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).alias("s"), F.sum(F.size("p")).alias("n"), F.sum(T.lexicon_hits("t", terms, apart)).alias("h"), F.sum(T.lexicon_words("t", apart)).alias("w"))
    return c.select(*keys, T.ratio(F.col("s"), F.col("n")).alias("score"), T.ratio(F.col("h"), F.col("w")).alias("density"))


def baseline_gate(curve: DataFrame, turn: str = "turn", value: str = "value", least: float = 0.2) -> DataFrame:
    """One row: late-weighted mean, means of the first and last two turns, and whether there is enough to reduce."""
    last = F.max(turn).over(Window.partitionBy())
    c = curve.withColumn("_last", last)
    w = F.col(turn) + 1
    g = c.agg((F.sum(F.col(value) * w) / F.sum(w)).alias("late_weighted"), (F.sum(F.when(F.col(turn) < 2, F.col(value))) / 2).alias("early"), (F.sum(F.when(F.col(turn) > F.col("_last") - 2, F.col(value))) / 2).alias("late"))
    return g.withColumn("passes", F.col("late_weighted") > least)


def coverage_gate(replies: DataFrame, first: list[str], second: list[str], least: float = 1.5, apart: bool = False) -> DataFrame:
    """One row: sentences a turn, densities of two lexicons, and whether there is narration and more of the first than of the second."""
    r = replies.agg(F.sum(F.size(T.sentences("text"))).alias("n"), F.count(F.lit(1)).alias("turns"), *(F.sum(T.lexicon_hits("text", x, apart)).alias(c) for c, x in (("a", first), ("b", second))), F.sum(T.lexicon_words("text", apart)).alias("w"))
    out = r.select(T.ratio(F.col("n"), F.col("turns")).alias("coverage"), T.ratio(F.col("a"), F.col("w")).alias("first"), T.ratio(F.col("b"), F.col("w")).alias("second"))
    return out.withColumn("passes", (F.col("coverage") >= least) & (F.col("first") > F.col("second")))


def layer_window(layers: Column, low: float = 0.15) -> Column:
    return F.struct(F.floor(layers * low).alias("low"), layers.alias("high"))


def joint_objective(axes: DataFrame, primary: str = "primary", penalty: str = "penalty", weight: str = "weight") -> Column:
    """Aggregate: weighted primaries of the axes plus all their penalties."""
    return F.sum(F.col(primary) * F.col(weight)) + F.sum(penalty)


def read_threshold(spark, *folders: str, default: float = 0.5) -> float:
    """The threshold of the first folder that holds a threshold.json."""
    from proselake.sources.readers import exists

    for folder in folders:
        path = f"{folder}/threshold.json"
        if exists(spark, path):
            found = spark.read.schema("threshold double").option("multiLine", "true").json(path).first()
            if found and found["threshold"] is not None:
                return found["threshold"]
    return default
