"""Language identification (operator 4): string-kernel ridge regression with Nyström landmarks.

A text is the set of its byte n-grams of 1 to 3 bytes (blended spectrum, presence only) after case folding, with runs of
everything that is no letter turned into one space. The kernel of two texts is the number of n-grams they share over the
geometric mean of their numbers. n-grams are kept in a table of 2**16 places; sharing a place counts as sharing.

The kernel against the landmarks is linear in a text's presence vector, so that the product with the regression's
coefficients is folded into one table of weights by n-gram, once; a batch of texts is then scored by one sparse product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES = 1 << 16
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def ngram_places(text: str) -> np.ndarray:
    """Sorted distinct places of the n-grams of the whole text."""
    raw = b" ".join((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_FOLD).split())
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    seen = np.zeros(PLACES, bool)
    seen[b] = True
    seen[(two * np.uint32(40503) + np.uint32(977)) >> 3 & np.uint32(PLACES - 1)] = True
    seen[three * np.uint32(2654435761) >> np.uint32(16)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # places x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        places = [ngram_places(t) for t in texts]
        sizes = np.array([len(p) for p in places])
        sums = np.add.reduceat(self.weights[np.concatenate(places)], np.concatenate(([0], sizes.cumsum()[:-1])), axis=0)
        return sums / np.sqrt(sizes)[:, None]


def fit(places: list[np.ndarray], labels: list[str], landmarks: int = 256, ridge: float = 1e-3) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features; classes weigh alike. Landmarks take turns among classes."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    order = np.argsort(y, kind="stable")
    turn = np.empty(len(y), np.int64)
    for c in range(len(languages)):
        own = order[y[order] == c]
        turn[own] = np.arange(len(own))
    z = np.argsort(turn * len(languages) + y, kind="stable")[:landmarks]

    def presence(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), PLACES), np.float32)
        for k, p in enumerate(rows):
            x[k, p] = 1 / np.sqrt(len(p))
        return x

    marks = presence([places[k] for k in z])
    k_nm = np.concatenate([presence(places[k : k + 64]) @ marks.T for k in range(0, len(places), 64)]).astype(np.float64)
    k_mm = k_nm[z]
    val, vec = np.linalg.eigh(k_mm)
    good = val > 1e-6 * val.max()
    root = vec[:, good] / np.sqrt(val[good])
    phi = k_nm @ root
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages))))[y]
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    centre = (target * weight[:, None]).sum(0) / weight.sum()
    a = phi.T @ (phi * weight[:, None]) + ridge * len(y) * np.eye(phi.shape[1])
    w = np.linalg.solve(a, phi.T @ ((target - centre) * weight[:, None]))
    return Model(languages, (marks.T @ (root @ w)).astype(np.float32))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 2000, landmarks: int = 256) -> Model | None:
    """Fit on a bounded sample: `max_rows` labelled rows in all, dealt evenly to the languages, smallest id hashes first.

    Rows with a null text or label, texts without a letter and held-out rows teach nothing. None if no row is left.
    """
    told = F.coalesce(F.regexp_like(F.col(text_col).cast("string"), F.lit(r"\p{L}")), F.lit(False))  # rows that teach nothing take no place
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & told)
    keys = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("long").alias("id"))
    counts = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each language
    if not counts:
        return None
    # hashes under a share of their range that holds twice as many rows as wanted; the ranks below see no more than those
    wanted = max(1, max_rows // len(counts))
    shares = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, (2 * wanted + 50) / n)))
    place = F.shiftrightunsigned(F.xxhash64("id"), 1) / F.lit(float(1 << 63))
    near = keys.where(place <= shares[F.col("lang")])
    by_hash = Window.partitionBy("lang").orderBy(place, "id")
    chosen = near.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= wanted).select(F.col("id").alias("chosen")).distinct()
    texts = usable.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, ngram_places(t.as_py()).astype("<u2").tobytes()) for lang, t in zip(b.column(0).to_pylist(), b.column(1)) if LETTER.search(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "places"])

    # at most max_rows ids, or one a language
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("chosen"), "left_semi").select("lang", "text").mapInArrow(run, "lang string, places binary").collect()
    if not sample:
        return None
    sample = sorted((r.lang, bytes(r.places)) for r in sample)
    return fit([np.frombuffer(p, "<u2").astype(np.int64) for _, p in sample], [lang for lang, _ in sample], landmarks)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", batch: int = 256) -> DataFrame:
    """`docs` with lang_pred and lang_score (0 to 1) in the place of columns of those names.

    `und` with score 0 for a text that is null or has no letter, or if there is no model. Rows, repeated ones too, stay.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    at = others.index(text_col)
    schema = docs.select(*others).withColumn("lang_pred", F.lit("")).withColumn("lang_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred = np.full(b.num_rows, UNKNOWN, object)
            score = np.zeros(b.num_rows)
            for start in range(0, b.num_rows if model else 0, batch):
                rows, texts = [], []
                for k, t in enumerate(b.column(at).slice(start, batch)):
                    t = t.as_py()
                    if t is not None and LETTER.search(t):
                        rows.append(start + k)
                        texts.append(t)
                if rows:
                    f = model.scores(texts)
                    e = np.exp(4 * (f - f.max(1, keepdims=True)))
                    p = e / e.sum(1, keepdims=True)
                    best = p.argmax(1)
                    pred[rows] = np.array(model.languages, object)[best]
                    score[rows] = p[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*others, "lang_pred", "lang_score"])

    return docs.select(*others).mapInArrow(run, schema)
