"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names in spark.checkpoint.dir; one of our own only in local runs where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="proselake-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the files, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(session_of(df))
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write `df` to the shared checkpoint folder as a table bucketed by `key`, whose rows needn't be shuffled to meet others by it.

    Like a checkpoint's files, the table's stay until the cluster clears the folder.
    """
    spark = session_of(df)
    ensure_checkpoint_dir(spark)
    name = f"proselake_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of `n` nodes over the undirected edges (u, v), vectorised."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        nxt = label.copy()
        np.minimum.at(nxt, label[u], low)
        np.minimum.at(nxt, label[v], low)
        nxt = nxt[nxt]
        while True:
            jumped = nxt[nxt]
            if np.array_equal(jumped, nxt):
                break
            nxt = jumped
        if np.array_equal(nxt, label):
            return label
        label = nxt


def valid_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is neither null, empty nor zero and holds only finite components."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
