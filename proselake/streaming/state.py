"""What streams with keyed state share: the store that they need, and keys that pandas leaves as they are."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def named(key: str) -> Column:
    """A key as text that is never null: among null keys, pandas would turn numbers into floats."""
    return F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))


def key_of(name: str, kind: DataType) -> Column:
    """The key that named() made the text of."""
    return F.when(F.col(name) != "", F.substring(name, 2, (1 << 31) - 1)).cast(kind)


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which keyed state with timers needs; it takes disk as it needs it."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
