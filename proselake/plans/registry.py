"""Queries by name, with the SQL that gives the same rows in DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One whose files make fewer tasks than there are cores is dealt out first; larger tables are never moved."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---- fragments of SQL ----


def words(items) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def strip_(x: str) -> str:
    return rf"regexp_replace({x},'^\s+|\s+$','','g')"


def key_(x: str) -> str:
    return "lower(" + strip_(rf"regexp_replace({x},'\s+',' ','g')") + ")"


def paragraphs_(x: str) -> str:
    return rf"list_filter(string_split_regex({strip_(f'coalesce({x},chr(32))')},'\n\s*\n'), lambda p: regexp_matches(p,'\S'))"


def pieces_(x: str) -> str:
    cut = rf"""string_split(regexp_replace(p,'([.!?…])["”’''*_)\]]*\s+','\1'||chr(1),'g'),chr(1))"""
    return f"list_filter(list_transform(flatten(list_transform({x}, lambda p: {cut})), lambda s: {strip_('s')}), lambda s: s <> '')"


def sentences_(x: str) -> str:
    return pieces_(paragraphs_(x))


def narration_(x: str) -> str:
    told = strip_(r"""regexp_replace(regexp_replace(p,'["“‘][^"”’]*(?:["”’]|\z)|[”’]',' ','g'),'\s+',' ','g')""")
    return pieces_(f"list_filter(list_transform({paragraphs_(x)}, lambda p: {told}), lambda p: p <> '')")


def tokens_(x: str, token: str = "[a-z0-9'']+") -> str:
    return f"regexp_extract_all(lower({x}),'{token}')"


def grams_(t: str, n: int) -> str:
    return f"list_transform(range(1, greatest(1, len({t})-{n}+2)), lambda i: array_to_string({t}[i:i+{n}-1],' '))"


def exploded_(unit: str, expr: str, source: str) -> str:
    """(unit, i, sentence), i from 0."""
    return f"SELECT {unit}, unnest(ss) AS sentence, generate_subscripts(ss,1)-1 AS i FROM (SELECT {unit}, {expr} AS ss FROM {source})"
