"""Every query of the catalog against its SQL in DuckDB on the smallest tables; those without SQL must give rows."""

import math
import os

import duckdb
import pytest

from proselake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == want


def beside(tmp_path, name, arrow):
    """A folder with the table alone, and DuckDB over it."""
    import pyarrow.parquet as pq

    pq.write_table(arrow, str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return con


def test_lexicon_hits_side_by_side(spark, tmp_path):
    import pyarrow as pa

    texts = ["of the of the lamp", "OF THE, of the", "of the  of the of\tthe de la de la", "xof the of thex", "of\u00a0the de\nla\n", "cafe\u0301 of the e\u0301of the", "of the\n", "", "...", None]
    con = beside(tmp_path, "documents", pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())}))
    want = con.execute(catalog.oracle_sql()["lexicon_density"]).fetchall()
    assert sorted(want) == sorted((r["doc_id"], r["density"]) for r in catalog.queries()["lexicon_density"](spark, str(tmp_path)).collect())
    turns = [(k, t) for k, t in enumerate(texts) if t]
    con = beside(tmp_path, "conversations", pa.table({"conv_id": [k for k, _ in turns], "turn": [0 for _ in turns], "role": ["user" for _ in turns], "text": [t for _, t in turns]}))
    for name in ("narration_score", "coverage_gate"):
        assert [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()] == con.execute(catalog.oracle_sql()[name]).fetchall()


def test_marks_of_scores_between_two_decimals(spark, tmp_path):
    """Sentences of 448, 2,496 and 12,736 characters have scores of 0.875, 0.975 and 0.995, of which only the first is a tie."""
    import pyarrow as pa

    from proselake.functions import text as T

    texts = ["x" * (n - 1) + "." for n in (448, 2496, 12736)]
    con = beside(tmp_path, "documents", pa.table({"doc_id": range(4), "text": pa.array([*texts, " ".join(texts)])}))
    want = con.execute(catalog.oracle_sql()["marked_pages"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in catalog.queries()["marked_pages"](spark, str(tmp_path)).collect())
    values = [k / 1000 for k in range(-20, 2006)] + [k / 8 for k in range(40)] + [1e-9, 0.005, 0.015, 1.005, 99.995, 123456.785, 0.9999999999999999]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", T.two_decimals("x").alias("s")).collect()
    assert [(r["x"], r["s"]) for r in rows if r["s"] != f"{r['x']:.2f}"] == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).limit(1).count() == 1
