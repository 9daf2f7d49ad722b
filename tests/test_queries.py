"""Every query against its SQL counterpart, plus the driver's contract."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from cytoframe.sources import fixtures as fx

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, isinstance(v, str), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in row) for row in df.select(*columns).collect()]
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"knockout_study", "depletion_study_aligned"}))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_collapse_covers_every_dataset(spark, sf_dir):
    ranked = {r[0] for r in fx.gene_ranks(spark, sf_dir).select("dataset").distinct().collect()}
    got = QUERIES["collapse_sets"](spark, sf_dir).groupBy("dataset").count().collect()
    assert len(ranked) > 1 and {r["dataset"] for r in got} == ranked


@pytest.mark.parametrize("name", ["null_comparison", "depletion_contrasts"])
def test_a_tenth_of_all_edges_is_compared(spark, duck, sf_dir, name):
    genes = fx.expr(spark, sf_dir).select("gene").distinct().count()
    many = duck.execute(f"SELECT net, sum(edges) / 2 FROM ({ORACLE[name]}) GROUP BY 1").fetchall()
    assert many and all(n >= 0.09 * genes * (genes - 1) / 2 for _, n in many)
    got = {r[0]: r[1] / 2 for r in QUERIES[name](spark, sf_dir).groupBy("net").sum("edges").collect()}
    assert got == dict(many)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["composition_ttest", "gene_correlation", "score_box_stats"])
def test_partition_count_does_not_matter(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for partitions in ("1", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            df = QUERIES[name](spark, sf_dir)
            seen.append(ordered([tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
