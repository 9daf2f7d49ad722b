import glob
import os

from cytoframe.sources import tables


def test_a_small_shard_is_one_file_and_reads_back(spark, tmp_path):
    rows = [(f"g{i:02d}", c, float(i + c)) for i in range(1, 30) for c in range(40) if (i * c) % 3]
    expr = spark.createDataFrame(rows, "gene string, cell_id long, value double")
    path, setting = str(tmp_path / "wide"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        tables.write_wide_matrix(expr, path, cells_per_file=10)
        back = tables.read_wide_matrix(spark, path).selectExpr("gene", "cast(cell_id as long) cell_id", "value").collect()
    finally:
        spark.conf.set(setting, before)
    assert sorted(tuple(r) for r in back) == sorted(rows)
    shards = glob.glob(f"{path}/shard=*")
    assert len(shards) > 1 and all(len(glob.glob(os.path.join(s, "*.txt"))) == 1 for s in shards)
