from cytoframe.operators import network
from cytoframe.plans import studies


def test_only_sampled_cells_are_normalised(spark):
    rows = [(f"g{g}", c, float(g + c + 1)) for g in range(3) for c in range(50)] + [("g0", None, 1.0)]
    expr = spark.createDataFrame(rows, "gene string, cell_id long, value double")
    samples = spark.createDataFrame([(1, 4, 0), (1, 9, 1), (2, 4, 0), (2, None, 1)], "net int, cell_id long, pos int")
    got = studies._sampled(expr, samples)
    whole = network.cpm_normalize(expr).where("cell_id IN (4, 9)")
    assert sorted(map(tuple, got.select("gene", "cell_id", "value").collect())) == sorted(map(tuple, whole.select("gene", "cell_id", "value").collect()))
