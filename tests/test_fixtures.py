from cytoframe.sources import fixtures as fx


def test_gene_sets_are_read_from_storage(spark, sf_dir):
    assert not [f for f in fx.gene_sets(spark, sf_dir).inputFiles() if f.endswith("/part.parquet")]
