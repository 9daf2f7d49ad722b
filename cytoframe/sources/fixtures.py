"""Domain tables derived from the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.functions.columns import rounded
from cytoframe.functions.lineage import cut
from cytoframe.functions.ordered import with_running

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
MARKER = "Brand#2/LARGE"
SECOND_MARKER = "Brand#1/SMALL"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gene_name() -> Column:
    return F.concat_ws("/", "p_brand", "p_type")


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expr(gene, cell_id, value): quantity of each part kind per customer.

    Quantities are first added up per (order, part kind): the entry count shrinks before
    the wider shuffle on the final key.
    """
    genes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), gene_name().alias("gene"))
    owners = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cell_id")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return (
        lines.join(genes, "l_partkey")
        .join(owners, "l_orderkey")
        .groupBy("gene", "cell_id")
        .agg(F.sum("l_quantity").alias("value"))
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(cell_id, cluster, condition, disease): one row per customer."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(nation, "c_nationkey")
        .join(region, "n_regionkey")
        .select(
            F.col("c_custkey").alias("cell_id"),
            F.col("c_nationkey").alias("cluster"),
            F.col("c_mktsegment").alias("condition"),
            F.col("r_name").alias("disease"),
        )
    )


def mapped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per order, with three label levels, their scores and a mapping score."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cluster"), "c_acctbal"
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster"), "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
        .join(customer, "o_custkey")
        .join(nation, "cluster")
        .join(region, "n_regionkey")
        .select(
            F.col("o_orderkey").alias("cell_id"),
            "cluster",
            F.col("o_orderstatus").alias("label_l1"),
            F.col("o_orderpriority").alias("label_l2"),
            F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("label_l3"),
            ((cents % 100) / 100.0).alias("score_l1"),
            ((cents % 1000) / 1000.0).alias("score_l2"),
            ((cents % 10000) / 10000.0).alias("score_l3"),
            rounded((F.col("c_acctbal") + 1000) / 11000, 4).alias("mapping_score"),
            F.col("n_name").alias("sample"),
            F.col("r_name").alias("grp"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, v, role, label_l1..l3, x, y): one fifth of the vectors play the query."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        v.alias("v"),
        F.when(F.col("vec_id") % 5 == 0, "query").otherwise("reference").alias("role"),
        F.concat(F.lit("A"), (F.col("label") % 2).cast("string")).alias("label_l1"),
        F.concat(F.lit("B"), (F.col("label") % 5).cast("string")).alias("label_l2"),
        F.concat(F.lit("C"), F.col("label").cast("string")).alias("label_l3"),
        F.element_at(v, 1).alias("x"),
        F.element_at(v, 2).alias("y"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("role") == "query").select(F.col("cell_id").alias("query_id"), "v")


def reference_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("role") == "reference").select(F.col("cell_id").alias("ref_id"), "v")


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_sets(collection, set_name, gene): genes by brand and genes by type; stored, as one query reads them many times."""
    kinds = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    both = F.explode(
        F.array(
            F.struct(F.lit("BRAND").alias("collection"), F.concat(F.lit("HALLMARK_"), F.col("p_brand")).alias("set_name")),
            F.struct(F.lit("TYPE").alias("collection"), F.concat(F.lit("HALLMARK_"), F.col("p_type")).alias("set_name")),
        )
    )
    return cut(kinds.select(both.alias("s"), gene_name().alias("gene")).select("s.collection", "s.set_name", "gene"))


def gene_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ranks(dataset, gene, stat): mean value per gene, over all cells and per condition."""
    entries = expr(spark, sf_dir).join(cells(spark, sf_dir).select("cell_id", "condition"), "cell_id")
    # entries are added up once, by condition; all cells are the sum of the conditions
    sums = entries.groupBy("condition", "gene").agg(F.sum("value").alias("_sum"), F.count("value").alias("_n"))
    both = F.explode(F.array(F.lit("ALL"), F.col("condition"))).alias("dataset")
    totals = sums.select(both, "gene", "_sum", "_n").groupBy("dataset", "gene").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    return totals.select("dataset", "gene", F.round(F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")), 9).alias("stat"))


def diffreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diffreg(dataset, gene, distance, fc, p_value), one row per part; genes repeat."""
    part = table(spark, sf_dir, "part").select(
        F.lit("parts").alias("dataset"),
        F.col("p_name").alias("gene"),
        (F.col("p_retailprice") / 1000).alias("distance"),
        F.col("p_partkey"),
    )
    mean_square = part.select(F.avg(F.col("distance") * F.col("distance"))).scalar()
    total = part.select(F.count(F.lit(1))).scalar()
    ranked = with_running(
        part, ["dataset"], "distance", ties=["p_partkey"], sums={"_rank": F.lit(1)}, descending=True
    )
    return ranked.select(
        "dataset",
        "gene",
        "distance",
        (F.col("distance") * F.col("distance") / mean_square).alias("fc"),
        (F.col("_rank") / (total + 1)).alias("p_value"),
    )
