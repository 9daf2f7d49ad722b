"""Table schemas and text sources / sinks. Between stages tables are plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("cell_id", "cluster", "label_l1", "label_l2", "label_l3")]
    + [T.StructField(name, T.DoubleType()) for name in ("score_l1", "score_l2", "score_l3", "mapping_score")]
    + [T.StructField(name, T.StringType()) for name in ("sample", "grp", "dataset")]
)
EXPR = T.StructType(
    [
        T.StructField("gene", T.StringType()),
        T.StructField("cell_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
LAYOUT = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
GENE_SETS = T.StructType([T.StructField(name, T.StringType()) for name in ("collection", "set_name", "gene")])
DIFFREG = T.StructType(
    [T.StructField("dataset", T.StringType()), T.StructField("gene", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in ("distance", "z", "fc", "p_value", "p_adj", "log2fc")]
)


#: Values of a wide matrix, zeros too, that one file holds.
FILE_VALUES = 50_000_000


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-delimited table with a header; ``NA`` is missing, a NaN is missing too. A header unlike the schema is an error."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="NA", quote='"', escape='"', enforceSchema=False)
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles}) if doubles else df


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True, nullValue="NA", quote='"', escape='"')


def write_wide_matrix(expr: DataFrame, path: str, cells_per_file: int = 10_000, mode: str = "errorifexists") -> None:
    """Write (gene, cell_id, value) as gene rows x cell columns.

    Cells are dealt into shards of about ``cells_per_file`` columns, one folder and one
    header each, so the length of a line never grows with the study. A shard is one file for every ``FILE_VALUES`` values or
    so; ``expr`` is read several times and best stored.
    """
    many = F.greatest(F.ceil(F.approx_count_distinct("cell_id") / cells_per_file), F.lit(1)).alias("shards")
    files = F.greatest(F.ceil(F.approx_count_distinct("gene") * cells_per_file / FILE_VALUES), F.lit(1)).alias("files")
    sizes = expr.select(F.struct(many, files)).scalar()
    shards, piece = sizes["shards"], F.pmod(F.xxhash64("value"), sizes["files"])
    placed = expr.withColumn("shard", F.pmod(F.xxhash64(F.col("cell_id").cast("string")), shards).cast("int"))
    columns = placed.groupBy("shard").agg(F.array_sort(F.collect_set(F.col("cell_id").cast("string"))).alias("cells"))
    rows = placed.groupBy("shard", "gene").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("cell_id").cast("string"), F.col("value").cast("string")))
        ).alias("filled")
    )
    body = rows.join(columns, "shard").select(
        "shard",
        F.concat_ws(
            "\t",
            F.col("gene"),
            F.array_join(F.transform("cells", lambda c: F.coalesce(F.element_at("filled", c), F.lit("0"))), "\t"),
        ).alias("value"),
    )
    header = columns.select("shard", F.concat_ws("\t", F.lit("gene"), F.array_join("cells", "\t")).alias("value"))
    lines = header.unionByName(body).withColumn("_file", piece)
    lines.repartition("shard", "_file").drop("_file").write.mode(mode).partitionBy("shard").text(path)


def read_wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Read gene rows x cell columns back as sparse (gene, cell_id, value).

    Cell names stay data: the header is exploded to (position, cell_id) and joined, so the
    plan has three columns however many cells the file names. Zeros are dropped before
    the join.
    """
    lines = spark.read.text(path)
    origin = "shard" if "shard" in lines.columns else "origin"
    if origin == "origin":
        lines = lines.select("value", F.col("_metadata.file_path").alias("origin"))
    parts = lines.select(origin, F.split("value", "\t").alias("fields"))
    is_header = F.element_at("fields", 1) == "gene"
    header = parts.where(is_header).select(origin, F.posexplode("fields").alias("pos", "cell_id")).where("pos > 0")
    entries = (
        parts.where(~is_header)
        .select(origin, F.element_at("fields", 1).alias("gene"), F.posexplode("fields").alias("pos", "text"))
        .where((F.col("pos") > 0) & (F.col("text") != "0"))
        .withColumn("value", F.col("text").cast("double"))
        .where(F.col("value") != 0)
    )
    return entries.join(header, [origin, "pos"]).select("gene", "cell_id", "value")


def read_gene_sets(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """GMT text: set name, description, then genes, tab-separated."""
    fields = F.split("value", "\t")
    return spark.read.text(path).select(
        F.lit(collection).alias("collection"),
        F.element_at(fields, 1).alias("set_name"),
        F.explode(F.slice(fields, F.lit(3), F.greatest(F.size(fields) - 2, F.lit(0)))).alias("gene"),
    )
