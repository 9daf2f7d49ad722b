"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.functions.lineage import cut
from cytoframe.llm import mixing, ngram_join, packing, pii, toxicity
from cytoframe.llm.columns import fresh, shielded
from cytoframe.llm.queries import learned_toxicity, vocabulary, word_count

REJECT = 0.7
NEAR_WIDTH = 5
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones, scores below ``REJECT``.

    A null or empty text is scored as what the network gives no evidence; repeated rows go or stay together; an empty table
    gives none. Columns of any name stay as they are.
    """
    learned = learned_toxicity(spark, sf_dir)

    def clean(table: DataFrame) -> DataFrame:
        return toxicity.score_toxicity(table, learned).where(F.col("toxicity.score") < REJECT)

    return shielded(docs, "toxicity", clean)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (``NEAR_WIDTH``-word shingles alike by ``NEAR_PERCENT`` or more) one row.

    It is a row with the smallest id, if any has one, and among these that of the smallest digest of all
    columns. A group of rows that repeat an id or lack one leaves one row as any other, and of rows equal in all
    columns one stays. Documents without words form no groups: all of their rows stay.
    """
    row = fresh(docs, "_row")
    named = docs.withColumn(row, F.md5(F.to_json(F.struct(*docs.columns))))
    identity = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("digest"))
    linked = ngram_join.link_documents(named.select(identity.alias("doc_id"), "text"), NEAR_WIDTH, NEAR_PERCENT)
    groups = cut(linked.where(F.col("n_shingles") > 0).select(F.col("doc_id.digest").alias(row), (F.col("component_id") == F.col("doc_id")).alias("first")))
    dropped = groups.where(~F.col("first")).select(row).distinct()
    repeated = cut(groups.where("first").groupBy(row).count().where(F.col("count") > 1).select(row))
    once = named.join(dropped.unionByName(repeated), row, "left_anti").select(*docs.columns)
    return once.unionByName(named.join(repeated, row, "left_semi").select(*docs.columns).distinct())


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with kinds in place of personal data; ``n_chars`` follows.

    A null text stays null, and so does its ``n_chars``; repeated rows are redacted alike; an empty table gives none.
    Other columns of any name stay as they are.
    """

    def redacted(table: DataFrame) -> DataFrame:
        clean = pii.redact(pii.find_pii(table, keep_text=True))
        return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))

    return shielded(docs, "pii", redacted)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its coin say.

    Documents without a source are a source of their own; a null or empty text has no words and is drawn by the same rule; rows
    that share an id share the coin; an empty table gives none. Columns of any name stay as they are.
    """

    def emitted(table: DataFrame) -> DataFrame:
        return mixing.emit(mixing.mix(table, F.col("source"), word_count(F.col("text")), F.col("doc_id")))

    return shielded(docs, "mixing", emitted)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1024 tokens.

    A null or empty text is its end token; rows that repeat are packed each; an empty table gives none. Only the pieces'
    own columns come out.
    """
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The network and the token vocabulary can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
