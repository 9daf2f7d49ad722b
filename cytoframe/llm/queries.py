"""The queries of this subpackage on the test tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm import divergence, hashing, importance, language, mixing, ngram_join, ngram_lm, packing, pii, quality, repetition, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WORD = r"[^\x20\x09-\x0D]+"


def query(function):
    QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words outside white space, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of(column: str) -> Column:
    """crc32 of a value as text; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


@query
def op1_suffix_repetition(spark, sf_dir):
    """Repetition measures and verdict of every document."""
    ruled = repetition.repetition_rules(_documents(spark, sf_dir).select("doc_id", "text"))
    return ruled.select("doc_id", "repetition.*")


def vocabulary() -> str:
    """The ranks file of the vocabulary of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op2_vector_best_fit(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    packed = packing.pack_documents(_documents(spark, sf_dir), vocabulary())
    return packed.drop("row")


@query
def op3_multi_index_hashing(spark, sf_dir):
    """Twenty nearest of every twentieth vector."""
    return hashing.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def learned_toxicity(spark: SparkSession, sf_dir: str) -> dict:
    """The network, trained on labelled documents of the learning part."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    docs = _documents(spark, sf_dir).select("doc_id", "text").where(crc_of("doc_id") % 3 != 1)
    return toxicity.learn(docs, labels, F.xxhash64("doc_id"))


@query
def op4_recurrent_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from two thirds of the labels."""
    docs = _documents(spark, sf_dir).select("doc_id", (crc_of("doc_id") % 3 == 1).alias("held_out"), "text")
    scored = toxicity.score_toxicity(docs, learned_toxicity(spark, sf_dir))
    score = F.col("toxicity.score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), F.col("toxicity.window").alias("window"))


@query
def op5_adaptive_prefix_join(spark, sf_dir):
    """Groups of documents whose 4-word shingles are alike by 0.85 or more."""
    return ngram_join.link_documents(_documents(spark, sf_dir))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op6_contextual_pii(spark, sf_dir):
    """Personal data in every document."""
    found = pii.find_pii(_documents(spark, sf_dir).select("doc_id", "text"))
    fixed = F.col("pii.fixed")
    kinds = F.transform(fixed, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(fixed), 256).alias("base_sha256"), _listed(F.col("pii.all")).alias("spans"))


@query
def op7_kneser_ney(spark, sf_dir):
    """Model and base score of every document, learned from nine tenths of them."""
    docs = _documents(spark, sf_dir).withColumn("held_out", crc_of("doc_id") % 10 == 0)
    model = ngram_lm.train(docs.where(~F.col("held_out")), F.col("text"))
    scored = ngram_lm.perplexity(docs.select("doc_id", "held_out", "text"), model)
    return scored.select("doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(model.total).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")


@query
def op8_compression(spark, sf_dir):
    """Language of every document, learned from three quarters of them."""
    docs = _documents(spark, sf_dir).withColumn("held_out", crc_of("doc_id") % 4 == 2)
    dictionaries = language.learn_dictionaries(docs.where(~F.col("held_out")).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "held_out", "text"), dictionaries)
    return found.select("doc_id", "held_out", "language.*")


@query
def op9_sampled_splitters(spark, sf_dir):
    """All documents in eight shards of near-equal bytes; equal texts lie side by side."""
    text = F.coalesce("text", F.lit(""))
    narrow = _documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(text).alias("text_key"),
    )
    sharded = sharding.shard_by_size(narrow, F.col("text_key"), F.col("doc_id"), F.col("size"), shards=8)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op10_repetition_rates(spark, sf_dir):
    """All documents mixed to the weights 5, 2, 1."""
    narrow = _documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(narrow, F.col("source"), F.col("words"), F.col("doc_id"))
    return mixed.select(
        "doc_id", "mixing.size", "mixing.source_size", "mixing.target", (F.col("mixing.size") * F.col("mixing.copies")).alias("taken")
    )


@query
def op11_prefix_crc_resampling(spark, sf_dir):
    """Documents weighed towards the benchmark's n-grams, the best twentieth ranked."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = importance.resample(_documents(spark, sf_dir).select("doc_id", "text"), benchmark, F.col("doc_id"), keep=["doc_id"])
    return drawn.select("doc_id", "importance.n_features", "importance.weight", "score", "rank")


@query
def op13_divergence_cube(spark, sf_dir):
    """Divergence of every source from the other sources of its language, and the terms that set it apart."""
    return divergence.audit(_documents(spark, sf_dir).select("lang", "source", "text"))


@query
def op12_factorisation_machine(spark, sf_dir):
    """Quality of every document, learned from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = _documents(spark, sf_dir).select("doc_id", (crc_of("doc_id") % 3 == 1).alias("held_out"), "text", "n_chars")
    learned = quality.learn(docs.where(~F.col("held_out")), labels, F.xxhash64("doc_id"), ["n_chars"])
    score = F.col("quality_score")
    scored = quality.score_quality(docs, learned, ["n_chars"])
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
