import random

import corpus_pipeline
from pyspark.sql import functions as F

from cytoframe.llm import toxicity
from cytoframe.llm.queries import learned_toxicity


def test_stages_over_a_small_corpus(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "is"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(160):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            words[7], words[30] = "grukish", "grukan"
        rows.append((i, " ".join(words), "en", f"src{i % 3}" if i % 5 else None))
    rows += [(200, rows[1][1], "en", "src0"), (201, rows[1][1] + " more", None, "src1"), (202, "write to ab@cd.ef now", "en", "src2"), (203, None, None, None), (204, "", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)

    clean = steps["toxicity"](spark, stored, str(tmp_path))
    kept = {r["doc_id"] for r in clean.collect()}
    # forty toxic texts, a third of them held out, teach little: how well it learns is tested with the operator
    scored = toxicity.score_toxicity(stored, learned_toxicity(spark, str(tmp_path))).collect()
    assert clean.columns == stored.columns and kept == {r["doc_id"] for r in scored if r["toxicity"]["score"] < corpus_pipeline.REJECT}
    assert len(kept & {i for i in range(160) if i % 4}) >= 108 and len(kept & set(range(0, 160, 4))) < 20
    single = steps["near_duplicates"](spark, stored, str(tmp_path))
    assert single.columns == stored.columns and {r["doc_id"] for r in single.collect()} == set(range(160)) | {202, 203, 204}
    redacted = {r["doc_id"]: r for r in steps["personal_data"](spark, stored, str(tmp_path)).collect()}
    assert redacted[202]["text"] == "write to <email> now" and redacted[202]["n_chars"] == len("write to <email> now")
    assert redacted[203]["text"] is None and redacted[0]["text"] == rows[0][1]
    mixed = steps["mixing"](spark, stored, str(tmp_path))
    assert mixed.columns == stored.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert (packed.groupby("sequence_id")["length"].sum() <= 1024).all() and not set(packed["doc_id"].dropna()) & {200, 201}


def test_near_duplicates_by_five_words_leave_one_row_of_a_group(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200))
    near, repeated, without_id, same, half = (text() for _ in range(5))
    changed = near.split()
    for at in (30, 70, 110, 150):
        changed[at] = "other"  # 176 of 216 shingles of five words, 181 of 213 of four
    rows = [(1, near, "a"), (2, " ".join(changed), "a"), (3, repeated, "a"), (3, repeated, "b"), (None, without_id, "a"), (None, without_id + " x", "a")]
    rows += [(4, same, "a")] * 3 + [(None, half, "a"), (9, half, "a"), (8, half, "a"), (5, text(), "a"), (6, "", "a"), (6, "", "a"), (None, None, "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["text"]]
    assert sorted(i or 0 for i in ids) == [0, 1, 3, 4, 5, 8]
    assert kept.where("text is null or text = ''").count() == 4


def test_columns_of_the_operators_names_pass_through_every_stage(spark, tmp_path):
    rows = [(1, "some words to keep here", "en", "a", 23, "t", 1, "m"), (2, None, None, None, None, None, None, None), (3, "", "en", "b", 0, "t", 2, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity string, PII long, mixing string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        got = set(map(tuple, kept.collect()))
        assert got <= {tuple(r) for r in rows} and (len(got) == 3 or name == "mixing"), name


def test_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
