import duckdb
import pytest

from cytoframe.llm.oracle import ORACLE
from cytoframe.llm.queries import QUERIES

COLUMNS = {
    "op1_suffix_repetition": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op2_vector_best_fit": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op3_multi_index_hashing": {"query_id", "rank", "vec_id", "score"},
    "op5_adaptive_prefix_join": {"doc_id", "n_shingles", "component_id"},
    "op6_contextual_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op7_kneser_ney": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8_compression": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_sampled_splitters": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op11_prefix_crc_resampling": {"doc_id", "n_features", "weight", "score", "rank"},
    "op12_factorisation_machine": {"doc_id", "held_out", "score", "predicted"},
    "op13_divergence_cube": {"lang", "source", "part", "item", "value", "rank"},
    "op10_repetition_rates": {"doc_id", "size", "source_size", "target", "taken"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_query_has_its_columns_and_equals_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert COLUMNS[name] <= set(got.columns)
    if "doc_id" in got and name != "op2_vector_best_fit":
        assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name in ORACLE:
        with duckdb.connect() as con:
            con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
            expected = con.sql(ORACLE[name]).df()[list(got.columns)]
        texts = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))
        assert texts(got) == texts(expected)
