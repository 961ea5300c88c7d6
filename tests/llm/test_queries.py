import pytest

import __spark_entry__ as E
from crewgate.llm.queries import QUERIES
from tests.llm.conftest import SF

COLUMNS = {
    "op1_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words "
                         "base_failed kept",
    "op4_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint "
                                 "near_edited near_next",
    "op6_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_minhash_near_dedup": "doc_id class_id",
    "op10_quality_classifier": "doc_id held_out score predicted",
    "op11_filter_interaction_audit": "part filter_order step kept removed redundant unique_fails "
                                     "good_lost toxic_lost shapley",
    "op12_bpe_tree": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_importance_resampling": "doc_id n_features weight score rank",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_the_whole_table(spark, name):
    df = E.queries()[name](spark, SF)
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    n = df.count()
    if "doc_id" in df.columns:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert df.select("doc_id").distinct().count() == docs.count() <= n
    else:
        assert n > 0


def test_chat_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = QUERIES["op6_chat_formatting"](spark, SF)
    want = con.sql(E.oracle_sql()["op6_chat_formatting"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
