"""Every registered query of the package on the smallest tables; SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as entry
from tablefill.llm import queries as llm

SF001 = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_minhash_dedup": ["doc_id", "class_id"],
    "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_shared_passages": ["doc_id", "start_word", "n_words", "other_id"],
    "op4_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_html_text": ["page_id", "url", "text", "n_chars"],
    "op7_decontamination": ["doc_id", "item_id"],
    "op8_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op11_topk": ["query_id", "rank", "vec_id", "score"],
    "op12_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


@pytest.mark.parametrize("name", llm.QUERIES)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF001)
    assert got.columns[:len(COLUMNS[name])] == COLUMNS[name]
    assert got.count() > 0 or name == "op13_collocations"  # the smallest texts may repeat nothing


@pytest.mark.parametrize("name", llm.ORACLE)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    cur = con.execute(llm.ORACLE[name])
    names = [d[0] for d in cur.description]
    got = llm.QUERIES[name](spark, SF001)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)
