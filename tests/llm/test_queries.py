"""The registered queries: names, columns, and those that SQL can say against it."""

import pytest

import __spark_entry__ as entry
from oncemore.llm import queries
from tests.check_oracle import connect, rows_of
from tests.helpers import DATA

COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_host_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_hmm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_decontamination": ["doc_id", "item_id"],
    "op6_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op7_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_boilerplate": ["page_id", "url", "text", "n_chars"],
    "op11_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op12_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op13_conversation_trie": [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ],
}


def test_registered():
    assert set(queries.QUERIES) == set(COLUMNS)
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if name not in ("op5_decontamination", "op13_conversation_trie"):
        assert out.count() == spark.read.parquet(f"{DATA}/{'pages' if 'page_id' in out.columns else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = connect(DATA).execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
