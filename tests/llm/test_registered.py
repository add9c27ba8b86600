"""The registered queries and the pipeline on the smallest tables."""

from pathlib import Path

import corpus_pipeline
import pytest
from tools.check_queries import compare, connect

import __spark_entry__ as contract
from shelfspark.llm.registry import entries
from tests.llm.helpers import TEXT_EDGES, documents, sentence, vocabulary

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def test_one_query_per_operator():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in contract.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "bpe"]


@needs_tables
@pytest.mark.parametrize("name", sorted(entries()))
def test_query_runs_and_equals_its_sql(spark, name):
    fn, sql = entries()[name]
    state, _, _, note = compare(spark, connect(FOLDER), FOLDER, fn, sql)
    assert state in ("ok", "rows-only"), note


@needs_tables
@pytest.mark.parametrize("name,columns", [
    ("op2_token_counts", "doc_id n_bytes n_tokens over_limit"), ("op3_substring_dedup", "doc_id n_words n_removed kept_sha256"),
    ("op6_bpe", "doc_id n_tokens ids_sha256 decoded_sha256"), ("op7_quality", "doc_id held_out score predicted"),
    ("op8_pii", "doc_id n_email n_ip n_card n_phone base_sha256 spans"), ("op9_toxicity", "doc_id held_out score predicted"),
    ("op10_nearest", "query_id rank vec_id score"),
    ("op11_prefix_trie", "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"),
    ("op12_filter_audit", "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley"), ("op13_mixing", "doc_id size source_size target taken")])
def test_columns(spark, name, columns):
    assert set(columns.split()) <= set(entries()[name][0](spark, FOLDER).columns)


@needs_tables
def test_stages_hand_on_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), "stage")
        if name != "bpe":
            assert docs.columns == columns
        assert docs.count() <= n
        n = docs.count()
    assert n > 0 and corpus_pipeline.run(spark, FOLDER).count() == n


@needs_tables
def test_stages_on_odd_rows(spark):
    import random
    rng = random.Random(1)
    clean = sentence(rng, vocabulary(4000), 80, 81)
    rows = TEXT_EDGES + [(1, clean), (2, clean + " end"), (2, clean + " end"), (None, None), (3, sentence(rng, vocabulary(4000), 50, 51)), (3, sentence(rng, vocabulary(4000), 50, 51))]
    docs = documents(spark, rows).withColumnRenamed("n_tokens", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), "stage")
    assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(["1", "3", "3", "None", *(str(i) for i, _ in TEXT_EDGES)])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0) if "text" in docs.columns else docs, FOLDER).count() == 0
