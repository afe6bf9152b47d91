"""The model runs once per text, whatever is made of its vectors."""

from textmatch.operators import records as R
from textmatch.options import DEFAULTS
from textmatch.plans.checking import text_vectors
from textmatch.plans.model import hashed_token_model

VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "one", "two", "##s"]


def test_one_model_run_in_the_plan(spark):
    vocab = spark.createDataFrame(list(enumerate(VOCAB)), "id int, token string")
    pieces = spark.createDataFrame([(1, 0, "one twos"), (1, 1, "three"), (2, 0, ""), (3, 0, None)], "doc_id long, pos int, sentence string")
    vectors = text_vectors(pieces, vocab, hashed_token_model(4), DEFAULTS)
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("predict(") == 1
    assert len(plan) < 60_000  # no expression is written out over and over
    found = {(r["doc_id"], r["token"]) for r in vectors.collect()}
    assert {(1, "one"), (1, "two"), (1, "##s"), (1, "[UNK]")} <= found


def test_records_without_features_have_no_rows(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, []), (1, 2, [("a", [(-1, [1.0])])])], "file_id int, " + R.RECORD_SCHEMA)
    assert [(r["vec_id"], r["token"]) for r in R.unnest(rows).collect()] == [(2 << 32, "a")]
