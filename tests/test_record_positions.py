"""Records take their shuffled places from the plan, so that no instance is moved to be numbered."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textmatch.operators import pretraining as P
from textmatch.options import DEFAULTS, SPECIAL_TOKENS
from textmatch.plans import training_data
from textmatch.sources import writers

OPTIONS = replace(DEFAULTS, max_seq_length=16, dupe_factor=2)
WORDS = ["laut", "ombak", "pantai", "kapal", "##an"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = [(d, s, [WORDS[(d + s + i) % 5] for i in range(3 + s % 3)]) for d in range(6) for s in range(7)]
    path = str(tmp_path_factory.mktemp("segments") / "segments")
    spark.createDataFrame(rows, "doc_id long, seg_no int, tokens array<string>").write.parquet(path)
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate([*SPECIAL_TOKENS, *WORDS])], "token string, id int")
    return spark.read.parquet(path), vocab


def test_positions_are_those_of_shuffled_rows(made):
    segs, vocab = made
    masked = training_data.instances(segs, vocab, OPTIONS, stored=True)
    got = {tuple(r[c] for c in training_data.KEYS): r["position"] for r in masked.collect()}
    again = P.shuffled(masked.select(*training_data.KEYS), OPTIONS.seed, training_data.KEYS).collect()
    assert got == {tuple(r[c] for c in training_data.KEYS): r["position"] for r in again}
    assert sorted(got.values()) == list(range(len(got)))


def test_records_are_not_moved(made):
    segs, vocab = made
    records = training_data.records(training_data.instances(segs, vocab, OPTIONS, stored=True), vocab, 3, OPTIONS)
    assert "Exchange hashpartitioning" not in records._jdf.queryExecution().executedPlan().toString()


def test_files_hold_records_in_shuffled_order(made, spark, tmp_path):
    segs, vocab = made
    records = training_data.records(training_data.instances(segs, vocab, OPTIONS, stored=True), vocab, 3, OPTIONS)
    writers.write_records(records, str(tmp_path / "records"))
    rows = spark.read.parquet(str(tmp_path / "records")).select(F.input_file_name().alias("f"), "shard", "position").collect()
    assert all(r["position"] % 3 == r["shard"] for r in rows)
    for f in {r["f"] for r in rows}:
        places = [r["position"] for r in rows if r["f"] == f]
        assert places == sorted(places)
