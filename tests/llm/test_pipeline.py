"""The pipeline against a plain version of its decisions."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from textmatch.llm import mixing, secret_tags, toxicity

from .cases import DOC_SCHEMA, documents, say, words
from .test_simhash import plain_components, plain_fingerprint

ITEM = say(random.Random(11), 40, 5000)


def rows():
    draw = random.Random(12)
    out = [(i, say(draw, draw.randint(20, 200), 5000), "en", f"s{i % 3}", 1) for i in range(300)]
    toxic = [(1000 + i, say(draw, 60, 5000) + " " + " ".join(draw.choice(toxicity.TERMS["insult"]) for _ in range(4)), "en", "s0", 1) for i in range(60)]
    copies = [(2000 + i, out[i % 20][1], "en", "s1", 1) for i in range(60)]
    near = []
    for i in range(20, 60):  # one or two words changed
        ws = out[i][1].split()
        for _ in range(1 if len(ws) < 60 else 2):
            ws[draw.randrange(len(ws))] = "changed"
        if len(ws) >= 60:
            near.append((3000 + i, " ".join(ws), "en", "s2", 1))
    leaks = [(4000 + i, f"{say(draw, 200, 5000)} {ITEM} {say(draw, 100, 5000)}", "en", "s2", 1) for i in range(10)]
    secrets = [(5000 + i, f"{say(draw, 50, 5000)} token = \"{draw.getrandbits(160):040x}\" {say(draw, 20, 5000)}", "en", "s1", 1) for i in range(10)]
    return out, toxic, copies, near, leaks, secrets


def write(spark, path, docs):
    labelled = [r[0] for r in rows()[0]] + [r[0] for r in rows()[1]]
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(1000 <= i < 2000)) for i in labelled], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_and_the_whole(spark, tmp_path):
    clean, toxic, copies, near, leaks, secrets = rows()
    docs = documents(spark, [*clean, *toxic, *copies, *near, *leaks, *secrets], clashes=False)
    path = write(spark, str(tmp_path), docs)
    now, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, path).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if k < 4:
            assert now.columns == docs.columns
    ids = lambda *groups: {r[0] for g in groups for r in g}
    assert kept["toxicity"] == ids(clean, copies, near, leaks, secrets)
    # One document of each group that all pairs of fingerprints form.
    rest = sorted([*clean, *copies, *near, *leaks, *secrets])
    roots = plain_components([plain_fingerprint(r[1]) for r in rest])
    first = {rest[root][0] for root in roots}
    assert kept["simhash_near_dedup"] == first and not first & ids(copies)
    assert len(first & ids(near)) < len(near) and first >= ids(clean)
    assert kept["benchmark_decontamination"] == first - ids(leaks)
    assert kept["secret_scan"] == first - ids(leaks) == kept["source_mix"]
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/stage3").collect()}
    assert all(texts[r[0]]["text"] == r[1] and texts[r[0]]["n_chars"] == r[4] for r in clean)
    for r in secrets:
        assert secret_tags.MARK in texts[r[0]]["text"] and not secret_tags.base_spans(texts[r[0]]["text"])
        assert texts[r[0]]["n_chars"] == len(texts[r[0]]["text"])
    mixed = {r["doc_id"]: r for r in now.collect()}
    assert all(m["size"] == len(words(texts[i]["text"])) and m["taken"] <= mixing.MAX_REPEATS * m["size"] for i, m in mixed.items())
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(str, whole.collect())) == sorted(map(str, now.collect()))


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    path = write(spark, str(tmp_path), documents(spark))
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    ids = [r["doc_id"] for r in got.collect()]
    # One row stands for the texts without words, one for the copies, one for "one".
    assert ids.count(6) == 1 and {1, 4, 5, 6, 10, 12} <= set(ids) and not {2, 3, 7, 8, 9, 11} & set(ids)
    none = spark.createDataFrame([], DOC_SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).filter(F.lit(True)).count() == 0
