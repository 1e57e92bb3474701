"""The pipeline keeps, drops and places what its stages say."""

import random

import corpus_pipeline
from quarry.llm.common import materialize


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if k % 4 == 0 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for k in range(n))


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, prose(rng, 40)) for i in range(3)]
    clean = [(i, prose(rng, 200)) for i in range(60)]
    edited = [(100 + i, t.replace(t.split()[90], "changed", 1)) for i, t in clean[:20]]
    exact = [(200 + i, t) for i, t in clean[20:30]]
    leaks = [(300 + i, f"{prose(rng, 90)} {t} {prose(rng, 70)}") for i, t in items]
    junk = [(400, "short"), (401, None), (402, " | ".join(f"cell{i}" for i in range(200))), (403, "BUY!! NOW!! " * 80)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in clean + edited + exact + leaks + junk]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = set(docs.columns)
        docs = materialize(stage(spark, docs, str(tmp_path)))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "sharding":
            assert {"doc_id", "text", "lang", "source", "n_chars"} <= columns & set(docs.columns)
    names = [n for n, _ in corpus_pipeline.STAGES]
    everything = {r[0] for r in rows}
    assert seen[names[0]] == everything - {400, 401, 402, 403}
    assert seen[names[1]] == set(range(60)) | {300, 301, 302}
    assert seen[names[2]] == seen[names[3]] == seen[names[4]] == set(range(60))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(60)) and len(out) == 60
    by_place = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.mix_slot for r in by_place] == sorted(r.mix_slot for r in out), "shards are cut along the mix"


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
