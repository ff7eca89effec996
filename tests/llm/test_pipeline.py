import random

import corpus_pipeline
from flowloom.llm import exact_dedup, mixing, near_dedup
from tests.llm.test_near_dedup_and_mixing import _classes


def _corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(500):
        text = rng.choices(words, k=rng.randrange(20, 80))
        toxic = i % 6 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "scumlord", "idiot"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), 1))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 6]
    for k, r in enumerate(clean[:40]):
        rows.append((600 + k, r[1].upper() if k % 2 else r[1], r[2], r[3], 1))
    for k, r in enumerate(clean[40:80]):
        rows.append((700 + k, r[1] + " tail", r[2], r[3], 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, "lone " * 6000, "en", "s0", 0)]
    return rows, labels


def test_stages_and_their_decisions(spark, tmp_path):
    rows, labels = _corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {i for i, _, t in labels if t}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        path = f"{tmp_path}/{number}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        kept = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == docs.columns and out.count() == len(kept) and set(kept) <= set(before)
        if name == "toxicity":
            assert not set(kept) & toxic and len(set(before) - set(kept) - toxic) <= 0.03 * len(before)
        if name == "exact_dedup":
            texts = {}
            for i, t in before.items():
                key = exact_dedup.normalise(t or "")
                texts[key] = max(i, texts.get(key, i))
            assert set(kept) == set(texts.values())
        if name == "near_dedup":
            assert set(kept) == set(_classes(sorted(before.items())).values())
        if name == "mixing":
            plan = mixing.sampling_plan(docs).collect()
            assert set(kept) == {r.doc_id for r in plan if r.kept} and 0 < len(kept) < len(before)
        docs = out


def test_run_gives_the_last_stages_rows(spark, tmp_path):
    rows, labels = _corpus()
    spark.createDataFrame(rows[:120], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns)
    assert near_dedup.SIMILARITY == 0.8 and corpus_pipeline.ORACLE_SQL is None
