"""The stages of the pipeline on a small table with known outcomes."""

import random

import corpus_pipeline
from tests.llm.test_tokens import check_packing


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    v = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2000)]
    clean = {i: " ".join(rng.sample(v, 100)) for i in range(60)}
    item = " ".join(rng.sample(v, 30))
    texts = dict(clean)
    texts[100] = "short"                                            # base rule
    texts[101] = clean[5]                                           # copy
    texts[102] = clean[6].replace(clean[6].split()[50], "other", 1)  # near copy
    texts[103] = clean[7].rsplit(" ", 1)[0] + " tail " + item       # benchmark passage
    texts[4] = clean[4] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(200, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.collect()})
    every = set(clean) | {101, 102, 103}
    assert seen == [every, every - {101, 102}, set(clean), set(clean)]
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept[4] == clean[4] + ' [secret]" end' and all(kept[i] == t for i, t in clean.items() if i != 4)
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    check_packing(list(kept.items()), packed, 2048)
