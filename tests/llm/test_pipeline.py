"""The pipeline's stages, one after another, against brute force on the smallest tables."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionmine.llm import langid, neardup, quality
from sessionmine.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, apply in corpus_pipeline.STAGES:
        before = docs
        docs = stage(apply(spark, docs, SF))
        out[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    assert list(out) == ["quality", "language", "near duplicates", "mixing", "packing"]

    before, after = out["quality"]
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, k in verdict.items() if k}

    before, after = out["language"]
    model = langid.learn(before)
    each = [(r["doc_id"], langid.predict(r["text"], model)) for r in before.collect()]
    limit = {}
    for lang in model.languages:
        h = sorted(p[2] for _, p in each if p[0] == lang)
        q = [h[max(0, int(np.ceil(x * len(h))) - 1)] for x in (0.25, 0.5, 0.75)]
        limit[lang] = (q[1], max((q[2] - q[0]) / 1.349, langid.MIN_DEVIATION))
    fits = {i for i, (lang, _, h, n) in each if h is not None
            and h <= limit[lang][0] + langid.MAX_DEVIATIONS * limit[lang][1] * max(1, np.sqrt(langid.FULL_LENGTH / n))}
    assert {r["doc_id"] for r in after.collect()} == fits

    before, after = out["near duplicates"]
    rows = [(r["doc_id"], neardup.shingle_set(r["text"], 5)) for r in before.collect()]
    links = [(i, j) for n, (i, a) in enumerate(rows) for j, b in rows[:n] if 100 * (k := len(a & b)) >= 80 * (len(a) + len(b) - k)]
    group = {i: i for i, _ in rows}
    for _ in rows:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    assert {r["doc_id"] for r in after.collect()} == set(group.values())

    before, after = out["mixing"]
    assert after.join(before, "doc_id", "left_anti").count() == 0 and 0.5 * before.count() < after.count() <= before.count()

    before, after = out["packing"]
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r["doc_id"]: plain.encode(r["text"], add_special_tokens=False).ids + [1] for r in before.collect()}
    got = {i: [] for i in tokens}
    for r in after.orderBy("doc_id", "start").collect():
        assert r["start"] == len(got[r["doc_id"]])
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert got == tokens
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_runs_do_not_disturb_each_other(spark, tmp_path, monkeypatch):
    """The first result is read after a second run; nothing is left when both are discarded."""
    from sessionmine.llm import common

    names = iter(range(10_000))
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}/sessionmine-{next(names)}")
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"]) for r in df.select("doc_id", "start", "length").collect())
    assert key(first) == key(second) and first.count() > 0
    assert len(list(tmp_path.iterdir())) < 10  # what the two results read
    corpus_pipeline.discard(first)
    assert second.count() > 0
    corpus_pipeline.discard(second)
    assert list(tmp_path.iterdir()) == []
