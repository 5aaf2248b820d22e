"""The pipeline's stages, each against what is right for the stage's own input."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from moraine.llm import decontaminate, mixing, quality

DIR = "/root/testdata/sf0.001"


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def _first_of_classes(docs):
    """The smallest id of each component of texts with a weighted Jaccard similarity of 0.8 or more."""
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        words = (r.text or "").split()
        sets[r.doc_id] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i in sorted(sets):
        for j in sorted({j for g in sets[i] for j in where.get(g, ())}):
            common = (sets[i] & sets[j]).total()
            if common >= 0.8 * (sets[i].total() + sets[j].total() - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for g in sets[i]:
            where.setdefault(g, []).append(i)
    return sorted(i for i in sets if find(i) == i)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "token_ids"]
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test"
    right = [
        lambda d: sorted(r.doc_id for r in quality.judge(d, ordered=False).select("doc_id", "kept").collect() if r.kept),
        _first_of_classes,
        lambda d: _ids(decontaminate.flag(d, bench).where("not contaminated")),
        lambda d: sorted(r.doc_id for r in mixing.mix(d).collect() for _ in range(r.uses)),
        _ids,
    ]
    counts = [docs.count()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, right):
        stage(spark, docs, DIR).write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        assert name == "token_ids" or out.columns == columns
        assert _ids(out) == want(docs)
        docs = out
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5] > 0
