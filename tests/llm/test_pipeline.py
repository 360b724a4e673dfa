from collections import Counter

import numpy as np

import corpus_pipeline
from spectrafold.llm.mixing import targets
from spectrafold.llm.tokens import encoder

from .test_dedup import brute_near
from .test_native import words


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert made.columns == docs.columns
            kept.append([(r["doc_id"], r["text"], r["source"]) for r in made.collect()])
            docs = made
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    accepted = {r[0] for r in kept[0]}
    assert len(good - accepted) <= 0.03 * len(good) and accepted < {r[0] for r in start} | {-1}

    best = {}
    for i, t, _ in kept[0]:
        best[t] = max(best.get(t, i), i)
    assert sorted(r[0] for r in kept[1]) == sorted(best.values())

    component, _ = brute_near(kept[1], 80)
    assert sorted(r[0] for r in kept[2]) == sorted(set(component.values()))

    sizes = Counter()
    for _, t, s in kept[2]:
        sizes[s] += words(t)
    goal, taken = targets(list(sizes.items())), Counter()
    for _, t, s in kept[3]:
        taken[s] += words(t)
    largest = {s: max(words(t) for _, t, u in kept[2] if u == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    assert max(Counter(r[0] for r in kept[3]).values()) <= 3

    pieces = made.collect()
    text = {i: t for i, t, _ in kept[3]}
    ids = dict(zip(text, encoder("word_bpe_49k.json").each(list(text.values()))))
    assert sum(p["length"] for p in pieces) == sum(len(ids[r[0]]) + 1 for r in kept[3])
    assert np.all([p["doc_tokens"] == len(ids[p["doc_id"]]) + 1 for p in pieces])


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
