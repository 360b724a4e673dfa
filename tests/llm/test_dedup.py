import hashlib
import random
from collections import Counter

import pytest

from spectrafold.llm import components as components_module
from spectrafold.llm import near_dedup
from spectrafold.llm.common import Workspace
from spectrafold.llm.components import components
from spectrafold.llm.exact_dedup import exact_dedup, exact_groups
from spectrafold.llm.near_dedup import near_groups, trees_for


def brute_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows, percent):
    sets = {i: shingles(t) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return brute_components(links, sets), {i: len(s) for i, s in sets.items()}


def test_exact_groups(spark, make_docs):
    rows = [(1, "a", None), (2, "b", "s"), (3, "a", "s"), (4, None, "s"), (5, "", "s"), (6, "x" * 100, "s"), (7, "x" * 99 + "y", "s"), (8, "x" * 100, "s"), (8, "x" * 100, "s"), (None, "a", "s"), (None, "only", "s")]
    docs = make_docs(rows)
    got = exact_groups(docs)
    size = Counter(t or "" for _, t, _ in rows)
    best = {t: max((i for i, u, _ in rows if (u or "") == t and i is not None), default=None) for t in size}
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert got.count() == len(rows)
    for r in got.collect():
        assert any(r["keep_id"] == best[t] and r["group_size"] == size[t] for t in text[r["doc_id"]])
    assert got.filter("kept").count() == len(size)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and Counter(r["text"] or "" for r in kept.collect()) == Counter(list(size))
    assert exact_groups(make_docs([])).count() == 0


def test_exact_query_matches_brute_force(spark, sf):
    from spectrafold.llm.queries import op9_exact_dedup

    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    best, size = {}, Counter(t for _, t in docs)
    for i, t in docs:
        best[t] = max(best.get(t, i), i)
    want = sorted((i, best[t], size[t], best[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)
    assert sorted(tuple(r) for r in op9_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want


@pytest.mark.parametrize("chunk", [9, 200_000])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(components_module, "CHUNK", chunk)
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1040)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(80)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    want = brute_components(edges, {n for e in edges for n in e})
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t"), "c").count() == 0


def near_rows(seed):
    """Families of copies with a few words changed, at many degrees, one large."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 200]))]
        for _ in range(60 if family == 0 else rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 3, " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy), "s"))
    rows += [(len(rows) * 3 + k, t, None) for k, t in enumerate([None, "", "  \n", "one", "ONE", "two words", "two  words"])]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups(spark, make_docs, percent):
    rows = near_rows(percent)
    component, size = brute_near(rows, percent)
    got = near_groups(make_docs(rows), percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (size[i], component[i], component[i] == i) for i in component}
    assert len(got) == len(rows)


@pytest.mark.parametrize("block", [7, 1000])
def test_near_copies_that_drift_apart(spark, make_docs, monkeypatch, block):
    """A base and many copies edited on their own, most pairs of which are below the bound."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((k, " ".join(copy), "s"))
    component, size = brute_near(rows, 85)
    assert 1 < len(set(component.values())) < 80
    got = near_groups(make_docs(rows), percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == component


def test_template_pages_make_no_pairs(spark, make_docs):
    """Pages that share most of a template, just below the bound: regions are mixed, and rare shingles rule every pair out."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(300)]
    rows = [(k, " ".join(base[:250] + [word() for _ in range(50)]), "s") for k in range(80)]
    made = []
    save = Workspace.save
    try:
        Workspace.save = lambda self, df, name, *a: made.append((name, save(self, df, name, *a))) or made[-1][1]
        got = near_groups(make_docs(rows), percent=85).collect()
    finally:
        Workspace.save = save
    assert all(r["component_id"] == r["doc_id"] for r in got)
    counts = {name: df.count() for name, df in made if name in ("open", "lists", "ties")}
    assert counts["open"] > 40 and counts["ties"] == 0


def test_large_sets_are_ordered_by_whole_values():
    """Minima of large sets are small numbers; the forest's words must still differ."""
    import numpy as np
    import pandas as pd

    from spectrafold.llm.shingles import MinHash

    rng = np.random.default_rng(1)
    values = np.stack([MinHash(64).of(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)) for _ in range(4)])
    words = near_dedup.words_of_values(values) >> np.uint32(16)
    assert (values >> np.uint32(17)).max() == 0 and len(np.unique(words)) > 200
    assert pd.Series(words.ravel()).value_counts().max() <= 3


def test_survivors_of_many_groups(spark, make_docs):
    """Texts of many surviving groups, and unique ones whose length or prefix others share."""
    rows = [(k, f"text {k // 2:07d}", "s") for k in range(3000)] + [(9000 + k, "p" * 100 + str(k), "s") for k in range(50)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(make_docs(rows)).collect()}
    assert got == {i: (i | 1, 2, i % 2 == 1) for i in range(3000)} | {9000 + k: (9000 + k, 1, True) for k in range(50)}


def test_carried_columns_that_clash(spark, make_docs):
    docs = make_docs([(1, "a", "s"), (2, "a", "t")])
    got = exact_groups(docs, carry=("kept", "source", "size")).orderBy("doc_id")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "source", "size"] and [tuple(r) for r in got.collect()] == [(1, 2, 2, False, "s", "x"), (2, 2, 2, True, "t", "x")]


def test_very_long_texts(spark, make_docs):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, long, "s"), (2, long, "s"), (3, long + " end", "s"), (4, "short", "s")]
    assert {r["doc_id"]: r["keep_id"] for r in exact_groups(make_docs(rows)).collect()} == {1: 2, 2: 2, 3: 3, 4: 4}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(make_docs(rows), 85).collect()} == {1: (199_996, 1), 2: (199_996, 1), 3: (199_997, 1), 4: (1, 4)}


def test_near_groups_odd_tables(spark, make_docs):
    assert near_groups(make_docs([])).count() == 0
    text = " ".join(f"w{k}" for k in range(50))
    got = near_groups(make_docs([(None, text, "s"), (5, text, "s"), (5, text, "s"), (6, text + " more", "s"), (None, None, "s")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(5, 5, True), (5, 5, True), (6, 5, False)]
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True, True]


def test_near_query_matches_brute_force(spark, sf):
    from spectrafold.llm.queries import op6_near_dedup

    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    component, size = brute_near(rows, 85)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in op6_near_dedup(spark, sf).collect()} == {i: (component[i], size[i]) for i in component}


def test_trees():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** 4) ** trees_for(percent) <= 1.01e-5
