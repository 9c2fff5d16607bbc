"""The similarity join against brute force at several crowd sizes, components, and the pipeline's stages."""

import random
import re

import pytest

import corpus_pipeline
from strandline.llm import jaccard_join as J
from strandline.llm.components import components
from strandline.llm.shingles import shingle_sets


def plain_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_components(rows):
    sets = {}
    for i, t in rows:
        sets[i] = plain_set(t)
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1, groups=12):
    """Near copies with zero to six edits of a base, a passage that many share, short, empty and equal texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i := i + 1, " ".join(copy)))
    for _ in range(25):
        own = [word() for _ in range(rng.choice([5, 12, 60]))]
        rows.append((i := i + 1, " ".join(own + passage)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one  TWO"), (505, "one"), (506, rows[0][1].upper()), (507, "a b c d e f g"), (508, "a b c d e f")]
    rng.shuffle(rows)
    return rows


def test_shingles_are_the_plain_ones():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", "b", "é", " ", "\n", "\x1f", "\xa0"]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, ""]
    assert [len(s) for s in shingle_sets(texts)] == [len(plain_set(t)) for t in texts]


@pytest.mark.parametrize("n", range(1, 200))
def test_prefixes_are_exact(n):
    least = -(-3 * n // 4)
    assert J.prefix_length(n) == n - least + 1 and J.difference_fits(0, n, n)


@pytest.mark.parametrize("crowd", [1, 4, 32])
def test_components_match_brute_force(spark, crowd):
    rows = corpus()
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def test_large_clusters_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    rows = corpus(seed=3, groups=8)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    table = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "x"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in J.near_duplicates(table).collect())
    assert got == [(0, 2, 4), (2, 1, 2), (3, 0, 3), (4, 2, 4), (4, 2, 4)]
    text = " ".join(f"v{i}" for i in range(40))
    lone = spark.createDataFrame([(None, text), (8, text + " more"), (None, "q " * 9)], table.schema)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in J.near_duplicates(lone).collect()) == [(0, 0), (0, 8), (8, 8)]
    assert sorted(r.doc_id or 0 for r in J.keep_one(table).collect()) == [0, 2, 3, 4, 4]
    assert J.near_duplicates(table.limit(0)).collect() == []


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = {"en": ["the", "thing", "shore", "with", "that"], "fr": ["être", "où", "nous", "ça", "près"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(vocabulary))
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) + str(rng.randrange(9)) for _ in range(rng.randint(20, 60))), lang, f"s{i % 4}", 0))
    rows += [(1000, rows[3][1], "en", "s1", 0), (1001, rows[4][1] + " extra", "fr", "s1", 0), (1002, "12 34", None, "s2", 0), (1003, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    first, second, third, fourth, last = seen.values()
    assert {1002, 1003}.isdisjoint(r.doc_id for r in first) and len(first) == 242
    assert {r.doc_id for r in second} == {r.doc_id for r in first} - {1000}
    want = plain_components([(r.doc_id, r.text) for r in second])
    assert {r.doc_id for r in third} == {i for i, (_, c) in want.items() if i == c} and 1001 not in {r.doc_id for r in third}
    assert {r.doc_id for r in fourth} <= {r.doc_id for r in third} and len(fourth) > len({r.doc_id for r in fourth})
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)
