"""Exact dedup, line dedup, span dedup and mixing: edge cases and plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import exact_dedup as E
from strandline.llm import line_dedup, mixing, span_dedup
from strandline.llm.shingles import Words

#: Further columns whose names the operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string, key string, copies int, _bucket string, id string, sha string, node string"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    return docs(spark, [(i, t, "en", s, 0, *["x"] * 3, 7, *["x"] * 4) for i, t, s in rows], CLASHING)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (2, ""), (7, "c"), (8, " "), (None, "c"), (None, "d"), (6, "a b\x0b")]


def test_exact_groups(spark):
    got = {r.doc_id: r for r in E.exact_dedup(docs(spark, ROWS)).collect() if r.doc_id is not None}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {5: (3, 3, False), 3: (3, 3, True), 9: (3, 3, False), 4: (2, 2, False), 2: (2, 2, True), 7: (7, 2, True), 8: (8, 1, True), 6: (6, 1, True)}
    assert got[9].text_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_exact_repeated_rows_and_empty_table(spark):
    got = E.exact_dedup(docs(spark, [(1, "x"), (1, "x"), (2, "x")])).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, False), (1, True), (2, False)]
    assert E.exact_dedup(docs(spark, [])).collect() == []


def test_exact_collisions_are_told_apart_by_bytes(spark):
    weak = F.unhex(F.substring(F.sha2("norm", 256), 1, 1).cast("string"))
    rows = [(i, f"t{i % 40}") for i in range(80)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.exact_dedup(docs(spark, rows), digest=weak).collect()}
    assert got == {i: (i % 40, 2) for i in range(80)}


def test_state_outlives_a_batch(spark, tmp_path):
    store = E.StreamingDedup(spark, "file://" + str(tmp_path / "store"))
    rows = lambda *x: docs(spark, list(x)).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.col("text").alias("norm"))
    store.add(rows((5, "a"), (6, "b")))
    store.add(rows((4, "a"), (7, "b")))
    groups = store.groups()
    assert sorted((r.holder.doc_id, r.group_size) for r in groups.collect()) == [(4, 2), (6, 2)]
    # Locators of two landings are told apart, and each finds its own content.
    found = store.landed().join(groups.select("digest", "holder"), "digest").select("doc_id", "norm", (F.col("locator") == F.col("holder.locator")).alias("kept"))
    assert sorted((r.doc_id, r.norm, r.kept) for r in found.collect()) == [(4, "a", True), (5, "a", False), (6, "b", True), (7, "b", False)]
    assert store.landed().select("locator").distinct().count() == 4


def test_keep_first_keeps_columns_and_one_row(spark):
    got = E.keep_first(clashing(spark, [(1, "x", "s"), (1, "x", "s"), (2, "x", "s"), (3, "y", "s"), (1, "z", "s"), (None, "q", "s")]))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "q"), (1, "x"), (1, "z"), (3, "y")]
    assert len(got.columns) == 13


def test_lines_of_a_site(spark):
    page = lambda i, h, *ls: (i, f"http://u@{h}:80/p?q" if h else None, "<p>" + "</p><p>".join(ls) + "</p><script>x</script>")
    rows = [page(i, "A.example", "menu", f"own <b>text</b> {i}", "menu") for i in range(6)] + [page(9, "b.example", "menu", "z"), page(10, None, "menu")] + [(11, "http://b.example/", None)]
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(docs(spark, rows, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].host_pages, got[1].n_lines, got[1].n_dropped, got[1].text) == ("a.example", 6, 3, 2, "own text 1")
    assert got[9].text == "menu\nz" and got[10].host == "" and got[11].text == ""
    assert line_dedup.drop_boilerplate(docs(spark, [], "page_id long, url string, html string")).collect() == []


def brute_spans(rows):
    seen, out = set(), {}
    for d, x in sorted((d, x or "") for d, x in rows):
        ms = list(re.finditer(r"[^\x20\x09-\x0D]+", x))
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), m[0]) for m in ms]
        h, units, b = Words([x]).hashes, [], 0
        for i, m in enumerate(ms):
            if m[0][-1] in ".!?" or i == len(ms) - 1 or "\n" in x[m.end() : ms[i + 1].start()]:
                s = b
                for k in range(b, i + 1):
                    if k == i or (i + 1 - b > span_dedup.LONG and int(h[k]) % span_dedup.CUT == 0):
                        units.append((s, k + 1))
                        s = k + 1
                b = i + 1
        gone = set()
        for i in range(len(units)):
            j = i + span_dedup.SENTENCES - 1
            while j < len(units) and units[j][1] - units[i][0] < span_dedup.WORDS:
                j += 1
            if j >= len(units):
                break
            key = tuple(low[units[i][0] : units[j][1]])
            if key in seen:
                gone |= set(range(units[i][0], units[j][1]))
            seen.add(key)
        kept = x[: ms[0].start()] if ms else x
        out[d] = (len(ms), len(gone), kept + "".join(x[m.start() : ms[i + 1].start() if i + 1 < len(ms) else len(x)] for i, m in enumerate(ms) if i not in gone))
    return out


def test_spans_match_brute_force(spark):
    rng = random.Random(5)
    sentence = lambda n: " ".join(rng.choice(["Alpha", "beta", "gàmma", "delta", "eps"]) + str(rng.randrange(30)) for _ in range(n)) + rng.choice([".", "!", "\n", ""])
    shared = " ".join(sentence(9) for _ in range(8))
    rows = [(i, " ".join([sentence(7), sentence(30), shared if i % 3 else sentence(50), sentence(4)])) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "one"), (53, shared + " " + shared), (54, rows[1][1])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in span_dedup.drop_repeats(docs(spark, rows)).collect()}
    assert got == brute_spans(rows) and got[54][1] > 50 and got[53][1] > 50


def test_spans_leave_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"w{i}." for i in range(60))
    got = span_dedup.drop_repeats(docs(spark, [(None, text), (1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 60)]
    assert span_dedup.drop_repeats(docs(spark, [])).collect() == []


def test_water_filling():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    got = mixing.water_fill([10, 100, 100], [5, 2, 1], 3)
    assert got[0] == 30 and sum(got) == pytest.approx(210) and got[1] == pytest.approx(2 * got[2])
    assert mixing.water_fill([], [], 3) == []


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), "abc"[i % 3] if i % 7 else None, "x") for i in range(400)] + [(1000, None, "a", "x"), (1001, "", "a", "x")] + [(2000 + i, "w " * 30, "b", "x") for i in range(150)]
    table = docs(spark, rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(table).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        x = by.setdefault((r.source_size, r.target), [0, 0])
        x[0] += r.taken
        x[1] += r.size
    assert len(got) == len(rows) and len(by) == 4
    assert all(size == total and abs(taken - target) <= max(5, 0.01 * target) for (total, target), (taken, size) in by.items())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(table.repartition(3)).collect()))
    assert mixing.mix(docs(spark, [], "doc_id long, text string, source string")).collect() == []


def test_sources_in_tables_give_the_same_mix(spark):
    rng = random.Random(3)
    names = ["a", "b", "é", "z", "\U0001f600", "\uffff", "", None]
    rows = [(i, "w " * int(rng.lognormvariate(2, 1)), names[int(rng.random() ** 3 * 8)]) for i in range(200)] + [(900, "w " * 400, "b"), (901, None, "none"), (902, " ", "zero")]
    table = docs(spark, rows, "doc_id long, text string, source string")
    pick = lambda df: sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.copies) for r in df.collect())
    assert pick(mixing.mix(table, max_sources=0)) == pick(mixing.mix(table))
    assert mixing.mix(docs(spark, [], "doc_id long, text string, source string"), max_sources=-1).collect() == []


def test_applied_mix_repeats_rows(spark):
    table = clashing(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (2, "d " * 40, "t"), (None, "e f", "t"), (3, None, None)])
    want = sum(r.copies for r in mixing.mix(table).collect())
    got = mixing.apply_mix(table)
    assert got.count() == want and got.columns == table.columns


def test_spans_of_string_ids(spark):
    passage = " ".join(f"shared{i}" for i in range(30))
    rows = [("b", f"one two. {passage}. end"), ("a", f"three four. {passage}. stop"), (None, passage), ("c", "alone")]
    got = {r.doc_id: r.n_removed for r in span_dedup.drop_repeats(docs(spark, rows, "doc_id string, text string")).collect()}
    assert got["a"] == 0 and got["b"] >= 20 and got["c"] == 0 and got[None] == 0
