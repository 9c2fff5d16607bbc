"""Queries that sum up or group races without forming all pairs, or without moving them, against the pairs themselves."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.signatures import race_message
from strandline.operators import locks, partners, races, relations
from strandline.plans import detect
from strandline.plans.queries import QUERIES, facts
from strandline.sources import scope
from strandline.sources.facts import Facts

TABLES = "/root/testdata/sf0.001"


def program(spark, seed):
    """Eleven threads in a forest with starts and joins, accesses of ancestors too, and up to eight locks held at once."""
    r = random.Random(seed)
    forest = [(t, None if t == 0 else (t - 1) // 3, r.randrange(30), r.choice([None, r.randrange(20, 80)])) for t in range(11)]
    accesses = [(i, t := r.randrange(11), p := r.randrange(80), r.choice(["READ", "WRITE"]), f"v{r.randrange(2)}", f"{t}:{p // 20}" if r.random() < 0.5 else f"at{i}") for i in range(70)]
    locked = [(t * 100 + 2 * k + e, t, 3 + k if not e else 60 - k, "UNLOCK" if e else "LOCK", f"L{k}") for t in range(11) for k in range(t % 4 * 3 % 8) if r.random() < 0.9 for e in (0, 1)]
    types = ("idx long, tid long, pos long, kind string, sig string, loc string", "idx long, tid long, pos long, kind string, lk string", "tid long, ptid long, s long, j long")
    return Facts(*(spark.createDataFrame(rows, t) for rows, t in zip((accesses, locked, forest), types)))


@pytest.mark.parametrize(("seed", "most"), [(1, 1), (2, 3)])
def test_numbers_and_partners_equal_the_pairs(spark, monkeypatch, seed, most):
    monkeypatch.setattr(partners, "MOST_LOCKS", most)
    f = program(spark, seed)
    held = locks.with_locksets(f.accesses, locks.critical_sections(f.locks))
    assert held.agg(F.max(F.size("locks"))).first()[0] > most
    found = detect.detect_races(f).collect()
    hit = {x for r in found for x in ((r.idx1, r.tid1), (r.idx2, r.tid2))}
    assert found and sorted(map(tuple, detect.racing_accesses(f).collect())) == sorted(hit)
    each = {s: [r.tid1 for r in found if r.sig == s] for s in {r.sig for r in found}}
    assert sorted(map(tuple, detect.race_numbers(f).collect())) == sorted((s, len(t), len(set(t))) for s, t in each.items())


@pytest.mark.parametrize("name", ["explain_race", "racy_variables"])
def test_no_race_is_formed(spark, monkeypatch, name):
    def forbidden(*_):
        raise AssertionError("all pairs are formed")

    monkeypatch.setattr(races, "racing", forbidden)
    assert QUERIES[name](spark, TABLES).count()


def test_races_of_places_and_messages(spark):
    """Places with one access and with several, and one with a comma; wherever the races come from, each key is one row."""
    f = program(spark, 1)
    f = f.with_(accesses=f.accesses.withColumn("loc", F.when(F.col("idx") % 9 == 4, F.concat("loc", F.lit(", x"))).otherwise(F.col("loc"))))
    found = detect.detect_races(f)
    assert sorted(map(tuple, detect.distinct_races(f).collect())) == sorted(map(tuple, races.distinct_races(found).collect()))
    said = found.withColumn("message", race_message(F.col("sig"), F.col("loc1"), F.col("loc2")))
    want = scope.merge_markers(said.filter("idx1 % 2 = 0"), said.filter("idx1 % 7 = 1"), said.filter("idx1 % 6 = 0"))
    assert sorted(map(tuple, detect.markers(f, "idx1 % 2 = 0", "idx1 % 7 = 1", "idx1 % 6 = 0").collect())) == sorted(map(tuple, want.collect()))


def test_races_of_lone_accesses_are_not_grouped(spark):
    """Every access of the events has a place of its own, so no race goes into a grouping."""
    single, rest = detect._apart(facts(spark, TABLES))
    assert single.count() == QUERIES["races_found"](spark, TABLES).count() > 0 and rest.isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_relations_without_races(spark, monkeypatch, seed):
    """Small blocks and batches, accesses of ancestors, several locks."""
    monkeypatch.setattr(relations, "BLOCK_WRITES", 3)
    f = program(spark, seed)
    want = races.relations(detect.detect_races(f)).collect()
    monkeypatch.setattr(races, "racing", lambda *_: pytest.fail("all pairs are formed"))
    assert want and sorted(map(tuple, detect.race_relations(f).collect())) == sorted(map(tuple, want))
