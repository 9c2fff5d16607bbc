"""Registered queries over small tables of their own, against plain Python: every row counts."""

import pytest

from strandline.plans.queries import QUERIES

#: (order, supplier, part): a cycle 1 > 2 > 3 > 1, a way 5 > 6 > 7 > 8, a self call, and repeats; only order 397 is a multiple of 397.
LINES = [(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 5, 6), (5, 6, 7), (397, 7, 8), (7, 5, 107), (8, 9, 9), (9, 10, 11), (10, 1, 103), (11, 70, 1)]
#: (event, user, type, value)
EVENTS = [(i, u, "error" if i % 3 == 0 else "view", float(i * 7 % 11)) for i, u in enumerate([1, 5, 41, 70, 106, 1, 5, 41, 70, 106, 2, 3, 44, 99, 2, 44, 3, 44, 2, 99, 106])]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{top}/lineitem.parquet")
    spark.createDataFrame([(*e, '{"k": 1}') for e in EVENTS], "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{top}/events.parquet")
    return top


def edges(shift=0):
    return {(a + shift, p % 101) for _, a, p in LINES if a != p % 101}


def below(start, shift=0):
    """What calls lead to from a node, itself left out unless a cycle leads back."""
    seen, left = set(), [start]
    while left:
        at = left.pop()
        for a, b in edges(shift):
            if a == at and b not in seen:
                seen.add(b)
                left.append(b)
    return seen


def rows(spark, tables, name):
    return sorted(map(tuple, QUERIES[name](spark, tables).collect()))


def test_call_graph_queries_read_every_line(spark, tables):
    nodes = {x for e in edges() for x in e}
    assert rows(spark, tables, "call_reach") == sorted((a, b) for a in nodes for b in below(a))
    assert rows(spark, tables, "graph_stats") == [(len(nodes), len(edges()))]
    nodes = {x for e in edges(1000) for x in e}
    live = {n for n in nodes if n % 10 == 0} | {n for n in nodes if n in below(n, 1000)}
    live |= {b for a in live for b in below(a, 1000)}
    assert rows(spark, tables, "orphans") == sorted((n,) for n in nodes - live)


@pytest.mark.parametrize("name", ["tid_propagation", "tid_removal"])
def test_every_thread_is_a_seed(spark, tables, name):
    users = {u for _, u, *_ in EVENTS if name == "tid_propagation" or u % 3 != 0}
    assert any(u >= 40 for u in users)
    assert rows(spark, tables, name) == sorted({(n, u) for u in users for n in below(u % 101) | {u % 101}})


def test_changed_methods_compare_all_events(spark, tables):
    old, new = {}, {}
    for _, user, kind, value in EVENTS:
        if user % 7 != 1:
            old[user] = max(old.get(user, value), value)
        if user % 7 != 2 and (kind != "error" or user % 2 == 0):
            new[user] = max(new.get(user, value), value)
    change = lambda u: "ADDED" if u not in old else "REMOVED" if u not in new else "BODY"
    assert rows(spark, tables, "changed_methods") == sorted((u, change(u)) for u in old.keys() | new.keys() if old.get(u) != new.get(u))
