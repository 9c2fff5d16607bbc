"""Edits of a program: what changes of its code, and which findings come and go."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import changes, traces
from strandline.plans import detect
from strandline.plans.program import Program, facts_of
from strandline.sources.facts import Facts


@dataclass(frozen=True)
class Edit:
    """What an edit replaces; what is None stays.

    methods    node_id of the methods whose code is new
    inst       their instructions, edges their calls; none for deleted methods
    modifiers  node_id, is_sync of methods that became or cease to be synchronized
    points_to  op + | -, and the columns of points_to
    """

    methods: DataFrame | None = None
    inst: DataFrame | None = None
    edges: DataFrame | None = None
    modifiers: DataFrame | None = None
    points_to: DataFrame | None = None


def with_modifiers(nodes: DataFrame, modifiers: DataFrame) -> DataFrame:
    """nodes with is_sync as modifiers (node_id, is_sync) have it."""
    new = modifiers.select("node_id", F.col("is_sync").alias("_sync"))
    return nodes.join(new, "node_id", "left").withColumn("is_sync", F.coalesce("_sync", "is_sync")).select(nodes.columns)


def apply_edit(program: Program, edit: Edit) -> Program:
    """The program after the edit. An edited method keeps its callers; its own calls are the edit's."""
    if edit.methods is not None:
        inst = traces.delete_traces(program.inst, edit.methods)
        edges = program.edges.join(edit.methods.select(F.col("node_id").alias("caller")), "caller", "left_anti").select(program.edges.columns)
        program = replace(program, inst=inst if edit.inst is None else inst.unionByName(edit.inst), edges=edges if edit.edges is None else edges.unionByName(edit.edges))
    if edit.modifiers is not None:
        program = replace(program, nodes=with_modifiers(program.nodes, edit.modifiers))
    if edit.points_to is not None:
        program = replace(program, points_to=changes.apply_points_to(program.points_to, edit.points_to))
    return program


def without_methods(program: Program, methods: DataFrame) -> Program:
    """The program whose ignored methods (node_id) do nothing; from the program itself, they count again."""
    return apply_edit(program, Edit(methods=methods))


@dataclass(frozen=True)
class Gate:
    """Which detectors an edit concerns."""

    races: bool
    deadlocks: bool


def gate(before: Facts, after: Facts) -> tuple[Gate, Facts]:
    """Which detectors must run again, and `after` with the tables of `before` where they are equal.

    Changed threads and locks concern both detectors, changed accesses the races.
    """
    same = {t: getattr(before, t) is getattr(after, t) or changes.one_sided(getattr(before, t), getattr(after, t)).isEmpty() for t in ("accesses", "locks", "threads")}
    after = after.with_(**{t: getattr(before, t) for t, s in same.items() if s})
    deadlocks = not (same["locks"] and same["threads"])
    return Gate(deadlocks or not same["accesses"], deadlocks), after


@dataclass(frozen=True)
class Delta:
    """Findings that come and go; None where a detector wasn't concerned."""

    races_added: DataFrame | None
    races_removed: DataFrame | None
    deadlocks_added: DataFrame | None
    deadlocks_removed: DataFrame | None


def facts_delta(before: Facts, after: Facts, gated: bool = False) -> Delta:
    runs, after = gate(before, after)
    races = detect.race_changes(before, after) if runs.races else (None, None)
    deadlocks = detect.deadlock_changes(before, after, gated) if runs.deadlocks else (None, None)
    return Delta(*races, *deadlocks)


def program_delta(before: Facts, program: Program, edit: Edit, main: str, gated: bool = False) -> tuple[Facts, Delta]:
    """(facts after, what comes and goes) when `edit` is applied to the program that `before` was derived from."""
    after = facts_of(apply_edit(program, edit), main)
    return after, facts_delta(before, after, gated)
