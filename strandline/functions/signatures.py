"""Signatures of accesses, locks and findings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_prefix(declaring: Column, field: Column) -> Column:
    """`pkg/Class.field`; a leading type letter L is dropped."""
    return F.concat_ws(".", F.regexp_replace(declaring, "^L", ""), field)


def object_sig(prefix: Column, obj: Column) -> Column:
    """Of an instance field: the prefix and the object; the bare prefix without one."""
    return F.when(obj.isNull(), prefix).otherwise(F.concat_ws(".", prefix, obj))


def array_sig(obj: Column) -> Column:
    """Of an array element; all elements of one array are one."""
    return F.concat(F.lit("array."), obj)


def line_sig(declaring: Column, line: Column) -> Column:
    """`pkg/Class:line` of an instruction; the sign of inner classes is dropped."""
    return F.concat(F.regexp_replace(F.regexp_replace(declaring, "^L", ""), r"\$", ""), F.lit(":"), line.cast("string"))


def lock_sig(obj_type: Column, obj: Column) -> Column:
    """Null where the object isn't known, so that two unknown ones are no common lock."""
    return F.concat(obj_type, F.lit("."), obj)


def race_sig(sig: Column, is_array: Column) -> Column:
    """What a race is named after: the signature without its object; any array is `array`."""
    return F.when(is_array, F.lit("array")).otherwise(F.regexp_replace(sig, r"\.[^.]*$", ""))


def race_message(sig: Column, one: Column, two: Column) -> Column:
    return F.concat(F.lit("Race: "), sig, F.lit(" ("), F.least(one, two), F.lit(", "), F.greatest(one, two), F.lit(")"))


def deadlock_message(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.concat(F.lit("Deadlock: ("), a1, F.lit(","), a2, F.lit(";  "), b1, F.lit(","), b2, F.lit(")"))


def limited_context(receiver: Column, context: Column, k: int) -> Column:
    """The receiver in front of its caller's context, the k latest of them."""
    return F.slice(F.concat(F.array(receiver), F.coalesce(context, F.array().cast("array<string>"))), 1, k)


def two_decimals(x: Column) -> Column:
    """At most two decimals, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.round(x, 2).cast("decimal(30,2)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
