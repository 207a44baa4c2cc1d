"""Semantic versions as columns: parsing, comparing, and ranges such as `>=1.2.0,<2.0.0`."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
_CLAUSE = re.compile(r"^\s*(>=|<=|==|!=|>|<|)\s*(\S+)\s*$")


def parsed(version: Column) -> Column:
    """An orderable struct; null for a null or malformed version.

    A release is above its pre-releases. Their identifiers compare one by one, numbers below words and by value.
    """
    pre = F.regexp_extract(version, PATTERN, 4)
    part = lambda p: F.struct(p.rlike("^[0-9]+$").__invert__().alias("word"), F.when(p.rlike("^[0-9]+$"), F.lpad(p, 30, "0")).otherwise(p).alias("text"))
    number = lambda i: F.expr("cast(null as bigint)") if i is None else F.regexp_extract(version, PATTERN, i).cast("bigint")
    whole = F.struct(*[number(i).alias(f"v{i}") for i in (1, 2, 3)], (pre == "").alias("final"), F.transform(F.split(pre, "\\."), part).alias("pre"))
    return F.when(version.rlike(PATTERN), whole)


def satisfies(version: Column, spec: str) -> Column:
    """Whether a version fits all clauses of a spec; null and malformed versions fit none."""
    own = parsed(F.when(version.rlike(PATTERN), version).otherwise("0.0.0"))
    tests = []
    for clause in spec.split(","):
        m = _CLAUSE.match(clause)
        if not m or not re.match(PATTERN, m[2]):
            raise ValueError(f"no version clause: {clause!r}")
        other = parsed(F.lit(m[2]))
        tests.append({">=": own >= other, "<=": own <= other, "==": own == other, "": own == other, "!=": own != other, ">": own > other, "<": own < other}[m[1]])
    return F.coalesce(version.rlike(PATTERN), F.lit(False)) & reduce(lambda a, b: a & b, tests)
