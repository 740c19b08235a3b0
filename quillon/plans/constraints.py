"""The constraint language over index cells.

A constraint is ``target:body``.  Targets: rowkey, cf, qual, ts, cellval.  Bodies: ``{a,b}`` a set of values,
``[lo,hi]`` a range whose sides may be empty, ``<re>`` a regular expression that must match all of the value,
``~p*~`` a prefix with anything after it, ``~p?~`` one with exactly one more character.  ``return:target`` says what to
return, always as distinct values.  A ts is compared as epoch milliseconds; its literals are such numbers or
``yyyy-MM-ddTHH:mm:ss``, and only sets and ranges apply.  A query is constraints joined by ``;``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.timespan import instant

TARGETS = ("rowkey", "cf", "qual", "ts", "cellval")
_META = set(".^$*+?{}[]\\|()")


def regex_prefix(pattern: str) -> str:
    """The literal text that every match begins with: safe to push to the scan as a prefix.  Nothing where the pattern has
    alternatives; a last character that may be missing or repeated is left out."""
    if "|" in pattern:
        return ""
    out = ""
    for i, c in enumerate(pattern):
        if c in _META:
            if c in "*?{" and out:
                out = out[:-1]
            break
        out += c
        if i + 1 == len(pattern):
            break
    return out


def check_pattern(pattern: str) -> None:
    """ValueError for what Java's engine, which is to run it, doesn't take; where no session is there to ask, nothing is checked."""
    sc = SparkContext._active_spark_context
    if sc is None:
        return
    try:
        sc._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException) as e:
        raise ValueError(f"{pattern!r} is no regular expression: {str(e).splitlines()[0]}") from None


def milliseconds(literal: str) -> int:
    literal = literal.strip()
    if "-" in literal[1:]:
        return round(instant(literal).timestamp() * 1000)
    return int(literal)


@dataclass(frozen=True)
class Constraint:
    target: str
    kind: str
    values: tuple = ()

    def column(self, c: Column) -> Column:
        """The predicate on a column."""
        if self.kind == "set":
            return c.isin(list(self.values))
        if self.kind == "range":
            lo, hi = self.values
            found = F.lit(True) if lo is None else c >= lo
            return found if hi is None else (c <= hi if lo is None else found & (c <= hi))
        if self.kind == "regex":
            whole = c.rlike(rf"\A(?:{self.values[0]})\z")
            prefix = regex_prefix(self.values[0])
            return c.startswith(prefix) & whole if prefix else whole
        found = c.startswith(self.values[0])
        if self.values[1] == "?":
            return found & (F.length(c) == len(self.values[0]) + 1)
        return found


def parse(text: str) -> Constraint:
    """One constraint; ValueError tells what is wrong with it."""
    target, colon, body = text.strip().partition(":")
    target, body = target.strip(), body.strip()
    if not colon or target not in (*TARGETS, "return"):
        raise ValueError(f"unknown target in {text!r}")
    if target == "return":
        if body not in ("rowkey", "qual", "ts", "cellval"):
            raise ValueError(f"can't return {body!r}")
        return Constraint(target, "return", (body,))
    read = milliseconds if target == "ts" else str
    if len(body) < 2 or body[0] + body[-1] not in ("{}", "[]", "<>", "~~"):
        raise ValueError(f"{body!r} is no constraint")
    inner = body[1:-1]
    if body[0] == "{":
        return Constraint(target, "set", tuple(read(v.strip()) for v in inner.split(",") if v.strip()))
    if body[0] == "[":
        sides = inner.split(",")
        if len(sides) != 2:
            raise ValueError(f"a range has two sides: {body!r}")
        lo, hi = (read(s.strip()) if s.strip() else None for s in sides)
        if lo is not None and hi is not None and lo > hi:
            raise ValueError(f"{lo!r} is above {hi!r}")
        return Constraint(target, "range", (lo, hi))
    if target == "ts":
        raise ValueError("a time takes a set or a range")
    if body[0] == "<":
        check_pattern(inner)
        return Constraint(target, "regex", (inner,))
    star, mark = inner.count("*"), inner.count("?")
    if star + mark != 1 or inner[-1] not in "*?":
        raise ValueError(f"a prefix ends with one * or ?: {body!r}")
    if len(inner) == 1:
        raise ValueError("the wildcard can't come first")
    return Constraint(target, "prefix", (inner[:-1], inner[-1]))


@dataclass
class CellQuery:
    """A parsed query."""

    constraints: list[Constraint] = field(default_factory=list)
    returns: str | None = None

    @classmethod
    def of(cls, text: str | list[str]) -> CellQuery:
        query = cls()
        seen: set[str] = set()
        for part in text.split(";") if isinstance(text, str) else text:
            if not part.strip():
                continue
            c = parse(part)
            if c.target in seen:
                raise ValueError(f"two constraints on {c.target}")
            seen.add(c.target)
            if c.kind == "return":
                query.returns = c.values[0]
            else:
                query.constraints.append(c)
        return query

    def run(self, index: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
        """The cells that fulfil every constraint; distinct values of one target if the query returns one.

        columns: which column each target is; ``ts`` may be a timestamp.  All constraints apply, whatever is returned."""
        names = {"rowkey": "rowkey", "cf": "cf", "qual": "qual", "ts": "ts", "cellval": "cellval"} | dict(columns or {})
        kinds = dict(index.dtypes)
        typed: dict[str, Column] = {}
        for target, name in names.items():
            if name not in kinds:
                continue
            c = F.col(name)
            if target == "ts":
                typed[target] = F.unix_millis(c.cast("timestamp")) if kinds[name].startswith("timestamp") else c
            else:
                typed[target] = c if kinds[name] == "string" else c.cast("string")
        for c in self.constraints:
            if c.target not in typed:
                raise ValueError(f"this index has no {c.target}")
        found = index
        for c in self.constraints:
            # times keep their own type, so that the range reaches the scan
            if c.target == "ts" and kinds[names["ts"]].startswith("timestamp"):
                found = found.where(_time(c, F.col(names["ts"]), kinds[names["ts"]]))
            else:
                found = found.where(c.column(typed[c.target]))
        return found if self.returns is None else found.select(F.col(names[self.returns]).alias(self.returns)).distinct()


def _time(c: Constraint, ts: Column, kind: str) -> Column:
    def edge(ms: int) -> Column:
        when = F.timestamp_millis(F.lit(ms))
        return when.cast(kind)

    if c.kind == "set":
        found = F.lit(False)
        for v in c.values:
            found = found | ((ts >= edge(v)) & (ts < edge(v + 1)))
        return found
    lo, hi = c.values
    found = F.lit(True) if lo is None else ts >= edge(lo)
    return found if hi is None else found & (ts < edge(hi + 1))


def keyword(key: Column, text: str) -> Column:
    """Keys by a list of keywords between commas or blanks, in lower case; one that ends with ``*`` is a prefix, one that ends
    with ``?`` a prefix with at most one character more."""
    words = [w for w in re.split(r"[,\s]+", text.lower()) if w]
    if not words:
        return F.lit(False)
    exact = [w for w in words if w[-1] not in "*?"]
    found = key.isin(exact) if exact else F.lit(False)
    for w in words:
        if w[-1] == "*":
            found = found | key.startswith(w[:-1])
        elif w[-1] == "?":
            found = found | (key.startswith(w[:-1]) & (F.length(key) <= len(w)))
    return found
