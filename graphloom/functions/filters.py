"""Typed metadata filters: a small clause language over JSON text, compiled to one Column."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\Z")


def _path(*fields: str) -> str:
    return "$" + "".join("['" + f.replace("'", "\\'") + "']" for f in fields)


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _typed(found: Column, value: Any, strict: bool) -> tuple[Column, Column]:
    cast = (lambda t: found.cast(t)) if strict else (lambda t: found.try_cast(t))
    if isinstance(value, bool):
        return cast("boolean"), F.lit(value)
    if isinstance(value, int | float):
        return cast("double"), F.lit(float(value))
    if isinstance(value, str) and _DATE.match(value):
        return cast("timestamp"), F.lit(value).cast("timestamp")
    if isinstance(value, str):
        return found, F.lit(value)
    raise ValueError(f"a filter value must be a boolean, a number or a string, not {value!r}")


def _clause(metadata: Column, clause: dict, strict: bool) -> Column:
    field, op, value = clause["field"], clause.get("op", "eq"), clause.get("value")
    found = F.get_json_object(metadata, _path(field))
    if op == "in":
        if not isinstance(value, list | tuple) or not value:
            raise ValueError("'in' needs a list of values")
        return found.isin([_text(v) for v in value])
    if op not in _COMPARE:
        raise ValueError(f"unknown filter operation {op!r}")
    left, right = _typed(found, value, strict)
    return getattr(left, _COMPARE[op])(right)


def _contains(metadata: Column, value: Any, path: tuple[str, ...]) -> Column:
    """JSON containment: objects hold at least these fields, arrays at least these items, others are equal."""
    if isinstance(value, dict):
        held = F.lit(True)
        for k, v in value.items():
            held = held & _contains(metadata, v, (*path, k))
        return held & (F.get_json_object(metadata, _path(*path)).startswith("{") if not value else F.lit(True))
    found = F.get_json_object(metadata, _path(*path))
    if isinstance(value, list):
        if any(isinstance(v, dict | list) for v in value):
            raise ValueError("containment of nested arrays is not supported")
        items = F.from_json(found, "array<string>")
        return F.forall(F.array(*(F.lit(_text(v)) for v in value)).cast("array<string>"), lambda v: F.array_contains(items, v))
    if value is None:
        return F.get_json_object(metadata, _path(*path[:-1])).contains(json.dumps(path[-1]) + ":null")
    if isinstance(value, bool):
        return found == _text(value)
    if isinstance(value, int | float):
        return found.try_cast("double") == float(value)
    return found == value


def compiled(metadata: Column, wanted: dict | list | None, strict: bool = True) -> Column:
    """Whether ``metadata`` (JSON text) passes: nothing wanted, a dict to be contained, or clauses that all hold.

    A field that is missing fails every clause, ``neq`` too. ``strict`` raises on text where a number,
    date or boolean is compared; otherwise such rows fail. Comparison values type the comparison.
    """
    if not wanted:
        return F.lit(True)
    if isinstance(wanted, dict):
        return F.coalesce(_contains(metadata, wanted, ()), F.lit(False))
    if not isinstance(wanted, list | tuple):
        raise ValueError("a filter is a dict or a list of clauses")
    out = F.lit(True)
    for clause in wanted:
        out = out & _clause(metadata, clause, strict)
    return F.coalesce(out, F.lit(False))
