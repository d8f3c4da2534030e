"""Small helpers for writing expressions as SQL text.

Rules are SQL expressions rather than chains of Column calls: a scoring plan has some
thousand nodes, and each Column call is a round trip to the JVM while a whole SQL
expression is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping


def lit(value: str | int | bool | None) -> str:
    """SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listing(values: Iterable[str]) -> str:
    """``'a', 'b', 'c'``"""
    return ", ".join(lit(v) for v in values)


def case(*branches: tuple[str, str], otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN {cond} THEN {value}" for cond, value in branches)
    last = f" ELSE {otherwise}" if otherwise is not None else ""
    return f"(CASE {whens}{last} END)"


def either(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def literal_map(table: Mapping[str, object]) -> str:
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items()) + ")"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` bound to ``name`` once, however often the body uses it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def fill(template: str, **parts: str) -> str:
    """Text of ``template`` with each ``{name}`` replaced by an expression."""
    pieces = re.split(r"\{(\w+)\}", template)
    terms = [
        f"CAST({parts[piece]} AS STRING)" if i % 2 else lit(piece)
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return "concat(" + ", ".join(terms) + ")"
