"""Logical expressions over counted sub-signatures: parsing, evaluation, and a native column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    pass


_LEX = re.compile(r"\s*(?:(\d+)|([&|()=<>,]))", re.A)


def parse(text: str) -> tuple:
    """("atom", index, op, n, m), ("and", a, b) or ("or", a, b). & binds tighter than |; a count
    follows an index only. ops: any (at least one), = > < and between (n to m)."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:]!r}")
        tokens.append(m[1] or m[2])
        at = m.end()
    tokens.append("")
    place = 0

    def take(*wanted):
        nonlocal place
        if tokens[place] in wanted:
            place += 1
            return tokens[place - 1]
        return None

    def number(most):
        nonlocal place
        if not tokens[place].isdigit() or int(tokens[place]) > most:
            raise ExpressionError("a number is missing")
        place += 1
        return int(tokens[place - 1])

    def atom():
        if take("("):
            inner = either()
            if not take(")"):
                raise ExpressionError("unclosed (")
            return inner
        index = number(2**64 - 1)
        op = take("=", ">", "<")
        if not op:
            return ("atom", index, "any", None, None)
        n = number(2**32 - 1)
        return ("atom", index, "between", n, number(2**32 - 1)) if take(",") else ("atom", index, op, n, None)

    def both():
        left = atom()
        while take("&"):
            left = ("and", left, atom())
        return left

    def either():
        left = both()
        while take("|"):
            left = ("or", left, both())
        return left

    tree = either()
    if tokens[place]:
        raise ExpressionError(f"trailing {tokens[place]!r}")
    return tree


def _holds(n, op, a, b):
    """For numbers and for columns alike."""
    if op == "any":
        return n >= 1
    if op == "=":
        return n == a
    if op == ">":
        return n > a
    if op == "<":
        return n < a
    return (n >= a) & (n <= b)


def evaluate(tree: tuple, hits: list[int]) -> bool:
    """An index beyond the hits counts as 0."""
    if tree[0] == "atom":
        _, index, op, a, b = tree
        return bool(_holds(hits[index] if index < len(hits) else 0, op, a, b))
    left, right = evaluate(tree[1], hits), evaluate(tree[2], hits)
    return left and right if tree[0] == "and" else left or right


def column(tree: tuple, hits: list[Column]) -> Column:
    """The expression as a column over hit counts."""
    if tree[0] == "atom":
        _, index, op, a, b = tree
        return _holds(F.coalesce(hits[index], F.lit(0)) if index < len(hits) else F.lit(0), op, a, b)
    left, right = column(tree[1], hits), column(tree[2], hits)
    return left & right if tree[0] == "and" else left | right
