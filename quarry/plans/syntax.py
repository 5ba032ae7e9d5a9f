"""Immutable syntax tree of the search language."""

from __future__ import annotations

from dataclasses import dataclass

from quarry.plans.fields import Field


class QueryError(ValueError):
    """A query that can't be read, or that asks for what its fields don't offer."""


class Node:
    """Base of all nodes."""


@dataclass(frozen=True)
class Everything(Node):
    """Matches every row: the empty query."""


@dataclass(frozen=True)
class And(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    item: Node


@dataclass(frozen=True)
class ExactName(Node):
    text: str


@dataclass(frozen=True)
class Ref(Node):
    """A field, and the alias the query used for it."""

    field: Field
    alias: str


@dataclass(frozen=True)
class Number(Node):
    value: int | float


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Pattern(Node):
    value: str


@dataclass(frozen=True)
class Cost(Node):
    value: str


@dataclass(frozen=True)
class Arith(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Compare(Node):
    op: str
    left: Node
    right: Node


def flatten(node: Node) -> Node:
    """Joins conjunctions within conjunctions, and disjunctions within disjunctions."""
    match node:
        case And(items) | Or(items):
            kind, out = type(node), []
            for item in map(flatten, items):
                out.extend(item.items if isinstance(item, kind) else (item,))
            return kind(tuple(out)) if len(out) > 1 else out[0]
        case Not(item):
            return Not(flatten(item))
    return node
