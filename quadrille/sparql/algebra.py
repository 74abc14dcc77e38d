"""Query algebra: patterns, property paths and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    """``hidden``: a blank node of the query, which no projection returns."""

    name: str
    hidden: bool = False


Node = Var | str


class Expression:
    pass


@dataclass(frozen=True)
class Const(Expression):
    term: str


@dataclass(frozen=True)
class Ref(Expression):
    name: str


@dataclass(frozen=True)
class Call(Expression):
    name: str
    args: tuple[Expression, ...]


@dataclass(frozen=True)
class Exists(Expression):
    pattern: Pattern
    negated: bool


@dataclass(frozen=True)
class Aggregate(Expression):
    name: str
    arg: Expression | None
    distinct: bool = False
    separator: str = " "


class Path:
    pass


@dataclass(frozen=True)
class Step(Path):
    iri: str


@dataclass(frozen=True)
class Inverse(Path):
    path: Path


@dataclass(frozen=True)
class Sequence(Path):
    first: Path
    second: Path


@dataclass(frozen=True)
class Alternative(Path):
    first: Path
    second: Path


@dataclass(frozen=True)
class Repeat(Path):
    """``zero``: no step will do; ``many``: more than one will."""

    path: Path
    zero: bool
    many: bool


@dataclass(frozen=True)
class NotIn(Path):
    forward: tuple[str, ...]
    backward: tuple[str, ...]


class Pattern:
    pass


@dataclass(frozen=True)
class Triple:
    s: Node
    p: Node
    o: Node


@dataclass(frozen=True)
class Bgp(Pattern):
    triples: tuple[Triple, ...] = ()


@dataclass(frozen=True)
class PathPattern(Pattern):
    s: Node
    path: Path
    o: Node


@dataclass(frozen=True)
class Join(Pattern):
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class LeftJoin(Pattern):
    left: Pattern
    right: Pattern
    condition: Expression | None = None


@dataclass(frozen=True)
class Union(Pattern):
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class Minus(Pattern):
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class Filter(Pattern):
    condition: Expression
    pattern: Pattern


@dataclass(frozen=True)
class Graph(Pattern):
    name: Node
    pattern: Pattern


@dataclass(frozen=True)
class Service(Pattern):
    pattern: Pattern
    silent: bool


@dataclass(frozen=True)
class Extend(Pattern):
    pattern: Pattern
    name: str
    value: Expression


@dataclass(frozen=True)
class Values(Pattern):
    names: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class Group(Pattern):
    """``keys``: names, computed before; ``aggregates``: (name, aggregate)."""

    pattern: Pattern
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, Aggregate], ...]


@dataclass(frozen=True)
class OrderBy(Pattern):
    pattern: Pattern
    keys: tuple[tuple[Expression, bool], ...]


@dataclass(frozen=True)
class Project(Pattern):
    pattern: Pattern
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct(Pattern):
    pattern: Pattern


@dataclass(frozen=True)
class Slice(Pattern):
    pattern: Pattern
    offset: int = 0
    limit: int | None = None


@dataclass
class Query:
    form: str
    pattern: Pattern
    template: tuple[Triple, ...] = ()
    describe: tuple[Node, ...] = ()
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)


def names_in(e: Expression | None) -> set[str]:
    """Variables of an expression, without those of patterns inside it."""
    if isinstance(e, Ref):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*(names_in(a) for a in e.args)) if e.args else set()
    if isinstance(e, Aggregate):
        return names_in(e.arg)
    return set()
