"""The query tree, and its compilation to a predicate and a score.

A term's score is its boost times its weight (1, or a given one); AND and OR add the scores of the
children that match and multiply by their boost; DISMAX takes the best child plus ``tiebreaker`` times
the rest. ``not`` can stand on any node; on a node without anything else it means all but those.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.events import token
from tidemark.schema import ALL_FIELD, ALL_VALUE, EVENT_TYPE, SEPARATOR

TYPES = ("TERM", "AND", "OR", "DISMAX")


@dataclass(frozen=True)
class Query:
    type: str = "TERM"
    field: str = ""
    value: str = ""
    queries: tuple[Query, ...] = ()
    not_: Query | None = None
    tiebreaker: float = 0.0
    boost: float = 1.0

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown query type {self.type}")
        if self.type == "TERM" and self.queries:
            raise ValueError("a TERM can't have queries")
        if self.type != "TERM" and not self.queries and self.not_ is None:
            raise ValueError(f"{self.type} needs queries")

    @staticmethod
    def from_dict(d: dict | None) -> Query:
        """From the JSON form {queries, type, field, value, not, tiebreaker, boost}."""
        if d is None:
            raise ValueError("missing Query")
        return Query(
            type=d.get("type") or "TERM",
            field=d.get("field", ""),
            value=d.get("value", ""),
            queries=tuple(Query.from_dict(q) for q in d.get("queries") or ()),
            not_=Query.from_dict(d["not"]) if d.get("not") is not None else None,
            tiebreaker=float(d.get("tiebreaker") or 0),
            boost=float(d.get("boost") or 1),
        )


def term(field_: str, value: str, boost: float = 1.0) -> Query:
    return Query(field=field_, value=value, boost=boost)


def all_of(*queries: Query, boost: float = 1.0, not_: Query | None = None) -> Query:
    return Query("AND", queries=queries, boost=boost, not_=not_)


def any_of(*queries: Query, boost: float = 1.0, not_: Query | None = None) -> Query:
    return Query("OR", queries=queries, boost=boost, not_=not_)


def best_of(*queries: Query, tiebreaker: float = 0.0, boost: float = 1.0, not_: Query | None = None) -> Query:
    return Query("DISMAX", queries=queries, tiebreaker=tiebreaker, boost=boost, not_=not_)


def match_all() -> Query:
    return term(ALL_FIELD, ALL_VALUE)


def _own(q: Query) -> Column | None:
    """The predicate without ``not``; None for a node that is nothing but a ``not``."""
    if q.type == "TERM":
        if q.field == ALL_FIELD:
            return F.lit(q.value == ALL_VALUE)
        if not q.field or not q.value:
            return None if q.not_ is not None and not q.field and not q.value else F.lit(False)
        if q.field == EVENT_TYPE:
            return F.col(EVENT_TYPE) == q.value
        return F.array_contains("tokens", q.field + SEPARATOR + q.value)
    if not q.queries:
        return None
    if q.type != "AND":
        # plain terms of an OR are one look at the token array
        plain = [c for c in q.queries if c.type == "TERM" and c.not_ is None and c.field not in ("", ALL_FIELD, EVENT_TYPE) and c.value]
        if len(plain) > 2:
            rest = [predicate(c) for c in q.queries if c not in plain]
            return reduce(lambda a, b: a | b, [F.arrays_overlap("tokens", F.array(*(token(c.field, c.value) for c in plain))), *rest])
    return reduce((lambda a, b: a & b) if q.type == "AND" else (lambda a, b: a | b), map(predicate, q.queries))


def predicate(q: Query) -> Column:
    """Whether an event (columns event_type, tokens) matches."""
    own = _own(q)
    if q.not_ is None:
        return own
    rest = ~predicate(q.not_)
    return rest if own is None else own & rest


def score(q: Query, weights: dict[tuple[str, str], float] | None = None) -> Column:
    """An event's score, 0 if it doesn't match."""
    if q.type == "TERM":
        found = F.lit(q.boost * (weights or {}).get((q.field, q.value), 1.0))
    elif not q.queries:
        found = F.lit(q.boost)
    else:
        parts = [score(c, weights) for c in q.queries]
        total = reduce(lambda a, b: a + b, parts)
        if q.type == "DISMAX":
            best = F.greatest(*parts) if len(parts) > 1 else parts[0]
            total = best + F.lit(q.tiebreaker) * (total - best)
        found = F.lit(q.boost) * total
    return F.when(predicate(q), found).otherwise(F.lit(0.0))


def leaves(q: Query) -> list[Query]:
    """The scoring terms of a tree."""
    return ([q] if q.type == "TERM" and q.field and q.value else []) + [t for c in q.queries for t in leaves(c)]


def evaluate(q: Query, tokens: set[tuple[str, str]]) -> bool:
    """The predicate over a set of (field, value), in plain Python."""
    if q.type == "TERM":
        own = True if q.not_ is not None and not q.field and not q.value else bool(q.field and q.value) and ((q.field, q.value) in tokens or (q.field, q.value) == (ALL_FIELD, ALL_VALUE))
    elif not q.queries:
        own = True
    else:
        own = (all if q.type == "AND" else any)(evaluate(c, tokens) for c in q.queries)
    return own and not (q.not_ is not None and evaluate(q.not_, tokens))
