"""Which trigrams a text must hold to match a regular expression.

The expression is read by Python's own parser. For each part of it four things
are known: the few strings it can be (``exact``, or none if they are many), how its
matches can begin and end, and a Boolean query that they meet. Where parts meet, the
ends of one and the beginnings of the next give the trigrams across. All is in lower
case, as the index is. A query is ``ALL`` (no condition), a trigram, or
``("and" | "or", frozenset of queries)``.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product
from re import _constants as ops, _parser as parser
from typing import NamedTuple

ALL = None
#: Sets of strings larger than this are given up for what all of them hold.
MOST_STRINGS = 16
#: Sets of trigrams that a query may multiply to.
MOST_SETS = 64
#: Copies of a repeated part that are looked at.
COPIES = 3


class Part(NamedTuple):
    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: object


_ANYTHING = Part(None, frozenset({""}), frozenset({""}), ALL)


def _conditions(query) -> frozenset:
    return query[1] if isinstance(query, tuple) and query[0] == "and" else frozenset({query})


def both(*queries):
    """Met where all queries are met."""
    flat = set()
    for q in queries:
        if q is not ALL:
            flat |= _conditions(q)
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def either(*queries):
    """Met where one of the queries is met; those that ask for all that another asks for, and more, add nothing."""
    flat = set()
    for q in queries:
        if q is ALL:
            return ALL
        flat |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    flat = {q for q in flat if not any(_conditions(other) < _conditions(q) for other in flat)}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def of_strings(strings: Iterable[str]):
    """Met by texts that hold one of the strings."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


def _few(strings: Iterable[str], kept) -> frozenset[str]:
    """The strings, cut shorter until they are few."""
    strings, length = frozenset(strings), 8
    while len(strings) > MOST_STRINGS:
        length -= 1
        strings = frozenset(kept(s, length) for s in strings)
    return strings


def _first(s: str, n: int) -> str:
    return s[:n]


def _last(s: str, n: int) -> str:
    return s[len(s) - n :] if n < len(s) else s


def _part(exact, begins, ends, query) -> Part:
    if exact is not None and len(exact) > MOST_STRINGS:
        query, begins, ends, exact = both(query, of_strings(exact)), exact, exact, None
    return Part(exact, _few(begins, _first), _few(ends, _last), query)


def _joined(a: Part, b: Part) -> Part:
    cross = lambda x, y: frozenset(s + t for s, t in product(x, y))
    if a.exact is not None and b.exact is not None:
        whole = cross(a.exact, b.exact)
        return _part(whole, whole, whole, ALL)
    begins = cross(a.exact, b.begins) if a.exact is not None else a.begins
    ends = cross(a.ends, b.exact) if b.exact is not None else b.ends
    query = both(a.query, b.query, of_strings(cross(a.ends, b.begins)), of_strings(begins), of_strings(ends))
    return _part(None, begins, ends, query)


def _one_of(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        whole = frozenset().union(*(p.exact for p in parts))
        return _part(whole, whole, whole, ALL)
    query = either(*(both(p.query, of_strings(p.exact) if p.exact is not None else ALL) for p in parts))
    return _part(None, frozenset().union(*(p.begins for p in parts)), frozenset().union(*(p.ends for p in parts)), query)


def _characters(items) -> Part:
    """A class of characters; a negated or large one can be anything."""
    found = set()
    for kind, value in items:
        if kind is ops.LITERAL:
            found.add(chr(value).lower())
        elif kind is ops.RANGE and value[1] - value[0] < 64:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return _ANYTHING
        if len(found) > MOST_STRINGS:
            return _ANYTHING
    return _part(frozenset(found), frozenset(found), frozenset(found), ALL)


def _of(nodes) -> Part:
    whole = Part(frozenset({""}), frozenset({""}), frozenset({""}), ALL)
    for kind, value in nodes:
        if kind is ops.LITERAL:
            c = frozenset({chr(value).lower()})
            part = Part(c, c, c, ALL)
        elif kind is ops.IN:
            part = _characters(value)
        elif kind is ops.SUBPATTERN:
            part = _of(value[3])
        elif kind is ops.BRANCH:
            part = _one_of([_of(branch) for branch in value[1]])
        elif kind in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            part = _repeated(*value)
        elif kind is ops.AT:
            continue
        else:
            part = _ANYTHING
        whole = _joined(whole, part)
    return whole


def _repeated(least: int, most: int, body) -> Part:
    one, none = _of(body), _of([])
    copies = none
    for _ in range(min(least, COPIES)):
        copies = _joined(copies, one)
    if least == 0 and most == 1:
        return _one_of([none, one])
    return copies if most == least <= COPIES else _joined(copies, _ANYTHING) if least <= COPIES else _joined(_joined(copies, _ANYTHING), one)


def required(pattern: str):
    """The query that the lower-cased text of every match of ``pattern`` meets."""
    part = _of(parser.parse(pattern))
    if part.exact is not None:
        return of_strings(part.exact)
    return both(part.query, of_strings(part.begins), of_strings(part.ends))


def alternatives(query) -> set[frozenset[str]]:
    """The query as sets of trigrams, of which a text must hold one whole set; of ``ALL`` the empty set.

    Where conditions that each have alternatives would multiply to many sets, only
    the condition with the fewest is kept of them, which asks for less.
    """
    if query is ALL or isinstance(query, str):
        return {frozenset({query} - {ALL})}
    parts = sorted((alternatives(q) for q in query[1]), key=lambda sets: (len(sets), sorted(map(sorted, sets))))
    if query[0] == "or":
        found = set().union(*parts)
    else:
        found = parts[0]
        for more in parts[1:]:
            if all(any(a <= b for a in found) for b in more):
                found = more
            elif len(found) * len(more) <= MOST_SETS:
                found = {a | b for a in found for b in more}
    return {s for s in found if not any(other < s for other in found)}


def met(query, found: set[str]) -> bool:
    """Whether a text with these trigrams meets the query."""
    if query is ALL or isinstance(query, str):
        return query is ALL or query in found
    return (all if query[0] == "and" else any)(met(q, found) for q in query[1])
