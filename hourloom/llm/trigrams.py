"""Which trigrams a regular expression's matches must have.

A query is True (nothing is known), a trigram (an integer of three bytes, letters A-Z lowered), or ("all" | "any", queries).
A text that doesn't satisfy the query has no match; one that does may have.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser as parser

Query = bool | int | tuple[str, tuple]

#: Up to so many strings are followed through a part of an expression; beyond, the part is cut there.
STRINGS = 64
MEMBERS = 16


def code(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def _both(kind: str, parts: list[Query]) -> Query:
    """All or any of the queries, flattened."""
    flat: list[Query] = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    nothing = kind == "any"  # True among alternatives: nothing is known; True among demands: no demand
    if nothing and any(p is True for p in flat):
        return True
    kept = tuple(dict.fromkeys(p for p in flat if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else (kind, kept)


def _of_strings(strings: set[str]) -> Query:
    """The query of a text that contains at least one of the strings."""
    options = []
    for s in sorted(strings):
        b = s.encode("utf-8", "surrogatepass").lower()
        options.append(_both("all", [code(b[i : i + 3]) for i in range(len(b) - 2)]))
    return _both("any", options)


def _members(items: list, flags: int) -> set[str] | None:
    """The characters of a class, if they are few."""
    found: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL:
            found.add(chr(arg))
        elif op is K.RANGE and arg[1] - arg[0] < MEMBERS:
            found |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return _case(found, flags) if len(found) <= MEMBERS else None


def _case(chars: set[str], flags: int) -> set[str] | None:
    """Characters as the index has them: bytes of A-Z lowered. Without ASCII rules, other characters may match in another case."""
    if flags & re.IGNORECASE and not flags & re.ASCII:
        return None
    return {c.lower() if c.isascii() else c for c in chars}


def _analyse(items, flags: int) -> tuple[set[str] | None, Query]:
    """(all strings that the items match, if few; else None, and a query of what matches them)."""
    now: set[str] = {""}
    known: list[Query] = []
    cut = False
    for op, arg in items:
        strings, query = _one(op, arg, flags)
        if strings is not None and len(now) * len(strings) <= STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        known += [_of_strings(now), query]
        cut, now = True, strings if strings is not None else {""}
    if not cut:
        return now, True
    return None, _both("all", [*known, _of_strings(now)])


def _one(op, arg, flags: int) -> tuple[set[str] | None, Query]:
    if op is K.LITERAL:
        return _case({chr(arg)}, flags), True
    if op is K.IN:
        return (None if arg and arg[0][0] is K.NEGATE else _members(arg, flags)), True
    if op is K.SUBPATTERN:
        _, add, remove, inner = arg
        return _analyse(inner, (flags | add) & ~remove)
    if op is K.BRANCH:
        made = [_analyse(branch, flags) for branch in arg[1]]
        if all(s is not None for s, _ in made) and sum(len(s) for s, _ in made) <= STRINGS:
            return set().union(*(s for s, _ in made)), True
        return None, _both("any", [q if s is None else _of_strings(s) for s, q in made])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _analyse(inner, flags)
        if strings is not None and most == 1:
            return (strings if least else strings | {""}), True
        if strings is not None and least == most and len(strings) ** least <= STRINGS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in strings}
            return out, True
        return None, True if not least else query if strings is None else _of_strings(strings)
    if op is K.ATOMIC_GROUP:
        return _analyse(arg, flags)
    if op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):
        return {""}, True  # takes no character
    return None, True


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The Boolean trigram query of a regular expression; True if it has no trigram that every match must contain."""
    parsed = parser.parse(pattern, flags)
    strings, query = _analyse(parsed, parsed.state.flags)
    return query if strings is None else _of_strings(strings)


def trigrams_of(query: Query) -> set[int]:
    """All trigrams that a query mentions."""
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(trigrams_of, query[1]))


def alternatives(query: Query, limit: int = 512) -> list[frozenset[int]]:
    """Sets of trigrams: whatever satisfies the query has all of one set. Demands that would make too many sets are left out."""
    if query is True:
        return [frozenset()]
    if isinstance(query, int):
        return [frozenset([query])]
    parts = [alternatives(q, limit) for q in query[1]]
    if query[0] == "any":
        return list(dict.fromkeys(a for p in parts for a in p))
    out = [frozenset()]
    for p in sorted(parts, key=len):
        if len(out) * len(p) <= limit:
            out = list(dict.fromkeys(a | b for a in out for b in p))
    return out
