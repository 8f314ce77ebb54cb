"""Which trigrams a text must hold for a regular expression to match in it."""

from __future__ import annotations

from itertools import product
from re import _constants as K
from re import _parser as P

#: A gap between literal pieces.
GAP = None
_MOST = 512


def _join(a: tuple, b: tuple) -> tuple:
    if a and b and a[-1] is not GAP and b[0] is not GAP:
        return (*a[:-1], a[-1] + b[0], *b[1:])
    return a + b


def _bare(alt: tuple) -> tuple:
    """`alt` without inner pieces too short for a trigram."""
    out: list = []
    for i, piece in enumerate(alt):
        if piece is not GAP and len(piece) < 3 and 0 < i < len(alt) - 1:
            piece = GAP
        if piece is not GAP or not out or out[-1] is not GAP:
            out.append(piece)
    return tuple(out)


def _pieces(seq) -> list[tuple]:
    """Alternatives of `seq`, each a row of literal pieces and gaps."""
    alts: list[tuple] = [()]
    for op, arg in seq:
        if op is K.LITERAL:
            options = [(chr(arg).lower(),)] if arg < 128 else [(GAP,)]
        elif op is K.SUBPATTERN:
            options = _pieces(arg[3])
        elif op is K.BRANCH:
            options = [p for branch in arg[1] for p in _pieces(branch)]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, inner = arg
            options = [(GAP,)] if low == 0 else _pieces(inner) if low == high == 1 else [_join(p, (GAP,)) for p in _pieces(inner)]
        elif op is K.ATOMIC_GROUP:
            options = _pieces(arg)
        elif op is K.AT or op is K.ASSERT_NOT:
            options = [()]
        elif op is K.IN and all(o is K.LITERAL and a < 128 for o, a in arg) and len(arg) <= 3:
            options = [(c,) for c in sorted({chr(a).lower() for _, a in arg})]
        else:
            options = [(GAP,)]
        alts = list(dict.fromkeys(_bare(_join(a, o)) for a, o in product(alts, dict.fromkeys(map(_bare, options)))))
        if len(alts) > _MOST:
            raise ValueError("too many alternatives: group the pattern otherwise")
    return alts


def required_trigrams(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case ASCII trigrams: a text that matches `pattern` holds all of one set at least.

    Optional parts ask for nothing. Raises where some alternative asks for no trigram, as its postings
    would be all texts.
    """
    clauses = {frozenset(p[i : i + 3] for p in alt if p is not GAP for i in range(len(p) - 2)) for alt in _pieces(P.parse(pattern))}
    if frozenset() in clauses:
        raise ValueError(f"an alternative of {pattern!r} requires no trigram")
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)
