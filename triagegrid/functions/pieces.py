"""Literal pieces of a pattern, at least one of which every match contains.

Looking for a piece in a text is far cheaper than running the pattern, so a pattern runs only where one of its pieces occurs.
The pieces are derived from the pattern itself; a pattern that guarantees none fails when this module loads.

Most pieces begin with a word, so the words of a text are cut down to their first letters once, those that no pattern knows are left out, and the
pieces of a pattern are looked for only where one of its beginnings is left.
"""
from __future__ import annotations

import re._constants as C
import re._parser as parser

from triagegrid.lexicon import GATED


#: Letters of a word that its key holds.
KEY = 3

# A piece is (text, at_start): whether every match has it where no word character stands before it.
Pieces = frozenset[tuple[str, bool]]


def _better(a: Pieces | None, b: Pieces | None) -> Pieces | None:
    """The choice of pieces that rules out more text: the one whose shortest piece is longer, then the smaller one."""
    if a is None or b is None:
        return a or b
    rank = lambda x: (min(len(p) for p, _ in x), -len(x))
    return a if rank(a) >= rank(b) else b


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _of_sequence(nodes, start: bool) -> tuple[Pieces | None, list[str] | None]:
    """(pieces, texts) of a sequence: ``texts`` lists all it can match, if that is a few plain strings.

    ``start``: no word character stands before it.
    """
    best, runs, at_start = None, [""], start
    plain = True

    def end_run(spaced: bool):
        nonlocal best, runs, at_start
        if all(runs):
            best = _better(best, frozenset((r, at_start) for r in runs))
        runs, at_start = [""], spaced

    for op, value in nodes:
        if (op, value) == (C.AT, C.AT_BOUNDARY) and runs == [""]:
            at_start = True
        behind = all((not _is_word(r[-1])) if r else at_start for r in runs)
        pieces, texts = _of_node(op, value, behind)
        if texts is not None and len(texts) * len(runs) <= 24:
            runs = [r + t for r in runs for t in texts]
        else:
            end_run(_spaces(op, value))
            plain = False
            best = _better(best, pieces)
    if plain:
        return (frozenset((r, start or at_start) for r in runs) if all(runs) else None), runs
    end_run(False)
    return best, None


def _spaces(op, value) -> bool:
    """Is this sure to end in a blank?"""
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        return value[0] > 0 and len(value[2]) == 1 and _spaces(*value[2][0])
    return op is C.IN and all(kind is C.CATEGORY and c is C.CATEGORY_SPACE for kind, c in value)


def _of_node(op, value, start: bool) -> tuple[Pieces | None, list[str] | None]:
    if op is C.LITERAL:
        return None, [chr(value).lower()]
    if op is C.IN and len(value) <= 4 and all(kind is C.LITERAL for kind, _ in value):
        return None, sorted({chr(c).lower() for _, c in value})
    if op is C.AT:
        return None, [""]
    if op is C.SUBPATTERN:
        return _of_sequence(value[-1], start)
    if op is C.BRANCH:
        parts = [_of_sequence(branch, start) for branch in value[1]]
        texts = [t for _, part in parts for t in part] if all(part is not None for _, part in parts) else None
        pieces = frozenset().union(*[p for p, _ in parts]) if all(p for p, _ in parts) else None
        return pieces, texts
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = value
        pieces, texts = _of_sequence(inner, start and most == 1)
        if (least, most) == (0, 1) and texts is not None:
            return None, ["", *texts]
        return (pieces if least else None), None
    return None, None


def _found(pattern: str) -> Pieces:
    found, _ = _of_sequence(parser.parse(pattern), False)
    if not found:
        raise ValueError(f"no literal piece is sure to occur in a match of {pattern!r}")
    return found


def _least(pieces) -> list[str]:
    """Without the pieces that hold another one, which add nothing."""
    return sorted(p for p in pieces if not any(q != p and q in p for q in pieces))


def pieces_of(pattern: str) -> list[str]:
    """Lower-case strings of which every match of the pattern, case ignored, contains at least one."""
    return _least({p for p, _ in _found(pattern)})


def key_of(piece: str, at_start: bool) -> str | None:
    """The first ``KEY`` letters, or all, of a word that every text with this piece has; None if the piece is no sure beginning of a word."""
    begin = 0
    for i in range(len(piece) + 1):
        if i == len(piece) or not _is_word(piece[i]):
            word, known = piece[begin:i], at_start if begin == 0 else True
            if word and known and (len(word) >= KEY or i < len(piece)):
                return word[:KEY]
            begin = i + 1
    return None


PIECES = {pattern: pieces_of(pattern) for pattern in GATED}
#: Beginnings of words one of which a text with a match has, and the pieces that may stand inside a word, which need no such beginning.
KEYS = {pattern: sorted({key for p, at_start in _found(pattern) if (key := key_of(p, at_start)) is not None}) for pattern in GATED}
KEYLESS = {pattern: _least({p for p, at_start in _found(pattern) if key_of(p, at_start) is None}) for pattern in GATED}
