"""A text that a pattern matches, made from the pattern itself."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

CLASSES = {C.CATEGORY_DIGIT: "7", C.CATEGORY_WORD: "w", C.CATEGORY_SPACE: " ", C.CATEGORY_NOT_DIGIT: "x", C.CATEGORY_NOT_WORD: "-", C.CATEGORY_NOT_SPACE: "x"}


def _one_of(items) -> str:
    if items[0][0] is C.NEGATE:
        barred = _parser_set(items[1:])
        return next(c for c in "xa1 -_;" if not barred(c))
    kind, value = items[0]
    if kind is C.LITERAL:
        return chr(value)
    return chr(value[0]) if kind is C.RANGE else CLASSES[value]


def _parser_set(items):
    def holds(c: str) -> bool:
        for kind, value in items:
            if kind is C.LITERAL and ord(c) == value or kind is C.RANGE and value[0] <= ord(c) <= value[1]:
                return True
            if kind is C.CATEGORY and re.match({C.CATEGORY_DIGIT: r"\d", C.CATEGORY_WORD: r"\w", C.CATEGORY_SPACE: r"\s"}.get(value, r"(?!)"), c):
                return True
        return False

    return holds


def _made(tree, pick: int, groups: dict) -> str:
    out = ""
    for op, arg in tree:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.NOT_LITERAL:
            out += "x" if arg != ord("x") else "y"
        elif op is C.ANY:
            out += "x"
        elif op is C.IN:
            out += _one_of(arg)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += _made(arg[2], pick, groups) * arg[0]
        elif op is C.SUBPATTERN:
            made = _made(arg[-1], pick, groups)
            groups[arg[0]] = made
            out += made
        elif op is C.BRANCH:
            out += _made(arg[1][pick % 4 % len(arg[1])], pick, groups)
        elif op is C.GROUPREF:
            out += groups[arg]
        elif op is C.AT and arg is C.AT_BOUNDARY and pick > 3 and re.match(r"\w", out[-1:]):
            out += " "
    return out


def example(pattern: str, flags: int = re.I | re.S | re.M | re.A) -> str:
    """The shortest-looking text found; alternatives and surroundings are tried until the pattern matches."""
    tree, compiled = _parser.parse(pattern, flags), re.compile(pattern, flags)
    for before in ("", " ", "x", "x ", "new "):
        for after in ("", " ", ";", "x", " x;", ")"):
            for pick in range(8):
                text = before + _made(tree, pick, {}) + after
                if compiled.search(text):
                    return text
    raise ValueError(f"no example for {pattern}")
