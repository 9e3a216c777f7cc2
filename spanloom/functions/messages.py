"""Grammars of messages with arms: ICU (``{n, plural, one {..} other {..}}``) and Fluent (``{ $n -> [one] .. *[other] .. }``).

Both match all braces of a text once, with a stack, and then read arguments outside in from a list of stretches still
to be read, so that nesting of any depth takes neither recursion nor a second look at a character.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from .vocab import PLURAL_ORDER


@dataclass(slots=True, frozen=True)
class Arm:
    """One arm of an argument. Offsets in characters: those of the argument with its braces, and of the arm's body."""

    argument: int  # number of the argument, outside in
    parent: int  # number of the arm that holds the argument; -1 for none
    depth: int
    start: int
    end: int
    name: str
    type: str
    offset: int | None
    selector: str
    default: bool
    body_start: int
    body_end: int

    @property
    def category(self) -> str | None:
        return self.selector if self.selector in PLURAL_ORDER and self.type != "select" else None


@dataclass(slots=True)
class Scan:
    arms: list[Arm]
    placeholders: list[str]
    ok: bool  # all braces match


# a doubled apostrophe; one before a mark, up to the next single one; a brace
_ICU = re.compile(r"''|'[{}#|](?:[^']|'')*(?:'|\Z)|[{}]")
_ARGUMENT = re.compile(r"\{\s*((?a:[\w.$-]+))\s*,\s*(plural|selectordinal|select)\s*,")
_OFFSET = re.compile(r"\s*offset:\s*(-?\d+)")
_SELECTOR = re.compile(r"\s*([^\s{}]+)\s*(?=\{)")
_FLUENT = re.compile(r'"(?:[^"\\\n]|\\.)*"|[{}]')
_VARIANT = re.compile(r"(\*?)[ \t]*\[[ \t]*(-?\d+(?:\.\d+)?|[A-Za-z][\w-]*)[ \t]*\]")
_FUNCTION = re.compile(r"[A-Z][A-Z0-9_-]*\s*\(")


class _Braces:
    """Braces of a text outside quotes: ``close[open]``, and the opening ones in order."""

    def __init__(self, text: str, tokens: re.Pattern):
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in tokens.finditer(text):
            if m[0] == "{":
                stack.append(m.start())
            elif m[0] == "}" and stack:
                self.close[stack.pop()] = m.start()
        self.opens = sorted(self.close)
        #: What is read: all, or up to the outermost brace that never closes.
        self.ok, self.end = not stack, stack[0] if stack else len(text)

    def within(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Outermost pairs of a stretch."""
        at = start
        while (k := bisect_left(self.opens, at)) < len(self.opens) and (open_ := self.opens[k]) < end:
            at = self.close[open_] + 1
            yield open_, self.close[open_]


def looks_icu(text: str) -> bool:
    return bool(_ARGUMENT.search(text))


def scan_icu(text: str) -> Scan:
    """Arms of plural, selectordinal and select arguments. An apostrophe is text but before ``{ } # |``."""
    braces = _Braces(text, _ICU)
    arms: list[Arm] = []
    placeholders: list[tuple[int, str]] = []
    todo, arguments = [(0, braces.end, 0, -1)], 0
    for start, end, depth, parent in todo:
        for open_, close in braces.within(start, end):
            m = _ARGUMENT.match(text, open_)
            found, offset, at = [], None, m.end() if m else close
            while at < close:
                if not found and (o := _OFFSET.match(text, at, close)):
                    offset, at = int(o[1]), o.end()
                elif (s := _SELECTOR.match(text, at)) and s.end() in braces.close and braces.close[s.end()] < close:
                    found.append((s[1], s.end() + 1, braces.close[s.end()]))
                    at = found[-1][2] + 1
                else:
                    break
            if not found:
                if inner := text[open_ + 1 : close].strip():
                    placeholders.append((open_, inner.split(",")[0].strip()))
                continue
            for selector, a, b in found:
                todo.append((a, b, depth + 1, len(arms)))
                arms.append(Arm(arguments, parent, depth, open_, close + 1, m[1], m[2], offset, selector, selector == "other", a, b))
            arguments += 1
    return Scan(arms, [p for _, p in sorted(placeholders)], braces.ok)


def looks_fluent(text: str) -> bool:
    return "->" in text and bool(re.search(r"\*[ \t]*\[", text))


def scan_fluent(text: str) -> Scan:
    """Arms of select expressions; ``default`` is the one with a star. Quoted literals may hold braces."""
    braces = _Braces(text, _FLUENT)
    arms: list[Arm] = []
    placeholders: list[tuple[int, str]] = []
    todo, arguments, ok = [(0, braces.end, 0, -1)], 0, braces.ok
    for start, end, depth, parent in todo:
        for open_, close in braces.within(start, end):
            holes = [*braces.within(open_ + 1, close)]
            outside = _outside(text, open_ + 1, close, holes)
            arrow = outside.find("->")
            if arrow < 0:
                placeholders.append((open_, text[open_ + 1 : close].strip()))
                continue
            selector = text[open_ + 1 : open_ + 1 + arrow].strip()
            kind = "variable" if selector.startswith("$") else "function" if _FUNCTION.match(selector) else "reference"
            heads = [*_VARIANT.finditer(outside, arrow + 2)]
            ok = ok and sum(bool(m[1]) for m in heads) == 1
            for k, m in enumerate(heads):
                a, b = open_ + 1 + m.end(), open_ + 1 + (heads[k + 1].start() if k + 1 < len(heads) else len(outside))
                todo.append((a, b, depth + 1, len(arms)))
                arms.append(Arm(arguments, parent, depth, open_, close + 1, selector, kind, None, m[2], bool(m[1]), a, b))
            arguments += bool(heads)
    return Scan(arms, [p for _, p in sorted(placeholders)], ok)


def _outside(text: str, start: int, end: int, holes: Sequence[tuple[int, int]]) -> str:
    """A stretch with what its inner braces hold blanked."""
    parts, at = [], start
    for a, b in holes:
        parts += [text[at:a], "\0" * (b + 1 - a)]
        at = b + 1
    return "".join([*parts, text[at:end]])


def write_icu(name: str, kind: str, offset: int | None, bodies: Mapping[str, str], order: Sequence[str] = PLURAL_ORDER) -> str:
    """An argument of new arms: exact numbers by value first, as they would be shadowed, then those of ``order``, then others."""
    exact = sorted((s for s in bodies if s.startswith("=")), key=lambda s: float(s[1:]))
    rest = [s for s in order if s in bodies] + [s for s in bodies if s not in order and not s.startswith("=")]
    head = f"{{{name}, {kind}, " + (f"offset:{offset} " if offset is not None else "")
    return head + " ".join(f"{s} {{{bodies[s]}}}" for s in [*exact, *rest]) + "}"


def write_fluent(selector: str, bodies: Mapping[str, str], default: str, order: Sequence[str] = PLURAL_ORDER, indent: str = "    ") -> str:
    """A select expression of new arms, one a line; ``default`` gets the star and must be among them."""
    if default not in bodies:
        raise ValueError(f"the default arm {default!r} has no text")
    keys = [s for s in bodies if s not in order] + [s for s in order if s in bodies]
    lines = [f"{indent[:-1]}{'*' if k == default else ' '}[{k}] {bodies[k].strip()}" for k in keys]
    return f"{{ {selector} ->\n" + "\n".join(lines) + f"\n{indent[:-4]}}}"
