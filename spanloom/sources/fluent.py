"""Fluent resources, line by line: entries, their values and attributes, and the lines that are neither (junk).

A value goes on over indented lines, and over any line while a brace of it is open, so that a select expression may close
at the margin. Junk is told and stepped over: the entries after it are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_ENTRY = re.compile(r"(-?[A-Za-z][\w-]*)[ ]*=[ ]*")
_ATTRIBUTE = re.compile(r"[ ]+\.([A-Za-z][\w-]*)[ ]*=[ ]*")
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"')


@dataclass(slots=True)
class Pattern:
    name: str
    start: int
    end: int
    text: str  # without the indent of its lines


@dataclass(slots=True)
class Entry:
    kind: str  # message term comment junk
    id: str
    start: int
    end: int
    patterns: list[Pattern] = field(default_factory=list)  # the value, if any, under an empty name, then attributes


def _open(line: str) -> int:
    plain = _LITERAL.sub("", line)
    return plain.count("{") - plain.count("}")


def entries(text: str) -> Iterator[Entry]:
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    i, entry = 0, None
    while i < len(lines):
        start, line = lines[i]
        head = _ENTRY.match(line)
        attribute = _ATTRIBUTE.match(line) if entry and not head else None
        if not (head or attribute):
            if entry:
                yield entry
                entry = None
            if line.strip() and (line[0] == "#" or not line[0].isspace()):
                yield Entry("comment" if line[0] == "#" else "junk", "", start, start + len(line))
            i += 1
            continue
        if head:
            if entry:
                yield entry
            entry = Entry("term" if head[1].startswith("-") else "message", head[1], start, start)
        m = head or attribute
        depth, last, blank = _open(line[m.end() :]), i, []
        parts = [line[m.end() :].rstrip()]
        for k in range(i + 1, len(lines)):
            more = lines[k][1]
            if not more.strip():
                blank.append("")
                continue
            if depth <= 0 and (not more[0].isspace() or _ATTRIBUTE.match(more)):
                break
            parts += [*blank, more.strip()]
            blank, last, depth = [], k, depth + _open(more)
        value = "\n".join(parts).strip("\n")
        entry.end = lines[last][0] + len(lines[last][1].rstrip())
        if value.strip():
            begin = start + m.end() if parts[0] else next(a + len(x) - len(x.lstrip()) for a, x in lines[i + 1 : last + 1] if x.strip())
            entry.patterns.append(Pattern("" if head else attribute[1], begin, entry.end, value))
        i = last + 1
    if entry:
        yield entry


def read_fluent(text: str) -> Iterator[tuple[str, str, int, int, str]]:
    """Comments, and the values of messages, terms and attributes, as spans."""
    for e in entries(text):
        if e.kind == "comment":
            yield "/comment", "comment", e.start, e.end, text[e.start : e.end]
        for p in e.patterns:
            yield f"/{e.id}" + (f"/{p.name}" if p.name else ""), "message", p.start, p.end, p.text
