"""YAML: block mappings and sequences by columns, flow collections by a stack, scalars of all styles over any lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

Span = tuple[str, str, int, int, str]

_LINE = re.compile(r"(?P<indent> *)(?P<dash>(?:-(?:[ \t]+|(?=\n|\Z)))*)")
_KEY = re.compile(r"""(?P<props>(?:[&!][^\s,\[\]{}]*[ \t]+)*)(?P<key>"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'(?:[^'\n]|'')*'|[^\s#:'"\[\]{},&*!|>%@`-](?:[^:#\n]|:(?=\S)|(?<=\S)#)*?|-(?=\S)(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?)[ \t]*:(?:[ \t]+|(?=\n|\Z))""")
_PROPS = re.compile(r"(?:[&!][^\s,\[\]{}]*(?:[ \t]+|(?=\n|\Z)))*")
_BLOCK = re.compile(r"[|>][-+0-9]*[ \t]*(?:#[^\n]*)?(?=\n|\Z)")
_DOUBLE, _SINGLE = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"', re.DOTALL), re.compile(r"'((?:[^']|'')*)'")
_PLAIN = re.compile(r"(?:[^#\n]|(?<=\S)#)*")
_FLOW = re.compile(r"""(?P<space>\s+)|(?P<comment>\#[^\n]*)|"(?P<double>[^"\\]*(?:\\.[^"\\]*)*)"|'(?P<single>(?:[^']|'')*)'|(?P<mark>[\[\]{},])|(?P<colon>:(?=[\s,\[\]{}]|\Z))|(?P<prop>[&!*][^\s,\[\]{}]*)|(?P<plain>(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|\Z)|(?<=\S)\#)(?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}]|\Z)|(?<=\S)\#|\n\s*(?=[^\s,\[\]{}:\#]))*)|(?P<other>.)""", re.DOTALL)
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_HALVES = re.compile("[\ud800-\udfff]")
_NAMED = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


def _segment(key: object) -> str:
    return "/" + str(key).replace("~", "~0").replace("/", "~1")


def folded(raw: str, edges: bool = True) -> str:
    """Lines of a scalar as one: a line end becomes a space, blank lines between become line ends. ``edges``: white space at
    the very ends is the scalar's own."""
    lines = raw.split("\n")
    if len(lines) == 1:
        return raw if edges else raw.strip()
    out, blank = lines[0].rstrip(" \t"), 0
    for i, line in enumerate(lines[1:], 1):
        body = line.lstrip(" \t") if i == len(lines) - 1 else line.strip(" \t")
        if not body and i < len(lines) - 1:
            blank += 1
            continue
        joined = out.endswith("\\") and (len(out) - len(out.rstrip("\\"))) % 2 == 1  # an escaped line end
        out = (out[:-1] if joined and not blank else out) + ("\n" * blank or ("" if joined else " ")) + body
        blank = 0
    return out if edges else out.strip()


def double_quoted(raw: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return (chr(int(code, 16)) if int(code, 16) < 0x110000 else m[0]) if code else _NAMED.get(m[4], m[4])

    text = _ESCAPE.sub(one, folded(raw))
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if _HALVES.search(text) else text


def single_quoted(raw: str) -> str:
    return folded(raw.replace("''", "'"))


def _flow(text: str, at: int, base: str) -> tuple[list[Span], int]:
    """Spans of the flow collection that begins at ``at``, and where it ends."""
    stack: list[list] = []  # [is a mapping, key or index, a key is due]
    out: list[Span] = []
    for m in _FLOW.finditer(text, at):
        kind, token = m.lastgroup, m[0]
        path = base + "".join(_segment(s[1]) for s in stack)
        if kind == "comment":
            out.append(("/comment", "comment", m.start(), m.end(), token))
        elif kind == "mark" and token in "[{":
            stack.append([token == "{", "" if token == "{" else 0, token == "{"])
        elif kind == "mark" and token in "]}":
            stack.pop()
            if not stack:
                return out, m.end()
        elif kind == "mark":
            if stack[-1][0]:
                stack[-1][2] = True
            else:
                stack[-1][1] += 1
        elif kind == "colon":
            stack[-1][2] = False
        elif kind in ("double", "single", "plain"):
            raw = m[kind] if kind != "plain" else m[kind].rstrip()
            value = double_quoted(raw) if kind == "double" else single_quoted(raw) if kind == "single" else folded(raw, edges=False)
            key = stack[-1][0] and stack[-1][2]
            if key:
                stack[-1][1] = value
                path = base + "".join(_segment(s[1]) for s in stack)
            out.append((path, "key" if key else "scalar" if kind == "plain" else "string", m.start(kind), m.start(kind) + len(raw), value))
    return out, len(text)


def read_yaml(text: str) -> Iterator[Span]:
    """Keys, scalars of all styles and comments. Aliases have no text of their own; a block scalar's value is its raw lines."""
    stack: list[list] = []  # [column, segment]
    counts: Counter[str] = Counter()
    at = 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        if not line.strip() or re.match(r"(?:---|\.\.\.)(?:\s|$)|%", line):
            if line.startswith(("---", "...")):
                stack, counts = [], Counter()
                rest = line[3:].lstrip()
                if not rest or rest.startswith("#"):
                    at = stop + 1
                    continue
                at += len(line) - len(rest)
                line = rest
            else:
                at = stop + 1
                continue
        m = _LINE.match(text, at)
        indent, p = len(m["indent"]), m.end()
        if text.startswith("#", p):
            yield "/comment", "comment", p, stop, text[p:stop]
            at = stop + 1
            continue
        for dash in re.finditer(r"-[ \t]*", m["dash"]):
            column = indent + dash.start()
            while stack and (stack[-1][0] > column or (stack[-1][0] == column and isinstance(stack[-1][1], int))):
                stack.pop()  # a key at the same column is the sequence's own
            parent = "".join(_segment(s[1]) for s in stack)
            stack.append([column, counts[parent]])
            counts[parent] += 1
        column = p - at
        if k := _KEY.match(text, p):
            while stack and stack[-1][0] >= column:
                stack.pop()
            raw = k["key"]
            a = k.start("key") + raw.startswith(("'", '"'))
            key = double_quoted(raw[1:-1]) if raw[0] == '"' else single_quoted(raw[1:-1]) if raw[0] == "'" else raw
            stack.append([column, key])
            yield "".join(_segment(s[1]) for s in stack), "key", a, a + len(raw) - 2 * raw.startswith(("'", '"')), key
            p = k.end()
        path, least = "".join(_segment(s[1]) for s in stack), stack[-1][0] if stack else -1
        p = _PROPS.match(text, p).end()
        at = stop + 1
        if b := _BLOCK.match(text, p):
            end = at = min(b.end() + 1, len(text))
            first = end
            while at < len(text):
                nl = text.find("\n", at)
                nl = len(text) if nl < 0 else nl
                row = text[at:nl]
                if row.strip() and len(row) - len(row.lstrip(" ")) <= least:
                    break
                at = nl + 1
                end = nl if row.strip() else end
            if end > first:
                yield path, "block-scalar", first, end, text[first:end]
        elif text.startswith(("[", "{"), p):
            found, end = _flow(text, p, path)
            yield from found
            at = text.find("\n", end) + 1 or len(text)
        elif (q := _DOUBLE.match(text, p)) or (q := _SINGLE.match(text, p)):
            yield path, "string", q.start(1), q.end(1), double_quoted(q[1]) if text[p] == '"' else single_quoted(q[1])
            at = text.find("\n", q.end()) + 1 or len(text)
        elif p < stop and text[p] not in "#*":
            end = p + len(_PLAIN.match(text, p, stop)[0].rstrip())
            commented = "#" in text[end:stop]
            while at < len(text) and not commented and not k or at < len(text) and not commented and end > p:
                nl = text.find("\n", at)
                nl = len(text) if nl < 0 else nl
                row = text[at:nl]
                if row.strip() and (len(row) - len(row.lstrip(" ")) <= least or row.lstrip().startswith("#") or _KEY.match(row.lstrip()) or re.match(r"(?:---|\.\.\.)(?:\s|$)", row)):
                    break
                if row.strip():
                    lead = at + len(row) - len(row.lstrip())
                    end = lead + len(_PLAIN.match(text, lead, nl)[0].rstrip())
                    commented = "#" in text[end:nl]
                at = nl + 1
            if end > p:
                yield path, "scalar", p, end, folded(text[p:end], edges=False)
