"""Readers of file formats: the text spans of a file, each with its exact place in the file's UTF-8 bytes.

Spark routes a file by its name, deals files to tasks and reads each by one small scanner of its format; a scanner
yields (path, kind, start, end, value) in characters, and the span's raw text is what stands there. Paths are JSON
pointers where a format has keys, otherwise names with running numbers.

Defined cases: a null text has no spans; a byte order mark is skipped but counted in offsets; a text with NUL
characters is binary and has no spans; a file without a known name is read as paragraphs; broken files give the spans
up to where they break; repeated files are read alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fluent import read_fluent
from .script import script_spans
from .yaml import read_yaml

Span = tuple[str, str, int, int, str]

#: Format by the end of a lower-case file name, in order.
ROUTES = (
    (r"(^|/)dockerfile(\.[^/]*)?$|\.dockerfile$", "dockerfile"),
    (r"(^|/)\.[a-z]*ignore$|\.(sh|bash|zsh)$", "shell"),
    (r"\.(jsonl|ndjson)$", "jsonl"),
    (r"\.(json|jsonc|json5|arb|webmanifest|xcstrings)$", "json"),
    (r"\.ya?ml$", "yaml"),
    (r"\.(md|mdx|markdown)$", "markdown"),
    (r"\.(html?|xml|svg|vue|svelte|plist|xliff|ts_qt)$", "markup"),
    (r"\.pot?$", "po"),
    (r"\.toml$", "toml"),
    (r"\.ftl$", "fluent"),
    (r"\.(css|scss|less)$", "css"),
    (r"\.sql$", "sql"),
    (r"\.py$", "python"),
    (r"\.(m?[jt]sx?|cjs)$", "script"),
)


def route(file: Column) -> Column:
    """The format of a file by its name; ``text`` where no name is known."""
    out = F.lit("text")
    for pattern, kind in reversed(ROUTES):
        out = F.when(F.lower(file).rlike(pattern), kind).otherwise(out)
    return out


def segment(key: object) -> str:
    return "/" + str(key).replace("~", "~0").replace("/", "~1")


_JSON = re.compile(r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'|" r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"|//[^\n]*|/\*.*?\*/|[{}\[\],:]|[^\s{}\[\],:"/]+|\S', re.DOTALL)


def _unquoted(raw: str) -> str:
    try:
        return json.loads(f'"{raw}"', strict=False)
    except ValueError:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), raw, flags=re.DOTALL)


def read_json(text: str, base: str = "", at: int = 0) -> Iterator[Span]:
    """Keys and string values, by an explicit stack; comments and trailing commas are allowed."""
    stack: list[list] = []  # [is an object, key or index, a key is due]
    for m in _JSON.finditer(text):
        token, path = m[0], base + "".join(segment(s[1]) for s in stack)
        if token in ("{", "["):
            stack.append([token == "{", "" if token == "{" else 0, token == "{"])
        elif token in ("}", "]"):
            if not stack:
                return
            stack.pop()
        elif token == ",":
            if stack and stack[-1][0]:
                stack[-1][2] = True
            elif stack:
                stack[-1][1] += 1
        elif token == ":":
            if stack:
                stack[-1][2] = False
        elif token.startswith(("//", "/*")):
            yield base + "/comment", "comment", at + m.start(), at + m.end(), token
        elif bool(stack) and stack[-1][0] and stack[-1][2] and re.fullmatch(r"[^\W\d][\w$]*|\$[\w$]*", token):  # a bare key
            stack[-1][1] = token
            yield base + "".join(segment(s[1]) for s in stack), "key", at + m.start(), at + m.end(), token
        elif token[0] in "\"'" and len(token) > 1:
            value = _unquoted(token[1:-1] if token[0] == '"' else re.sub(r"\\(.)|\"", lambda x: x[0] if x[1] and x[1] != "'" else "'" if x[1] else '\\"', token[1:-1], flags=re.DOTALL))
            key = bool(stack) and stack[-1][0] and stack[-1][2]
            if key:
                stack[-1][1] = value
                path = base + "".join(segment(s[1]) for s in stack)
            yield path, "key" if key else "string", at + m.start() + 1, at + m.end() - 1, value


def read_jsonl(text: str) -> Iterator[Span]:
    at = 0
    for i, line in enumerate(text.split("\n")):
        yield from read_json(line, f"/{i}", at)
        at += len(line) + 1


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def read_markdown(text: str) -> Iterator[Span]:
    """Headings of both styles, list items, table cells and paragraphs (wrapped lines joined), and the YAML of front matter
    under /front; fences, indented code and rules are none."""
    at, fence, prose, n = 0, "", None, Counter()
    front = re.match(r"---[ \t]*\n(.*?\n)?---[ \t]*(?=\n|\Z)", text, re.DOTALL)
    if front and front[1]:
        yield from (("/front" + p, k, a + front.start(1), b + front.start(1), v) for p, k, a, b, v in read_yaml(front[1]))

    def close() -> Iterator[Span]:
        nonlocal prose
        if prose is not None:
            a, b = prose
            n["p"] += 1
            yield f"p[{n['p'] - 1}]", "prose-run", a, b, re.sub(r"\s*\n\s*", " ", text[a:b])
            prose = None

    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        if front and start < front.end():
            continue
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence):
                fence = ""
            continue
        if mark:
            yield from close()
            fence = mark[1]
            continue
        if not line.strip() or (line.startswith("    ") and prose is None):
            yield from close()
        elif m := re.match(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", line):
            yield from close()
            n["h"] += 1
            if m[2]:
                yield f"h{len(m[1])}[{n['h'] - 1}]", "prose-run", start + m.start(2), start + m.end(2), m[2]
        elif prose is not None and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", line)):  # what stands above is a heading
            a, b = prose
            prose, n["h"] = None, n["h"] + 1
            yield f"h{1 if m[1][0] == '=' else 2}[{n['h'] - 1}]", "prose-run", a, b, re.sub(r"\s*\n\s*", " ", text[a:b])
        elif re.match(r" {0,3}([-*_])([ \t]*\1){2,}[ \t]*$", line):
            yield from close()
        elif line.lstrip().startswith("|"):
            yield from close()
            for m in re.finditer(r"\|[ \t]*([^|\n]*[^|\s])", line):
                if not re.fullmatch(":?-+:?", m[1]):
                    n["cell"] += 1
                    yield f"cell[{n['cell'] - 1}]", "prose-run", start + m.start(1), start + m.end(1), m[1]
        else:
            m = re.match(r"[ \t]*(?:>[ \t]?)*(?:[-*+][ \t]+|\d+[.)][ \t]+)?", line)
            if m[0].strip():
                yield from close()
            end = start + len(line.rstrip())
            prose = (prose[0] if prose else start + m.end(), end) if end > start + m.end() else prose
    yield from close()


_TAG = re.compile(r"""<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|</(?P<close>[\w:.-]+)\s*>|<(?P<open>[\w:.-]+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def read_markup(text: str) -> Iterator[Span]:
    """Text runs, attributes, comments and character data, under the names of the open elements; entities are decoded."""
    import html

    stack, names, open_names, n, at = [], [], Counter(), Counter(), 0

    def run(a: int, b: int) -> Iterator[Span]:
        raw = text[a:b]
        if raw.strip():
            a, b = a + len(raw) - len(raw.lstrip()), b - len(raw) + len(raw.rstrip())
            path = f"{stack[-1] if stack else ''}/text[{n['text']}]"
            n["text"] += 1
            yield path, "prose-run", a, b, html.unescape(text[a:b])

    while m := _TAG.search(text, at):
        yield from run(at, m.start())
        at = m.end()
        if m["comment"] is not None:
            yield "comment", "comment", m.start("comment"), m.end("comment"), m["comment"]
        elif m["cdata"] is not None:
            yield "/".join(stack) + "/cdata", "prose-run", m.start("cdata"), m.end("cdata"), m["cdata"]
        elif m["close"]:
            if (name := m["close"].lower()) in open_names:
                while True:
                    stack.pop()
                    open_names[last := names.pop()] -= 1
                    if last == name:
                        break
                open_names = +open_names
        elif m["open"]:
            for a in _ATTR.finditer(m["attrs"]):
                g = next(g for g in (2, 3, 4) if a[g] is not None)
                off = m.start("attrs")
                yield f"{m['open']}/@{a[1]}", "attr", off + a.start(g), off + a.end(g), html.unescape(a[g])
            if m["open"].lower() not in _VOID and not m["attrs"].rstrip().endswith("/"):
                stack.append(m["open"])
                names.append(m["open"].lower())
                open_names[names[-1]] += 1
                if m["open"].lower() in ("script", "style"):  # what it holds is no markup
                    end = re.compile(rf"</{m['open']}\s*>", re.IGNORECASE).search(text, at)
                    start, at = at, end.start() if end else len(text)
                    if text[start:at].strip():
                        yield f"{m['open']}/code[{n['code']}]", "code", start, at, text[start:at]
                        n["code"] += 1
    yield from run(at, len(text))


def read_po(text: str) -> Iterator[Span]:
    """msgid, msgid_plural, msgstr and msgctxt of each entry, the lines of a string joined; comments. Obsolete entries are none."""
    entry, field, parts = -1, "", []
    line = re.compile(r'(?m)^[ \t]*(?:(#[^\n]*)|(msgctxt|msgid_plural|msgid|msgstr(?:\[\d+\])?)[ \t]+"([^"\\\n]*(?:\\.[^"\\\n]*)*)"|"([^"\\\n]*(?:\\.[^"\\\n]*)*)")')

    def joined() -> Iterator[Span]:
        if value := "".join(_unquoted(text[a:b]) for a, b in parts):
            first = next(a for a, b in parts if b > a) if not text[slice(*parts[0])] and len(parts) == 2 else parts[0][0]
            yield f"/{entry}/{field}", "string", first, parts[-1][1], value

    for m in line.finditer(text):
        if m[4] is not None:
            if field:
                parts.append(m.span(4))
            continue
        yield from joined() if parts else ()
        parts = []
        if m[1]:
            field = "" if m[1].startswith("#~") else field
            if not m[1].startswith("#~"):
                yield "/comment", "comment", m.start(1), m.end(1), m[1]
            continue
        entry += m[2] in ("msgctxt", "msgid") and not (m[2] == "msgid" and field == "msgctxt")
        field, parts = m[2], [m.span(3)]
    yield from joined() if parts else ()


_TOML = re.compile(r"""(?P<comment>\#[^\n]*)|\"\"\"(?P<long>(?:[^\\]|\\.)*?"{0,2})\"\"\"|'''(?P<raw3>.*?'{0,2})'''|"(?P<basic>[^"\\\n]*(?:\\.[^"\\\n]*)*)"|'(?P<raw>[^'\n]*)'|(?P<bare>[\w.+:-]+)|(?P<mark>[\[\]{}=,\n])|(?P<other>.)""", re.DOTALL)


def _toml_text(kind: str, raw: str) -> str:
    if kind in ("long", "raw3"):
        raw = raw.removeprefix("\n")
    if kind in ("raw", "raw3"):
        return raw
    if "\\" not in raw:
        return _unquoted(raw.replace('"', '\\"') if kind == "long" else raw)
    if "\n" in raw:  # an escaped line end
        raw = re.sub(r"(?<!\\)((?:\\\\)*)\\[ \t]*\n\s*", r"\1", raw)
    if "\\U" in raw or "\\e" in raw:
        raw = re.sub(r"\\(?:U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else "\x1b" if m[2] == "e" else m[0], raw, flags=re.DOTALL)
    return _unquoted(raw.replace('"', '\\"') if kind == "long" and '"' in re.sub(r"\\.", "", raw, flags=re.DOTALL) and "\\" not in raw else raw)


def read_toml(text: str) -> Iterator[Span]:
    """Strings of tables, arrays of tables, arrays and inline tables, and comments."""
    many: Counter[str] = Counter()  # tables of each array of tables
    table, keys, stack = "", [], []  # [its brackets, index or path so far]
    head, due = 0, True  # brackets of the header being read; a key is due

    def placed(parts: list[str]) -> str:
        """A header's path: below an array of tables it goes on in its last table."""
        path = ""
        for part in parts:
            path += segment(part)
            path += f"/{many[path] - 1}" if path in many else ""
        return path

    for m in _TOML.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "comment":
            yield "/comment", "comment", m.start(), m.end(), token
        elif kind in ("long", "raw3", "basic", "raw", "bare") and due:
            keys += [x for x in token.split(".") if x] if kind == "bare" else [_toml_text(kind, m[kind])]
        elif kind in ("long", "raw3", "basic", "raw"):
            a = m.start(kind) + (kind in ("long", "raw3") and m[kind].startswith("\n"))
            yield "".join(s[1] + (f"/{s[2]}" if s[0] == "[" else "") for s in stack), "string", a, m.end(kind), _toml_text(kind, m[kind])
        elif kind != "mark":
            continue
        elif token == "\n":
            if not [s for s in stack if s[0]]:
                stack, keys, due, head = [], [], True, 0
        elif token == "=" and due:
            stack.append(["", (table if not stack else "") + "".join(map(segment, keys)), 0])
            keys, due = [], False
        elif token == "[" and due and not stack:
            head += 1
        elif token == "]" and head:
            if keys:
                path = placed(keys[:-1]) + segment(keys[-1])
                if head > 1:
                    many[path] += 1
                table, keys = path + (f"/{many[path] - 1}" if path in many else ""), []
        elif token in "[{":
            stack.append([token, "", 0])
            due = token == "{"
        elif token in "]}":
            while stack and not stack.pop()[0]:
                pass
            due = False
        elif token == "," and stack:
            if not stack[-1][0]:
                stack.pop()
            if stack and stack[-1][0] == "[":
                stack[-1][2] += 1
            due = bool(stack) and stack[-1][0] == "{"


def _lexer(pattern: str, value: Callable[[str], str] = _unquoted) -> Callable[[str], Iterator[Span]]:
    """A reader of comments, strings and templates told by the groups of one pattern, which steps over all else."""
    token = re.compile(pattern, re.DOTALL | re.MULTILINE)

    def read(text: str) -> Iterator[Span]:
        n: Counter[str] = Counter()
        for m in token.finditer(text):
            if (kind := m.lastgroup) is None:
                continue
            name = kind.rstrip("0123456789")
            raw = m[kind]
            yield f"{name}[{n[name]}]", name, m.start(kind), m.end(kind), value(raw) if name == "string" else raw
            n[name] += 1

    return read


_QUOTED = r'"(?P<string1>(?:[^"\\\n]|\\.)*)"|' + r"'(?P<string2>(?:[^'\\\n]|\\.)*)'"

def read_script(text: str, file: str = "") -> Iterator[Span]:
    """Literals, JSX text and comments; see ``script``, which also tells what holds them."""
    return ((path, kind, a, b, value) for path, kind, a, b, value, _ in script_spans(text, file))


read_python = _lexer(r'(?P<comment>\#[^\n]*)|[rRbBuUfF]{0,2}"""(?P<docstring1>(?:[^\\]|\\.)*?)"""|' + r"[rRbBuUfF]{0,2}'''(?P<docstring2>(?:[^\\]|\\.)*?)'''|" + _QUOTED)
read_shell = _lexer(r"(?:^|(?<=\s))(?P<comment>\#(?!!)[^\n]*)|" + r'"(?P<string1>(?:[^"\\]|\\.)*)"|' + r"'(?P<string2>[^']*)'")
read_css = _lexer(r"(?P<comment1>/\*.*?\*/)|" + _QUOTED)
read_sql = _lexer(r"(?P<comment1>--[^\n]*)|(?P<comment2>/\*.*?\*/)|'(?P<string>(?:[^']|'')*)'|" + r'"[^"\n]*"', value=lambda raw: raw.replace("''", "'"))


def read_dockerfile(text: str) -> Iterator[Span]:
    """Comments, and the values of LABEL, by their keys."""
    for m in re.finditer(r"(?m)^[ \t]*(?:(#[^\n]*)|LABEL[ \t]+((?:[^\n\\]|\\\n|\\.)*))", text, re.IGNORECASE):
        if m[1]:
            yield "/comment", "comment", m.start(1), m.end(1), m[1]
            continue
        for p in re.finditer(r'([\w.-]+|"[^"\n]*")=(?:"((?:[^"\\]|\\.)*)"|([^\s"\\]+))', m[2]):
            g = 2 if p[2] is not None else 3
            yield "/LABEL" + segment(p[1].strip('"')), "string", m.start(2) + p.start(g), m.start(2) + p.end(g), _unquoted(p[2]) if g == 2 else p[3]


def read_text(text: str) -> Iterator[Span]:
    """Paragraphs, parted by blank lines."""
    for i, m in enumerate(re.finditer(r"[^\s](?:[^\n]|\n(?![ \t]*(?:\n|$)))*", text)):
        value = m[0].rstrip()
        yield f"p[{i}]", "prose-run", m.start(), m.start() + len(value), value


READERS: dict[str, Callable[[str], Iterator[Span]]] = {
    "json": read_json, "jsonl": read_jsonl, "yaml": read_yaml, "markdown": read_markdown, "markup": read_markup, "po": read_po, "toml": read_toml, "fluent": read_fluent,
    "script": read_script, "python": read_python, "shell": read_shell, "css": read_css, "sql": read_sql, "dockerfile": read_dockerfile, "text": read_text,
}

SPANS = "file string, format string, path string, kind string, start long, end long, line long, column long, raw string, value string"


class Places:
    """Byte, line and column of the characters of a text. Places that come in order are counted on from the last; a table
    of all is made for the first that doesn't."""

    def __init__(self, text: str):
        self.text, self.ascii, self.table = text, text.isascii(), None
        self.char = self.byte = self.line = 0
        self.end = -1  # the last line end before ``char``

    def _byte(self, a: int) -> int:
        if self.ascii:
            return a
        if self.table is None and a >= self.char:
            return self.byte + len(self.text[self.char : a].encode("utf-8", "surrogatepass"))
        if self.table is None:
            codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.table = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        return int(self.table[a])

    def of(self, a: int, b: int) -> tuple[int, int, int, int]:
        """Start and end in bytes, half open, and line and column from 1."""
        start, text = self._byte(a), self.text
        if a < self.char:
            self.line -= text.count("\n", a, self.char)
            self.end = text.rfind("\n", 0, a)
        elif (end := text.rfind("\n", self.char, a)) >= 0:
            self.line += text.count("\n", self.char, end + 1)
            self.end = end
        self.char, self.byte = a, start
        return start, self._byte(b), self.line + 1, a - self.end


def located(text: str, kind: str) -> list[tuple]:
    """(path, kind, start, end, line, column, raw, value) of a file's spans."""
    if "\x00" in text:
        return []
    skip, at = text.startswith("\ufeff"), Places(text)
    return [(path, k, *at.of(a + skip, b + skip), text[a + skip : b + skip], value) for path, k, a, b, value in READERS[kind](text[skip:])]


def spans(files: DataFrame) -> DataFrame:
    """The spans of ``files`` (file, text, and format where it isn't to be told by the name)."""
    kind = F.coalesce("format", route(F.col("file"))) if "format" in files.columns else route(F.col("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SPANS.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in SPANS.split(", ")]
        for batch in batches:
            for file, how, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(file, how, *x) for x in located(text, how)] if text else []
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), types, strict=True)], names)

    return files.select(F.col("file").cast("string"), kind.alias("format"), F.col("text").cast("string").alias("text")).mapInArrow(run, SPANS)
