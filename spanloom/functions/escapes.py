"""How each place in a file writes a text: one table of codecs, each of which can be undone or says that it can't."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cached_property

# What a syntax writes for what, in the order in which it is looked for.
_SLASH = {"\\": "\\\\", "\n": "\\n", "\r": "\\r"}
PAIRS = {
    "js-single": _SLASH | {"'": "\\'"},
    "js-double": _SLASH | {'"': '\\"'},
    "js-template": {"\\": "\\\\", "`": "\\`", "${": "\\${"},
    "po-string": _SLASH | {'"': '\\"', "\t": "\\t"},
    "toml-basic": _SLASH | {'"': '\\"', "\t": "\\t"},
    "yaml-double": _SLASH | {'"': '\\"', "\t": "\\t"},
    "yaml-single": {"'": "''"},
    "dockerfile-value": {"\\": "\\\\", '"': '\\"'},
    "py-triple-double": {"\\": "\\\\", '"': '\\"'},
    "py-triple-single": {"\\": "\\\\", "'": "\\'"},
    "sql-string": {"'": "''"},
    "ftl-pattern": {"{": '{"{"}', "}": '{"}"}'},
    "html-text": {"&": "&amp;", "<": "&lt;", ">": "&gt;"},
    "html-attr-double": {"&": "&amp;", '"': "&quot;", "<": "&lt;"},
    "html-attr-single": {"&": "&amp;", "'": "&#39;", "<": "&lt;"},
    "jsx-attr-double": {"&": "&amp;", '"': "&quot;", "<": "&lt;", ">": "&gt;"},
    "jsx-attr-single": {"&": "&amp;", "'": "&apos;", "<": "&lt;", ">": "&gt;"},
    "jsx-text": {"&": "&amp;", "{": "&#123;", "}": "&#125;", "<": "&lt;", ">": "&gt;"},
    "block-comment": {"*/": "*\\/"},
    "line-comment": {},
    "toml-literal": {},
    "plain": {},
}
#: What cannot stand in a syntax, however it is written.
BARRED = {"line-comment": r"[\r\n]", "toml-literal": r"['\r\n]", "sql-string": r"(?!)", "dockerfile-value": r"[\r\n]", "ftl-pattern": r"\r", "yaml-single": r"[\r\n]", "js-template": r"\r"}
#: Syntaxes that can write any character as \\uXXXX, and as a numbered entity.
UNICODE, ENTITY = ("js-single", "js-double", "js-template", "json-string"), ("html-text", "html-attr-double", "html-attr-single", "jsx-text", "jsx-attr-double", "jsx-attr-single")
_PLAIN_YAML = re.compile(r"(?![-?:,\[\]{}#&*!|>'\"%@`])(?!(?i:y|yes|n|no|true|false|on|off|null|~)$)(?![\d.+-][\d_.,eE+-]*$)(?!.*(:\s|\s#|[\r\n]))(?!.*:$)\S(.*\S)?", re.DOTALL)


@dataclass(frozen=True)
class Codec:
    pairs: tuple[tuple[str, str], ...]
    barred: str | None

    @cached_property
    def _write(self) -> tuple[dict[str, str], re.Pattern]:
        return dict(self.pairs), re.compile("|".join(re.escape(a) for a, _ in self.pairs) or r"(?!)")

    @cached_property
    def _read(self) -> tuple[dict[str, str], re.Pattern]:
        back = {b: a for a, b in self.pairs}
        return back, re.compile("|".join(re.escape(b) for b in sorted(back, key=len, reverse=True)) or r"(?!)")

    def encode(self, text: str) -> str:
        table, pattern = self._write
        return pattern.sub(lambda m: table[m[0]], text)

    def decode(self, text: str) -> str:
        table, pattern = self._read
        return pattern.sub(lambda m: table[m[0]], text)


CODECS = {name: Codec(tuple(pairs.items()), BARRED.get(name)) for name, pairs in PAIRS.items()}


def syntax_of(extractor: str, kind: str, quote: str) -> str | None:
    """The syntax that a site stands in, by its reader, its kind and the character before it; None if nothing is written there."""
    single = quote == "'"
    if kind == "comment":
        return {"script": "block-comment", "css": "block-comment", "markup": "block-comment"}.get(extractor, "line-comment")
    match extractor:
        case "script":
            return {"jsx-text": "jsx-text", "attr": "js-template" if quote == "`" else "jsx-attr-single" if single else "jsx-attr-double", "template": "js-template"}.get(kind, "js-single" if single else "js-double")
        case "json" | "jsonl":
            return "json-string"
        case "yaml":
            return "yaml-single" if single else "yaml-double" if quote == '"' else "yaml-block" if kind == "block-scalar" else "yaml-plain"
        case "toml":
            return "toml-literal" if single else "toml-basic"
        case "markup":
            return ("html-attr-single" if single else "html-attr-double") if kind == "attr" else "html-text"
        case "python":
            return ("py-triple-single" if single else "py-triple-double") if kind == "docstring" else "js-single" if single else "js-double"
    return {"po": "po-string", "fluent": "ftl-pattern", "sql": "sql-string", "dockerfile": "dockerfile-value", "css": "js-single" if single else "js-double", "markdown": "md-text", "text": "plain"}.get(extractor)


def encode(syntax: str, text: str, ascii_only: bool = False, indent: str = "", line_start: bool = True) -> str | None:
    """What to write for ``text``, None if the syntax can't hold it. ``indent``: of the lines of a block; ``line_start``: the
    site begins its line, so that marks of Markdown are to be told from text."""
    if syntax == "json-string":
        return json.dumps(text, ensure_ascii=ascii_only)[1:-1]
    if syntax == "yaml-block":
        return "\n".join(indent + line if line else line for line in text.split("\n"))
    if syntax == "yaml-plain":
        out = text if _PLAIN_YAML.fullmatch(text) else '"' + CODECS["yaml-double"].encode(text) + '"'
    elif syntax == "md-text":
        out = re.sub(r"^(\s*)([#>*+-]|\d+[.)])", r"\1\\\2", text) if line_start else text
    else:
        codec = CODECS[syntax]
        if codec.barred and re.search(codec.barred, text):
            return None
        out = codec.encode(text)
    if ascii_only and not out.isascii():
        if syntax in UNICODE:
            return json.dumps(out)[1:-1].replace('\\"', '"').replace("\\\\", "\\") if "\\" not in out else re.sub(r"[^\x00-\x7f]", lambda m: json.dumps(m[0])[1:-1], out)
        if syntax in ENTITY:
            return re.sub(r"[^\x00-\x7f]", lambda m: f"&#{ord(m[0])};", out)
    return out


def decode(syntax: str, raw: str, indent: str = "") -> str:
    """The text that ``raw`` stands for."""
    if syntax == "json-string":
        return json.loads(f'"{raw}"', strict=False)
    if syntax == "yaml-block":
        return "\n".join(line.removeprefix(indent) for line in raw.split("\n"))
    if syntax == "yaml-plain":
        return CODECS["yaml-double"].decode(raw[1:-1]) if raw[:1] == '"' else raw
    if syntax == "md-text":
        return re.sub(r"^(\s*)\\([#>*+-]|\d+[.)])", r"\1\2", raw)
    if syntax in UNICODE:
        raw = re.sub(r"(?<!\\)((?:\\\\)*)((?:\\u[0-9a-fA-F]{4})+)", lambda m: m[1] + json.loads(f'"{m[2]}"'), raw)
    if syntax in ENTITY:
        raw = re.sub(r"&#(\d+);", lambda m: m[0] if int(m[1]) < 128 else chr(int(m[1])), raw)
    return CODECS[syntax].decode(raw)
