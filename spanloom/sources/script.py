"""Scripts (JavaScript, TypeScript, JSX): literals, JSX text and comments with the facts of their container.

Two passes. The first is a pushdown lexer: a stack of modes (code, template, its holes, JSX tags, JSX children, JSX
expressions) tells what a character begins, and whether the token before ends an operand tells division from a regular
expression and ``<`` from JSX. A template is one token, holes and all, however deep it is nested. The second pass walks
the tokens with a stack of containers (calls, objects, arrays, blocks, elements) and writes down for each literal what
holds it: attribute, element, call, tag, symbol, key, comparison, storage, enumeration, branch.

Defined cases: an unterminated string or comment ends at its line or the file and gives no span; text that fits no
mode is stepped over; unbalanced brackets close what is open; JSX is read in .js, .jsx, .mjs, .cjs and .tsx files.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

# What makes an argument a storage key, a member test or an enumeration, and a file a test.
PERSIST_METHODS = frozenset("getItem setItem removeItem open create match delete".split())
PERSIST_RECEIVERS = frozenset("localStorage sessionStorage caches indexedDB storage alarms".split())
MEMBERSHIP = frozenset("includes startsWith endsWith hasOwn has indexOf".split())
SCHEMA_RECEIVERS, SCHEMA_METHODS = frozenset("z v yup".split()), frozenset("enum literal picklist oneOf".split())
COMPARISONS = frozenset("=== !== == !=".split())
TEST_FILE = re.compile(r"(\.|/)(test|spec)\.[cm]?[jt]sx?$|(^|/)(__tests__|e2e)/")
#: Literals of a hole that are so short, two or more, spell an ending and not a word.
ENDING = 3

_CODE = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*')|(?P<word>[@#]?[^\W\d][\w$]*|[@#]?\$[\w$]*)|(?P<number>\d[\w.]*|\.\d[\w]*)"""
    r"""|(?P<tick>`)|(?P<op>=>|===|!==|==|!=|\?\.(?!\d)|\?\?=?|\.\.\.|&&=?|\|\|=?|\+\+|--|[-+*/%&|^<>]=|\*\*|.)""",
    re.DOTALL,
)
_BLANK = re.compile(r"[ \n]+")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPEN = re.compile(r"<\s*(?:(?P<name>[^\W\d][\w$.:-]*)\s*)?")
_TEMPLATE_STOP, _CHILD_STOP, _LETTER = re.compile(r"`|\$\{|\\"), re.compile(r"[<{]"), re.compile(r"[^\W\d_]")
_TAG = re.compile(r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<end>/\s*>)|(?P<gt>>)|(?P<name>[^\W\d][\w$.:-]*)|(?P<string>"[^"]*"|'[^']*')|(?P<op>.)""", re.DOTALL)
_CLOSE = re.compile(r"</\s*([^\W\d][\w$.:-]*)?\s*>")
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.DOTALL)
_HALVES = re.compile("[\ud800-\udfff]")
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": ""}

#: Words after which an operand is to come.
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends default export import as satisfies from keyof".split())
_CONTROL = frozenset("if while for with switch catch".split())
_STATEMENT = frozenset("const let var function class return if for while switch export import type interface enum throw try do async break continue".split())


def unescaped(raw: str) -> str:
    """What the escapes of a string or template stand for; halves of a surrogate pair are put together."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code is None:
            return _NAMED.get(m[4], m[4])
        return chr(int(code, 16)) if int(code, 16) < 0x110000 else m[0]

    if "\\" not in raw:
        return raw
    text = _ESCAPE.sub(one, raw)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if _HALVES.search(text) else text


@dataclass(slots=True)
class Token:
    kind: str  # word number string regex template op comment; in JSX: open attr text end close
    start: int
    end: int
    text: str
    value: str = ""
    holes: list[str] = field(default_factory=list)
    grammar: bool = False


class _Lexer:
    """Tokens of a script, white space left out. ``modes``: [mode, what it must remember]."""

    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx, self.at, self.operand = text, jsx, 0, False
        self.tokens: list[Token] = []
        self.modes: list[list] = [["code", None]]
        self.closed_last: dict[str, int] = {}
        if jsx:
            for m in _CLOSE.finditer(text):
                self.closed_last[m[1] or ""] = m.start()
        self.last_self_close = text.rfind("/>") if jsx else -1
        #: Open templates: [start, parts of the value, start of the part, holes, [start, strings, branches] of the open hole].
        self.templates: list[list] = []

    def _add(self, kind: str, start: int, end: int, value: str = "") -> None:
        if not self.templates:
            self.tokens.append(Token(kind, start, end, self.text[start:end], value))

    def run(self) -> list[Token]:
        steps = {"code": self._code, "(": self._code, "[": self._code, "{": self._code, "hole": self._code, "jsx{": self._code, "template": self._template, "tag": self._tag, "children": self._children}
        self.word = ""  # the last word or operator, also within templates
        while self.at < len(self.text):
            steps[self.modes[-1][0]]()
        return self.tokens

    def _code(self) -> None:
        text, at = self.text, self.at
        if text[at] in " \n":  # most of white space, ahead of its token
            at = self.at = _BLANK.match(text, at).end()
            if at == len(text):
                return
        if text[at] == "/" and not self.operand and (m := _REGEX.match(text, at)):
            self._add("regex", at, m.end())
            self.at, self.operand, self.word = m.end(), True, ""
            return
        if text[at] == "<" and not self.operand and self.jsx and self._opens(at):
            return
        m = _CODE.match(text, at)
        kind, self.at = m.lastgroup, m.end()
        if kind in ("space", "comment"):
            if kind == "comment":
                self._add("comment", at, m.end())
            return
        if kind == "tick":
            self.templates.append([at, [], m.end(), [], None])
            self.modes.append(["template", self.operand])
            return
        token = m[0]
        if kind == "word":
            self._add("word", at, m.end())
            self.operand = token not in _BEFORE_OPERAND and not (token in _CONTROL and self.word != ".")
        elif kind in ("string", "number"):
            value = unescaped(token[1:-1]) if kind == "string" else ""
            if self.templates and self.templates[-1][4] and kind == "string":
                self.templates[-1][4][1].append(value)
            self._add(kind, at, m.end(), value)
            self.operand = True
        else:
            self._op(token, at, m.end())
        self.word = token

    def _op(self, token: str, start: int, end: int) -> None:
        if token in "\"'":  # an unterminated string: to the end of its line
            stop = self.text.find("\n", start)
            self.at = len(self.text) if stop < 0 else stop
            self._add("error", start, self.at)
            self.operand = True
            return
        if token == "/" and self.text.startswith("/*", start):  # an unterminated comment
            self.at = len(self.text)
            return
        if token in ("(", "[", "{"):
            # after the bracket of a condition a regular expression may stand; after a block, too
            after = self.word in _CONTROL if token == "(" else token == "{" and self._block()
            self.modes.append([token, after])
            self.operand = False
        elif token in (")", "]", "}"):
            mode = self.modes[-1]
            if mode[0] == "hole" and token == "}":
                self.modes.pop()
                template = self.templates[-1]
                begin, strings, branches = template[4]
                template[3].append((self.text[begin:start].strip(), branches and len(strings) > 1 and all(len(s) <= ENDING for s in strings)))
                template[2], template[4] = end, None
                return
            if mode[0] == "jsx{" and token == "}":
                self.modes.pop()
                self._add("op", start, end)
                return
            if mode[0] == {")": "(", "]": "[", "}": "{"}[token]:
                self.modes.pop()
                self.operand = not mode[1]
            else:
                self.operand = True
        else:
            if token in ("?", "&&", "||", "??", "+") and self.templates and self.templates[-1][4]:
                self.templates[-1][4][2] = True
            self.operand = self.operand if token in ("++", "--") else False
        self._add("op", start, end)

    def _block(self) -> bool:
        """Whether the brace that comes is a block, so that a statement follows it, and no object."""
        return self.operand or self.word in ("=>", ";", "{", "}", "else", "do", "try", "finally", "")

    def _opens(self, at: int) -> bool:
        m = _OPEN.match(self.text, at)
        name, next_ = m["name"] or "", self.text[m.end() : m.end() + 1]
        if not name and next_ != ">":
            return False
        if next_ == "," or re.match(r"extends\b", self.text[m.end() : m.end() + 8]):
            return False  # the type parameters of an arrow function
        if self.closed_last.get(name, -1) < at and not (name and self.last_self_close > at):
            return False
        end = m.end()
        if next_ == "<":  # type arguments of an element
            depth = 0
            while end < len(self.text):
                depth += {"<": 1, ">": -1}.get(self.text[end], 0)
                end += 1
                if not depth:
                    break
        self._add("open", at, end, name)
        self.modes.append(["tag", name])
        self.at = end
        return True

    def _template(self) -> None:
        text, template = self.text, self.templates[-1]
        stop = _TEMPLATE_STOP.search(text, self.at)
        if stop is None:  # unterminated: no span
            self.at = len(text)
            return
        if stop[0] == "\\":
            self.at = min(len(text), stop.end() + 1)
            return
        template[1].append(unescaped(text[template[2] : stop.start()]))
        self.at = stop.end()
        if stop[0] == "${":
            template[1].append(f"{{{len(template[3])}}}")
            template[4] = [stop.end(), [], False]
            self.modes.append(["hole", None])
            self.operand, self.word = False, ""
            return
        self.templates.pop()
        self.modes.pop()
        self.operand, self.word = True, "`"
        if not self.templates:
            self.tokens.append(Token("template", template[0], stop.end(), text[template[0] : stop.end()], "".join(template[1]), [e for e, _ in template[3]], any(g for _, g in template[3])))
        elif self.templates[-1][4]:
            self.templates[-1][4][1].append("".join(template[1]))

    def _tag(self) -> None:
        m = _TAG.match(self.text, self.at)
        kind, start, self.at = m.lastgroup, self.at, m.end()
        if kind == "space":
            if m[0].lstrip().startswith("/"):
                self._add("comment", start, m.end())
        elif kind == "end":
            self._add("end", start, m.end())
            self.modes.pop()
            self.operand = True
        elif kind == "gt":
            self._add("op", start, m.end())
            self.modes[-1] = ["children", self.modes[-1][1]]
        elif kind == "name":
            self._add("attr", start, m.end())
        elif kind == "string":
            self._add("string", start, m.end(), html.unescape(m[0][1:-1]))
        elif m[0] == "{":
            self._add("op", start, m.end())
            self.modes.append(["jsx{", None])
            self.operand, self.word = False, "("
        elif m[0] == "<":
            self._opens(start)

    def _children(self) -> None:
        text, at = self.text, self.at
        if m := _CLOSE.match(text, at):
            self._add("close", at, m.end())
            self.modes.pop()
            self.at, self.operand = m.end(), True
        elif text[at] == "{":
            self._add("op", at, at + 1)
            self.modes.append(["jsx{", None])
            self.at, self.operand, self.word = at + 1, False, "("
        elif text[at] == "<" and self._opens(at):
            return
        else:
            m = _CHILD_STOP.search(text, at + 1)
            end = m.start() if m else len(text)
            raw = text[at:end]
            if _LETTER.search(raw):
                self._add("text", at + len(raw) - len(raw.lstrip()), end - len(raw) + len(raw.rstrip()), raw.strip())
            self.at = end


@dataclass(slots=True)
class Frame:
    kind: str  # program block object array call group class enum type switch names element attr
    symbol: str = ""
    segment: str = ""
    declared: str = ""  # the variable that is being declared here
    declares: bool = False
    key: str = ""
    count: int = 0  # commas or statements so far
    callee: str = ""
    case: str = ""
    branches: list[list] = field(default_factory=list)  # [number of the ternary, then or else]
    number: int = 0
    fresh: bool = True  # a key, member or statement is due
    start: int = 0  # of the expression that a call belongs to
    opens: str = ""


FACTS = ("attr", "element", "tag", "callee", "arg_index", "symbol", "is_key", "module_specifier", "compared", "persisted", "enum_member", "grammar_hole", "in_test", "branch_group", "holes")


def comment_body(raw: str) -> str:
    """A comment without its marks and the stars that its lines begin with."""
    if raw.startswith("//"):
        return re.sub(r"^//+!?\s*", "", raw)
    inner = re.sub(r"\*+/$", "", re.sub(r"^/\*+!?", "", raw))
    lines = inner.split("\n")
    if len(lines) == 1:
        return inner.strip()
    gutter = re.match(r"(\s*\*+ ?)?", lines[1])[0]
    bare = gutter.rstrip()
    body = [lines[0].strip()] + [x[len(gutter) :] if x.startswith(gutter) else "" if bare and x.rstrip() == bare else x.strip() for x in lines[1:]]
    return "\n".join(body).strip("\n")


def identifiers(text: str) -> Iterator[str]:
    """The names that a script uses: words that are no keywords, attributes and elements."""
    for t in _Lexer(text, True).run():
        if t.kind in ("word", "attr") and t.text not in _BEFORE_OPERAND | _CONTROL | _STATEMENT:
            yield t.text


def script_spans(text: str, file: str = "x.tsx") -> Iterator[tuple[str, str, int, int, str, dict]]:
    """(path, kind, start, end, value, facts) in characters; a literal's span is what its quotes hold."""
    jsx = not re.search(r"\.[cm]?ts$", file.lower())
    tokens = _Lexer(text, jsx).run()
    yield from _Walk(text, tokens, bool(TEST_FILE.search(file))).run()


class _Walk:
    def __init__(self, text: str, tokens: list[Token], in_test: bool):
        self.text, self.all, self.in_test = text, tokens, in_test
        self.tokens = [t for t in tokens if t.kind != "comment"]
        self.frames = [Frame("program")]
        self.began: dict[int, int] = {}  # where the expression begins that a closing bracket's token ends, by token number
        self.pending, self.numbers, self.seen = "", 0, Counter()

    def _near(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else Token("", 0, 0, "")

    def _expression(self, i: int) -> int:
        """Number of the token that the operand ending in token i begins with: words joined by dots, calls, indexes."""
        while True:
            i = self.began.get(i, i)
            if self._near(i - 1).text in (".", "?.") and (self._near(i - 2).kind == "word" or i - 2 in self.began):
                i -= 2
            elif i in self.began or self._near(i).text not in ("(", "["):
                return i
            elif self._near(i - 1).kind == "word" or i - 1 in self.began:
                i -= 1
            else:
                return i

    def _symbol(self) -> str:
        f = self.frames[-1]
        return f.declared or f.symbol

    def _push(self, kind: str, **more) -> None:
        self.numbers += 1
        self.frames.append(Frame(kind, symbol=more.pop("symbol", "") or self._symbol(), number=self.numbers, **more))

    def _path(self) -> str:
        parts = []
        for f in self.frames:
            own = [f.segment, f.declared, f.key, f.case, *(f"?{b[1]}" for b in f.branches), f"[{f.count}]" if f.kind == "array" else ""]
            parts += [p for p in own if p]
        if not parts or parts[-1].endswith("()"):  # no name of its own: its place in what holds it
            parts.append(f"[{next(f.count for f in reversed(self.frames) if f.kind not in ('group', 'names', 'expression'))}]")
        path = "/".join(parts)
        self.seen[path] += 1
        return path if self.seen[path] == 1 else f"{path}~{self.seen[path]}"

    def _call(self) -> Frame | None:
        for f in reversed(self.frames):
            if f.kind == "call":
                return f
            if f.kind in ("block", "class", "switch", "program"):
                return None
        return None

    def _branch(self) -> str:
        for f in reversed(self.frames):
            if f.branches:
                return f"ternary[{f.branches[-1][0]}]"
            if f.kind == "switch":
                return f"switch[{f.number}]"
            if f.kind in ("class", "program") or f.opens == "function":
                return ""
        return ""

    def _facts(self, i: int, t: Token) -> dict:
        before, after, frame = self._near(i - 1), self._near(i + 1), self.frames[-1]
        out = {"in_test": self.in_test, "symbol": self._symbol(), "branch_group": self._branch(), "grammar_hole": t.grammar, "holes": t.holes}
        attr = next((f for f in reversed(self.frames) if f.kind == "attr"), None)
        element = next((f for f in reversed(self.frames) if f.kind == "element"), None)
        out |= {"attr": attr.segment[1:] if attr else "", "element": element.segment if element else ""}
        if t.kind == "text":
            return out
        out["module_specifier"] = t.kind == "string" and before.text in ("from", "import") and before.kind == "word"
        out["is_key"] = frame.kind in ("object", "type", "enum") and frame.fresh and (after.text == ":" or after.text == "?" and self._near(i + 2).text == ":")
        compared = before.text in COMPARISONS or after.text in COMPARISONS or before.text == "case"
        member = before.text == "|" or after.text == "|" or (frame.kind == "type" and not out["is_key"]) or (frame.kind == "enum" and not frame.fresh) or (frame.declares and frame.opens == "type" and before.text == "=")
        if t.kind == "template" and (before.kind == "word" and before.text not in _BEFORE_OPERAND or before.text in (")", "]") and i - 1 in self.began):
            out["tag"] = self.text[self.tokens[self._expression(i - 1)].start : before.end]
        persisted = False
        if call := self._call():
            receiver, _, method = call.callee.rpartition(".")
            receiver = receiver.rstrip("?")
            out |= {"callee": call.callee, "arg_index": call.count}
            compared |= method in MEMBERSHIP
            persisted = bool(receiver) and (receiver.split(".")[-1] in PERSIST_RECEIVERS or "storage" in receiver or "alarms" in receiver or method in PERSIST_METHODS and "Storage" in receiver)
            member |= receiver in SCHEMA_RECEIVERS or method in SCHEMA_METHODS
        return out | {"compared": compared, "persisted": persisted, "enum_member": member}

    def run(self) -> Iterator[tuple[str, str, int, int, str, dict]]:
        number, comments = 0, 0
        for t in self.all:
            if t.kind == "comment":
                yield f"comment[{comments}]", "comment", t.start, t.end, comment_body(t.text), {"in_test": self.in_test, "symbol": self._symbol()}
                comments += 1
                continue
            i, number = number, number + 1
            if t.kind in ("string", "template"):
                self._boundary(i, t)
                facts = self._facts(i, t)
                kind = "attr" if facts["attr"] else "template" if t.kind == "template" else "string"
                if facts["is_key"]:
                    self.frames[-1].key = t.value
                yield self._path(), kind, t.start + 1, t.end - 1, t.value, facts
                self.frames[-1].fresh = False
                if self.frames[-1].kind == "attr" and self._near(i - 1).text == "=":
                    self.frames.pop()
            elif t.kind == "text":
                yield self._path(), "jsx-text", t.start, t.end, t.value, self._facts(i, t)
            else:
                self._step(i, t)

    def _boundary(self, i: int, t: Token) -> None:
        """A token that begins a statement without a semicolon before it: what was declared is over."""
        f, before = self.frames[-1], self._near(i - 1)
        if f.kind not in ("program", "block", "switch", "class") or not i:
            return
        ends = before.kind in ("word", "number", "string", "template", "regex", "close", "end", "error") and before.text not in _BEFORE_OPERAND or before.text in (")", "]", "}")
        if (ends and t.text not in ("as", "in", "of", "instanceof", "satisfies", "else", "catch", "finally", "while", "from") and "\n" in self.text[before.end : t.start]) or t.text in _STATEMENT and ends:
            self._over(f)

    @staticmethod
    def _over(f: Frame) -> None:
        f.declared, f.declares, f.opens, f.branches = "", False, f.opens if f.opens == "function" else "", []
        f.count += 1
        f.fresh = True

    def _step(self, i: int, t: Token) -> None:
        f, before, after, text = self.frames[-1], self._near(i - 1), self._near(i + 1), t.text
        if t.kind == "open":
            self._push("element", segment=t.value or "fragment")  # elements of one name are told apart by the path's running number
        elif t.kind == "attr":
            if f.kind == "attr":  # one without a value
                self.frames.pop()
            self._push("attr", segment="@" + text)
        elif t.kind in ("end", "close"):
            while len(self.frames) > 1 and self.frames.pop().kind != "element":
                pass
        elif t.kind == "word":
            self._word(i, t, f, before, after)
        elif t.kind == "op":
            self._op(i, text, f, before, after)
        else:
            self._boundary(i, t)
            f.fresh = False

    def _word(self, i: int, t: Token, f: Frame, before: Token, after: Token) -> None:
        self._boundary(i, t)
        text, dotted = t.text, before.text in (".", "?.")
        if f.kind in ("object", "type", "enum", "class") and f.fresh and not dotted:
            if after.text in (":", "?", "!") and f.kind != "class":
                f.key, f.fresh = text, False
            elif after.text == "(" and text not in _CONTROL:
                self.pending, f.key, f.fresh = text, "" if f.kind == "class" else text, False
            elif f.kind == "class" and after.text in ("=", ":", ";"):
                f.declared, f.fresh = text, False
            elif f.kind == "enum":
                f.key, f.fresh = text, after.text != "="
        if dotted:
            return
        if text in ("const", "let", "var", "type") and (after.kind == "word" or after.text in ("{", "[")) and f.kind in ("program", "block", "switch", "group"):
            f.declares, f.opens = True, "type" if text == "type" else f.opens
        elif f.declares and not f.declared and (before.text in ("const", "let", "var", "type", ",")):
            f.declared = text
        elif text in ("function", "class", "interface", "enum"):
            name = after if after.kind == "word" else self._near(i + 2) if after.text == "*" else Token("", 0, 0, "")
            if name.kind == "word" and name.text not in ("extends", "implements"):
                self.pending = name.text
            f.opens = {"function": f.opens, "class": "class", "interface": "type-body", "enum": "enum"}[text]
        elif text == "case" and f.kind == "switch" or text == "default" and f.kind == "switch":
            label = self._near(i + 1)
            f.case = "case[default]" if text == "default" else f"case[{label.value or label.text}]"
        elif text == "default" and before.text == "export":
            f.declared = "default"

    def _op(self, i: int, text: str, f: Frame, before: Token, after: Token) -> None:
        if text == "(":
            named = before.kind == "word" and before.text not in _BEFORE_OPERAND | _CONTROL and before.text != "function" or i - 1 in self.began and before.text in (")", "]")
            begin = self._expression(i - 1) if named else i
            callee = self.text[self.tokens[begin].start : before.end] if named else ""
            pending, self.pending = self.pending, ""
            if pending or not named or self._near(begin - 1).text in ("new", "function"):
                self._push("group", symbol=pending, segment=pending, start=i, opens="function" if pending else "")
            else:
                self._push("call", callee=callee, segment=f"{callee}()", start=begin)
        elif text == "[":
            index = before.kind == "word" and before.text not in _BEFORE_OPERAND or i - 1 in self.began and before.text in (")", "]")
            self._push("group" if index else "array", start=self._expression(i - 1) if index else i)
        elif text == "{":
            self._brace(i, f, before)
        elif text in (")", "]", "}"):
            kinds = {")": ("call", "group"), "]": ("array", "group"), "}": ("block", "object", "class", "enum", "type", "switch", "names", "expression")}[text]
            if any(x.kind in kinds for x in self.frames[1:]):
                while (closed := self.frames.pop()).kind not in kinds:
                    pass
                self.began[i] = closed.start
                if closed.symbol and closed.opens == "function" and text == ")":
                    self.pending = closed.segment  # the body, too, is the function's
                top = self.frames[-1]
                if closed.kind == "expression" and top.kind == "attr":
                    self.frames.pop()
                if closed.opens == "function" and text == "}":
                    self._over(top) if top.kind in ("program", "block", "switch", "class") and not top.declared else None
        elif text == ",":
            f.branches = []
            f.count += 1
            if f.kind in ("object", "type", "enum"):
                f.key, f.fresh = "", True
            if f.declares:
                f.declared = ""
        elif text == ";":
            self._over(f)
            f.key = "" if f.kind in ("type", "class") else f.key
            self.pending = ""
        elif text == "?" and after.text not in (":", ",", ")", "=") and not (f.kind in ("object", "type", "class") and f.fresh):
            self.numbers += 1
            f.branches.append([self.numbers, "then"])
        elif text == ":" and f.branches and any(b[1] == "then" for b in f.branches):
            while f.branches[-1][1] == "else":  # its own else is over
                f.branches.pop()
            f.branches[-1][1] = "else"
        elif text == "=>" and f.kind in ("program", "block", "class") and not f.declared:
            f.fresh = False
        elif text == ">" and f.kind == "attr":  # an attribute without a value ends the tag
            self.frames.pop()
        elif text == "=" and f.kind == "enum":
            f.fresh = False

    def _brace(self, i: int, f: Frame, before: Token) -> None:
        pending, self.pending = self.pending, ""
        word = before.text if before.kind == "word" else ""
        if f.kind == "attr" and before.kind == "attr" or f.kind == "element":
            kind = "expression"
        elif before.kind == "op" and before.text == "=" and f.kind == "attr":
            kind = "expression"
        elif f.opens in ("class", "type-body", "enum") and f.kind in ("program", "block", "names"):
            kind, f.opens = {"class": "class", "type-body": "type", "enum": "enum"}[f.opens], ""
        elif pending and f.kind == "class":
            kind = "block"
        elif word in ("import", "export", "type") and f.kind == "program" and not f.declared:
            kind = "names"
        elif before.text == ")" and self._switch(i - 1):
            kind = "switch"
        elif f.kind == "switch" and before.text == ":" or before.text in (")", "=>", ";", "{", "}", "") or word and word not in ("return", "default", "yield", "await", "in", "of", "case", "typeof", "satisfies", "as"):
            kind = "block"
        elif f.opens == "type" and f.declares:
            kind = "type"
        else:
            kind = "object"
        function = pending or before.text == "=>" or before.text == ")" and kind == "block" and not self._control(i - 1)
        self._push(kind, symbol=pending, segment=pending, start=i, opens="function" if function and kind == "block" else "")

    def _control(self, close: int) -> bool:
        return self._near(self.began.get(close, close) - 1).text in _CONTROL

    def _switch(self, close: int) -> bool:
        return self._near(self.began.get(close, close) - 1).text == "switch"
