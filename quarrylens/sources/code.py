"""Source text as spans: comments and strings blanked out, brackets matched, calls and definitions found.

There is no grammar here.  A text is masked (comments and the insides of strings become spaces, offsets stay), its
brackets are paired, and rule tables for each language family are matched on the masked text."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field
from functools import cached_property

from quarrylens.functions import rules

_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_Q = r'"(?:\\.|[^"\\\n])*"?'
_S = r"'(?:\\.|[^'\\\n])*'?"
_MASKS = {
    "js": rf"{_C}|{_Q}|{_S}|`(?:\\.|[^`\\])*`?",
    "python": r"#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)",
    "go": rf"{_C}|{_Q}|`[^`]*`?|'(?:\\.[^']*|[^'\\])'",
    "rust": rf"{_C}|r#*\"[^\"]*\"#*|{_Q}|'(?:\\.[^']*|[^'\\])'",
    "php": rf"#(?!\[)[^\n]*|{_C}|{_Q}|{_S}",
    "ruby": rf"^=begin.*?^=end|#(?!\{{)[^\n]*|{_Q}|{_S}",
    "dotnet": rf"{_C}|@\"(?:\"\"|[^\"])*\"|\$?{_Q}|'(?:\\.[^']*|[^'\\])'",
}
_MASK = {k: re.compile(v, re.S | re.M) for k, v in _MASKS.items()}
_MASK_DEFAULT = re.compile(rf'{_C}|"""(?:.*?)"""|{_Q}|\'(?:\\.[^\']*|[^\'\\])\'', re.S)
_COMMENT = ("//", "/*", "#", "=begin")
_KEYWORDS = frozenset("if for while switch catch return function new else do try throw await yield typeof delete in of and or not elif except with lambda def class func fn match unless until foreach echo print using lock sizeof instanceof case super".split())
_CALL = re.compile(r"(\)\s*(?:\?\.|\.|::|->)\s*)?([A-Za-z_$@][\w$]*(?:\s*(?:\?\.|\.|::|->|\\)\s*[A-Za-z_$][\w$]*)*)[!?]?\s*(?:<[\w\s,.<>\[\]]*>\s*)?\(")
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Call:
    start: int
    end: int
    callee: str
    open: int
    args: list[tuple[int, int]]

    @property
    def name(self) -> str:
        return re.split(r"\?\.|\.|::|->", self.callee)[-1].strip()

    @property
    def receiver(self) -> str:
        m = re.match(r"(?s)(.*)(?:\?\.|\.|::|->)\s*[\w$]+$", self.callee)
        return m[1].strip() if m else ""


@dataclass
class Definition:
    name: str
    kind: str
    node_kind: str
    start: int
    end: int
    body: int | None = None
    parent: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def first(self) -> int:
        """Where the declaration begins with its modifiers and, where these belong to it, annotations."""
        return self.extra.get("first", self.start)


class Code:
    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.family = rules.LANGUAGE_FAMILY.get(language, "c")
        self.strings: list[tuple[int, int]] = []
        self.comments: list[tuple[int, int]] = []
        out, at = [], 0
        for m in _MASK.get(self.family, _MASK_DEFAULT).finditer(text):
            out.append(text[at : m.start()])
            s = m.group()
            if s.startswith(_COMMENT):
                self.comments.append(m.span())
                out.append(re.sub(r"[^\n]", " ", s))
            else:
                self.strings.append(m.span())
                lead = re.match(r"[@$rRbBuUfF#]*(?:\"\"\"|'''|[\"'`])?", s).end()
                out.append(s[:lead] + re.sub(r"[^\n]", " ", s[lead:-1]) + s[-1:] if len(s) > lead else s)
            at = m.end()
        out.append(text[at:])
        self.masked = "".join(out)
        self._string_at = dict(self.strings)

    # --- places

    @cached_property
    def _lines(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer("\n", self.text))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self._lines, at)

    @cached_property
    def _bytes(self) -> list[int] | None:
        if self.text.isascii():
            return None
        out, n = [0], 0
        for c in self.text:
            n += len(c.encode("utf-8", "surrogatepass"))
            out.append(n)
        return out

    def anchor(self, start: int, end: int, kind: str) -> dict:
        b = self._bytes
        return {
            "line": self.line(start), "end_line": self.line(max(start, end - 1)), "start_byte": b[start] if b else start, "end_byte": b[end] if b else end, "node_kind": kind,
        }

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Matching positions of brackets outside comments and strings, both ways."""
        out, stack = {}, []
        for m in re.finditer(r"[()\[\]{}]", self.masked):
            c = m.group()
            if c in "([{":
                stack.append((c, m.start()))
            else:
                while stack and stack[-1][0] != _PAIRS[c]:
                    stack.pop()
                if stack:
                    _, at = stack.pop()
                    out[at], out[m.start()] = m.start(), at
        return out

    def close(self, at: int) -> int:
        return self.pairs.get(at, len(self.text) - 1)

    # --- strings and arguments

    def string_value(self, start: int, end: int) -> str | None:
        """The inside of the string literal that fills the span; null if it is anything else."""
        while start < end and self.text[start].isspace():
            start += 1
        while end > start and self.text[end - 1].isspace():
            end -= 1
        if self._string_at.get(start) != end:
            return None
        return re.sub(r"^[@$rRbBuUfF#]*(\"\"\"|'''|\"|'|`)(.*?)\1#*$", r"\2", self.text[start:end], flags=re.S)

    def split(self, start: int, end: int) -> list[tuple[int, int]]:
        """Parts of a span between commas that lie in no inner bracket."""
        out, at, i = [], start, start
        while i < end:
            c = self.masked[i]
            if c in "([{":
                i = self.close(i)
            elif c == ",":
                out.append((at, i))
                at = i + 1
            i += 1
        if self.masked[at:end].strip():
            out.append((at, end))
        return out

    def raw(self, span: tuple[int, int]) -> str:
        return self.text[span[0] : span[1]].strip()

    def first_string(self, call: Call) -> str | None:
        return next((v for a in call.args if (v := self.string_value(*a)) is not None), None)

    # --- calls

    @cached_property
    def calls(self) -> list[Call]:
        """Calls by position; a call on the result of another starts where that one starts."""
        out, begun = [], {}
        declared = {d.extra["open"] for d in self.definitions if "open" in d.extra}
        heads = [(d.start, d.body if d.body is not None else d.end) for d in self.definitions if self.language == "kotlin" and d.kind in ("class", "interface")]
        at = 0
        while m := _CALL.search(self.masked, at):
            at = m.end()
            opened = m.end() - 1
            name = m[2]
            start = m.start(2)
            if m[1]:
                start = begun.get(m.start(1), self.pairs.get(m.start(1), start))
            if name.startswith("@"):
                if self.family == "jvm":
                    continue  # an annotation
                name, start = name[1:], start + 1
            if self.family == "dotnet" and not m[1] and re.search(r"(?:^|[;{}\])])\s*\[[\w\s,.()\"]*$", self.masked[max(0, start - 200) : start]):
                continue  # an attribute
            if any(a <= m.start(2) < b for a, b in heads):
                continue  # a constructor in the head of a class
            if opened in declared or re.split(r"\W+", name)[-1] in _KEYWORDS or (not m[1] and name in _KEYWORDS):
                continue
            end = self.close(opened) + 1
            begun[end - 1] = start
            callee = re.sub(r"\s+", " ", self.text[start : m.end(2)]).strip()
            out.append(Call(start, end, callee, opened, self.split(opened + 1, end - 1)))
        return out

    # --- definitions

    @cached_property
    def definitions(self) -> list[Definition]:
        from quarrylens.sources.definitions import declaration_start, find_definitions

        found = find_definitions(self)
        members = {(d.start, d.name) for d in found if d.kind == "method"}
        found = [d for d in found if d.kind != "function" or (d.start, d.name) not in members]
        types = [d for d in found if d.kind in ("class", "interface", "enum", "struct", "trait", "module", "impl")]
        for d in found:
            d.extra["first"] = declaration_start(self, d)
            if d.parent is None:
                around = [t for t in types if t is not d and t.start < d.start and d.end <= t.end]
                d.parent = max(around, key=lambda t: t.start).name if around else None
        return sorted(found, key=lambda d: (d.start, d.end))

    @cached_property
    def _scopes(self) -> list[tuple[int, int, str]]:
        """Spans with the name that calls inside them have as their source: functions and arrow functions."""
        out = [(d.start, d.end, d.name) for d in self.definitions if d.kind in ("function", "method")]
        if self.family == "js":
            for m in re.finditer(r"(?:(?<![\w$.])([A-Za-z_$][\w$]*)\s*|\))\s*=>\s*", self.masked):
                body = m.end()
                end = self.close(body) + 1 if self.masked[body : body + 1] == "{" else self._expression_end(body)
                start = m.start() if m[1] else self.pairs.get(m.start(), m.start())
                out.append((start, end, m[1] or ""))
        return sorted(out)

    def _expression_end(self, at: int) -> int:
        while at < len(self.masked) and self.masked[at] not in ",;)]}":
            at = self.close(at) + 1 if self.masked[at] in "([{" else at + 1
        return at

    def enclosing(self, at: int) -> str:
        """Name of the innermost function around a place; `` at module level and in functions without a name."""
        best, name = -1, ""
        for start, end, own in self._scopes:
            if start > at:
                break
            if at < end and start > best:
                best, name = start, own
        return name
