"""Definitions in source text, by rule tables for each language family."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from quarrylens.sources import code as _code

if TYPE_CHECKING:
    from quarrylens.sources.code import Code

D = _code.Definition

# (kind, node kind, pattern with the name as group `n`); the body is the next bracket pair, if one comes before `;`
_TABLE = {
    "js": (
        ("class", "class_declaration", r"\bclass\s+(?P<n>[A-Za-z_$][\w$]*)"),
        ("function", "function_declaration", r"\bfunction\s*\*?\s*(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>\s*)?(?=\()"),
        ("interface", "interface_declaration", r"\binterface\s+(?P<n>[A-Za-z_$][\w$]*)(?=[^=;]*\{)"),
        ("enum", "enum_declaration", r"\benum\s+(?P<n>[A-Za-z_$][\w$]*)\s*(?=\{)"),
    ),
    "jvm": (
        ("class", "class_declaration", r"\bclass\s+(?P<n>\w+)"),
        ("interface", "interface_declaration", r"(?<!@)\binterface\s+(?P<n>\w+)"),
        ("enum", "enum_declaration", r"\benum\s+(?P<n>\w+)(?=[^;(=]*\{)"),
    ),
    "dotnet": (
        ("class", "class_declaration", r"\bclass\s+(?P<n>\w+)(?=[^;()=]*\{)"),
        ("class", "record_declaration", r"\brecord\s+(?:struct\s+|class\s+)?(?P<n>\w+)(?=\s*[({:;<])"),
        ("interface", "interface_declaration", r"\binterface\s+(?P<n>\w+)"),
        ("struct", "struct_declaration", r"(?<!record )\bstruct\s+(?P<n>\w+)"),
        ("enum", "enum_declaration", r"\benum\s+(?P<n>\w+)"),
    ),
    "go": (
        ("function", "function_declaration", r"^func\s+(?P<n>\w+)\s*(?:\[[^\]]*\])?(?=\()"),
        ("method", "method_declaration", r"^func\s*\((?P<r>[^)]*)\)\s*(?P<n>\w+)\s*(?=\()"),
        ("struct", "type_declaration", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", "type_declaration", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b"),
    ),
    "rust": (
        ("function", "function_item", r"\bfn\s+(?P<n>\w+)\s*(?:<[^>(]*>)?(?=\()"),
        ("struct", "struct_item", r"\bstruct\s+(?P<n>\w+)"),
        ("enum", "enum_item", r"\benum\s+(?P<n>\w+)"),
        ("trait", "trait_item", r"\btrait\s+(?P<n>\w+)"),
        ("module", "mod_item", r"\bmod\s+(?P<n>\w+)\s*(?=[{;])"),
        ("impl", "impl_item", r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{;]*?>)?\s+(?:[^{;]*?\bfor\s+)?(?P<n>\w+)(?=[^;{]*\{)"),
    ),
    "php": (
        ("class", "class_declaration", r"\bclass\s+(?P<n>\w+)(?=[^;()]*\{)"),
        ("interface", "interface_declaration", r"\binterface\s+(?P<n>\w+)"),
        ("trait", "trait_declaration", r"\btrait\s+(?P<n>\w+)"),
        ("enum", "enum_declaration", r"\benum\s+(?P<n>\w+)"),
        ("function", "function_definition", r"\bfunction\s+&?(?P<n>\w+)\s*(?=\()"),
    ),
    "ruby": (
        ("class", "class", r"^[ \t]*class\s+(?P<n>[A-Z]\w*(?:::\w+)*)"),
        ("module", "module", r"^[ \t]*module\s+(?P<n>[A-Z]\w*(?:::\w+)*)"),
        ("method", "method", r"^[ \t]*def\s+(?P<n>\w+(?!\.)\b[?!=]?)"),
        ("method", "singleton_method", r"^[ \t]*def\s+self\.(?P<n>\w+[?!=]?)"),
    ),
    "swift": (("function", "function_declaration", r"\bfunc\s+(?P<n>\w+)\s*(?:<[^>(]*>)?(?=\()"),),
    "c": (("function", "function_definition", r"^[A-Za-z_][\w\s*&:<>,]*?\b(?P<n>~?\w+)\s*(?=\([^;{}]*\)[^;{}()]*\{)"),),
}
_COMPILED = {k: [(a, b, re.compile(c, re.M)) for a, b, c in v] for k, v in _TABLE.items()}
_SKIP = frozenset("if for while switch catch return new else do try throw synchronized using lock foreach constructor".split()) - {"constructor"}
_JS_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*(?P<n>#?[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*\(")
_TYPED_METHOD = re.compile(r"(?P<m>(?:(?:public|private|protected|internal|static|final|abstract|async|virtual|override|sealed|synchronized|default|partial|extern|new|unsafe|readonly|native)\s+)*)(?P<t>(?:<[^>]*>\s*)?[A-Za-z_][\w.]*(?:<[^;{}()]*>)?(?:\[\])*\??)\s+(?P<n>[A-Za-z_]\w*)\s*(?:<[^>(]*>)?\s*\(")


def _body(code: Code, at: int, stop: str = ";") -> tuple[int | None, int]:
    """Start of the `{` that follows a header, past brackets, and the end of its pair; else the end of the header."""
    masked, n = code.masked, len(code.masked)
    while at < n and masked[at] not in "{" + stop:
        at = code.close(at) + 1 if masked[at] in "([" else at + 1
    if at < n and masked[at] == "{":
        return at, code.close(at) + 1
    return None, min(at + 1, n)


def find_definitions(code: Code) -> list[D]:
    if code.family == "python":
        return _python(code)
    out = []
    for kind, node, pattern in _COMPILED.get(code.family, ()):
        if code.language in ("javascript", "jsx") and kind in ("interface", "enum"):
            continue
        for m in pattern.finditer(code.masked):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if code.family == "ruby":
                body, end = None, _ruby_end(code, start)
            else:
                body, end = _body(code, m.end("n") if kind != "method" else m.end())
            extra = {}
            if kind in ("function", "method") and (p := re.compile(r"\s*(?:<[^>(]*>|\[[^\]]*\])?\s*\(").match(code.masked, m.end("n"))):
                extra["open"] = p.end() - 1
            d = D(m["n"], kind, node, start, end, body, None, extra)
            if code.family == "go" and kind == "method":
                d.parent = re.sub(r"^\w*\s*\*?|\[.*", "", m["r"].strip()).strip() or m["r"].strip().lstrip("*")
            out.append(d)
    classes = [d for d in out if d.kind in ("class", "interface", "struct", "trait", "enum") and d.body is not None]
    if code.family == "php":
        for d in out:
            if d.kind == "function" and any(c.body < d.start < c.end for c in classes):
                d.kind, d.node_kind = "method", "method_declaration"
    if code.family == "js":
        for c in classes:
            if c.kind == "class":
                out += _members(code, c, _JS_METHOD, "method_definition", need_body=True)
    elif code.family in ("jvm", "dotnet") and code.language != "scala":
        for c in classes:
            out += _members(code, c, _TYPED_METHOD, "method_declaration", need_body=False)
        if code.language == "kotlin":
            out += [D(m["n"], "function", "function_declaration", m.start(), _body(code, m.end(), ";\n")[1], None, None, {"open": m.end() - 1}) for m in re.finditer(r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<n>\w+)\s*\(", code.masked)]
    if code.language == "scala":
        out += [D(m["n"], "function", "function_definition", m.start(), _body(code, m.end("n"), ";\n")[1]) for m in re.finditer(r"\bdef\s+(?P<n>\w+)", code.masked)]
    return [d for d in out if d.name not in _SKIP]


def _members(code: Code, owner: D, pattern: re.Pattern, node: str, need_body: bool) -> list[D]:
    """Methods that stand directly in the body of a class."""
    out, at, end = [], owner.body + 1, owner.end - 1
    while at < end:
        c = code.masked[at]
        if c in "([{":
            at = code.close(at) + 1
            continue
        if c == "@":  # a decorator or annotation
            at = re.compile(r"@[\w.]*\s*").match(code.masked, at).end()
            continue
        if c.isalpha() or c in "_$#*<":
            m = pattern.match(code.masked, at, end)
            if m and m["n"] not in _SKIP and not (m.groupdict().get("t") or "").strip() in ("return", "new", "throw", "else"):
                closed = code.close(m.end() - 1) + 1
                body, stop = _body(code, closed)
                if (body is not None and not re.search(r"=(?!>)", code.masked[closed:body])) or (not need_body and code.masked[stop - 1] == ";" and "=" not in code.masked[closed:stop].replace("=>", "")):
                    out.append(D(m["n"], "method", node, at, stop, body, owner.name, {"open": m.end() - 1, "modifiers": (m.groupdict().get("m") or "").split()}))
                    at = stop
                    continue
            word = re.compile(r"[\w$#]+|.", re.S).match(code.masked, at)
            at = word.end()
            continue
        at += 1
    return out


#: fixed values: words that belong to a declaration when they stand before it
_MODIFIERS = {
    "js": frozenset(("async",)),
    "jvm": frozenset("public private protected static final abstract synchronized native strictfp transient volatile default sealed open data inner internal override suspend inline companion enum annotation lateinit const operator infix external tailrec value".split()),
    "dotnet": frozenset("public private protected internal static sealed abstract partial async virtual override readonly unsafe extern new ref file required".split()),
    "php": frozenset("public private protected static final abstract readonly".split()),
    "rust": frozenset("pub async const unsafe extern default".split()),
}


def declaration_start(code: Code, d: D) -> int:
    """Start of a definition's modifiers, and of its annotations or attributes where the language puts them inside."""
    words, masked, at = _MODIFIERS.get(code.family, frozenset()), code.masked, d.start
    if not words or (code.family == "js" and d.kind != "function"):
        return at
    while True:
        end = at
        while end > 0 and masked[end - 1].isspace():
            end -= 1
        if end == 0:
            return at
        begin = end
        if masked[end - 1] in ")]" and end - 1 in code.pairs:
            begin = code.pairs[end - 1]
            if masked[end - 1] == "]":
                if code.family == "dotnet" and (not masked[:begin].strip() or masked[:begin].rstrip()[-1] in ";{}])"):
                    at = begin
                    continue
                if code.family == "php" and masked[begin - 1 : begin] == "#":
                    at = begin - 1
                    continue
                return at
        word = re.search(r"[\w.]+$", masked[max(0, begin - 200) : begin])
        if word is None:
            return at
        start = begin - len(word[0])
        if code.family == "jvm" and start > 0 and masked[start - 1] == "@":
            at = start - 1
        elif code.family == "rust" and begin < end and word[0] == "pub":
            at = start  # pub(crate)
        elif begin == end and word[0] in words:
            at = start
        else:
            return at


def _indent(line: str) -> int:
    return len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())


def _ruby_end(code: Code, start: int) -> int:
    """End of the `end` that stands as far in as the definition does."""
    begin = code.masked.rfind("\n", 0, start) + 1
    own, at = _indent(code.masked[begin:].split("\n", 1)[0]), code.masked.find("\n", start)
    while at != -1:
        stop = code.masked.find("\n", at + 1)
        line = code.masked[at + 1 : stop if stop != -1 else None]
        if re.match(r"\s*end\b", line) and _indent(line) == own:
            return at + 1 + re.match(r"\s*end", line).end()
        at = stop
    return len(code.masked)


def _python(code: Code) -> list[D]:
    """By indentation, so that a file with a syntax error still gives what can be read."""
    out = []
    for m in re.finditer(r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)", code.masked, re.M):
        start = m.start() + len(m[1])
        opened = code.masked.find("(", m.end(3), m.end(3) + 2)
        head = code.close(opened) + 1 if opened != -1 and code.masked[m.end(3) : opened].strip() == "" else m.end()
        colon = code.masked.find(":", head)
        own, end = _indent(m[1] + "x"), len(code.masked)
        line_end = code.masked.find("\n", colon if colon != -1 else head)
        at = line_end
        last = line_end if line_end != -1 else end
        while at != -1:
            stop = code.masked.find("\n", at + 1)
            line = code.text[at + 1 : stop if stop != -1 else None]
            blank = not code.masked[at + 1 : stop if stop != -1 else None].strip()
            if not blank and _indent(line) <= own:
                break
            if line.strip():
                last = stop if stop != -1 else end
            at = stop
        extra = {"open": opened} if opened != -1 else {}
        extra["colon"] = colon
        d = D(m[3], "class" if m[2] == "class" else "function", "class_definition" if m[2] == "class" else "function_definition", start, last, colon if colon != -1 else None, None, extra)
        if m[2] == "class" and opened != -1:
            extra["bases"] = (opened + 1, head - 1)
        out.append(d)
    return out
