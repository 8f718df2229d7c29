"""Structural search: code patterns with metavariables, matched on tokens.

`$X` stands for one expression (balanced, without a comma or semicolon of its own), `$$$X` for any number of
them; everything else must match token by token, whatever the white space.  A match is an expression of its own: a name
after a dot, or one that is being declared, does not begin one.  Matches inside matches are found too.  Patterns are compiled once for each
worker and grouped by language, so a file only meets its own language's patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylens.functions import scalar as S
from quarrylens.session import ship_package
from quarrylens.sources.code import Code

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|=>|->|::|\?\.|[=!<>]=+|&&|\|\||\S")
_META = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)|\$([A-Z_][A-Z0-9_]*)")
_OPEN, _CLOSE = "([{", ")]}"
#: fixed values: tokens after which a name is a member or a declaration, and words that begin no expression
_JOINING = frozenset(". -> :: ?. function def func fn fun new class interface struct enum trait".split())
_STATEMENT = frozenset("function def func fn fun class interface struct enum trait return if else for while switch case const let var import export from throw public private protected static final".split())
RESULT = "pattern_id string, path string, line long, end_line long, start_byte long, end_byte long, text string, captured_vars map<string,string>"


@dataclass(frozen=True)
class SearchPattern:
    id: str
    language: str
    pattern_text: str
    kind: str | None = None


def tokenize(code: Code) -> list[tuple[str, int, int]]:
    """(text, start, end) of the tokens; a string literal is one token, comments are none."""
    out, ends, at = [], dict(code.strings), 0
    text = code.masked
    while m := _TOKEN.search(text, at):
        end = ends.get(m.start(), m.end())
        out.append((code.text[m.start() : end], m.start(), end))
        at = end
    return out


def compile_pattern(text: str, language: str) -> list[tuple[str, str]]:
    """(literal | one | many, token or name) of a pattern."""
    names: dict[str, tuple[str, str]] = {}

    def hide(m: re.Match) -> str:
        key = f"MetaVar{len(names)}_"
        names[key] = ("many", m[1]) if m[1] else ("one", m[2])
        return key

    return [names.get(t, ("literal", t)) for t, _, _ in tokenize(Code(_META.sub(hide, text), language))]


class Matcher:
    def __init__(self, code: Code):
        self.code, self.tokens = code, tokenize(code)
        self.texts = [t for t, _, _ in self.tokens]
        stack, self.close = [], {}
        for i, t in enumerate(self.texts):
            if t in _OPEN and len(t) == 1:
                stack.append(i)
            elif t in _CLOSE and len(t) == 1 and stack:
                self.close[stack.pop()] = i

    def find(self, pattern: list[tuple[str, str]]) -> Iterator[tuple[int, int, dict[str, str]]]:
        """Start and end places and captures of all matches, by position.  One that begins with a metavariable is not
        looked for again in what it took."""
        at, fixed = 0, bool(pattern) and pattern[0][0] == "literal"
        while at < len(self.texts) and pattern:
            if (self.texts[at] == pattern[0][1] if fixed else self.texts[at] not in _STATEMENT) and not self._inside(at):
                found = self._match(pattern, 0, at, {})
                if found and found[0] > at:
                    end, names = found
                    yield self.tokens[at][1], self.tokens[end - 1][2], names
                    at = at + 1 if fixed else end
                    continue
            at += 1

    def _inside(self, at: int) -> bool:
        """Whether the name at a place belongs to a longer expression or a declaration."""
        return at > 0 and self.texts[at - 1] in _JOINING and bool(re.match(r"[A-Za-z_$]", self.texts[at]))

    def _span(self, a: int, b: int) -> str:
        return self.code.text[self.tokens[a][1] : self.tokens[b - 1][2]] if b > a else ""

    def _match(self, pattern: list, k: int, at: int, names: dict) -> tuple[int, dict] | None:
        while k < len(pattern):
            kind, value = pattern[k]
            if kind == "literal":
                if at >= len(self.texts) or self.texts[at] != value:
                    return None
                k, at = k + 1, at + 1
                continue
            end = at if kind == "many" else self._step(at, False)
            while end is not None:
                text = self._span(at, end)
                if value == "_" or value not in names or re.sub(r"\s", "", names[value]) == re.sub(r"\s", "", text):
                    single = kind == "one" or (end > at and not self._has_comma(at, end))
                    rest = self._match(pattern, k + 1, end, names | ({value: text} if single else {}))
                    if rest:
                        return rest
                end = self._step(end, kind == "many")
            return None
        return at, names

    def _step(self, at: int, commas: bool) -> int | None:
        """The place after the next token or bracket pair; none at an end, a semicolon or (unless many) a comma."""
        if at >= len(self.texts):
            return None
        t = self.texts[at]
        if t in (";", ")", "]", "}") or (t == "," and not commas):
            return None
        return self.close[at] + 1 if at in self.close else at + 1

    def _has_comma(self, at: int, end: int) -> bool:
        while at < end:
            if self.texts[at] == ",":
                return True
            at = self.close[at] + 1 if at in self.close else at + 1
        return False


class StructuralSearch:
    def __init__(self, patterns: Iterable[SearchPattern]):
        self.by_language: dict[str, list[tuple[str, list]]] = {}
        for p in patterns:
            self.by_language.setdefault(p.language, []).append((p.id, compile_pattern(p.pattern_text, p.language)))

    def search_text(self, text: str, language: str, path: str = "") -> list[dict]:
        patterns = self.by_language.get(language)
        if not patterns:
            return []
        matcher, out = Matcher(Code(text, language)), []
        for id_, pattern in patterns:
            for start, end, names in matcher.find(pattern):
                a = matcher.code.anchor(start, end, "")
                a.pop("node_kind")
                out.append({"pattern_id": id_, "path": path, **a, "text": text[start:end], "captured_vars": list(names.items())})
        return out

    def search(self, files: DataFrame) -> DataFrame:
        """files(path, content[, language]) -> one row for each match."""
        spark = files.sparkSession
        ship_package(spark)
        language = F.col("language") if "language" in files.columns else S.language(F.col("path"))
        rows = files.where(F.col("content").isNotNull()).select("path", "content", language.alias("language")).where(F.col("language").isin(*self.by_language) if self.by_language else F.lit(False))
        return rows.mapInArrow(_Search(self, to_arrow_schema(spark.createDataFrame([], RESULT).schema)), RESULT)


class _Search:
    def __init__(self, search: StructuralSearch, schema: pa.Schema):
        self.search, self.schema = search, schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = self.search.search_text(text, language, path)
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=self.schema)


def search_single(text: str, language: str, pattern: str, path: str = "") -> list[dict]:
    """One ad-hoc pattern on one text; its matches have an empty pattern id."""
    return StructuralSearch([SearchPattern("", language, pattern)]).search_text(text, language, path)
