"""Facts from source files: one Arrow pass over the file texts, then fact tables by explode.

Rules for each language family are plain functions over Code; a file that cannot be read gives a row with an
error and no facts, never a failed job."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarrylens.functions import rules, scalar as S
from quarrylens.session import ship_package
from quarrylens.sources.code import Call, Code, Definition

_AT = "line: bigint, end_line: bigint, start_byte: bigint, end_byte: bigint, node_kind: string"
_FACTS = {
    "interfaces": f"method: string, path: string, auth: struct<kind: string, name: string>, parameters: array<struct<name: string, location: string, param_type: string>>, handler_name: string, request_body_type: string, {_AT}",
    "dependencies": f"target: string, dependency_type: string, {_AT}",
    "sinks": f"sink_type: string, text: string, contains_pii: boolean, {_AT}",
    "symbols": f"name: string, kind: string, doc: string, signature: string, visibility: string, parent: string, is_test: boolean, ordinal: bigint, {_AT}",
    "imports": "source: string, specifiers: array<string>, line: bigint",
    "references": "source_symbol: string, source_line: bigint, target_symbol: string, reference_kind: string",
    "data_models": f"name: string, model_kind: string, fields: array<struct<name: string, field_type: string, line: bigint, visibility: string>>, parent_type: string, implemented_interfaces: array<string>, {_AT}",
    "env_dependencies": f"var_name: string, {_AT}",
}
FACT_NAMES = tuple(_FACTS)
SCHEMA = "path string, error string, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in _FACTS.items())

_PII = re.compile("|".join(rules.PII_WORDS))
_AUTH = re.compile("|".join(rules.AUTH_WORDS))
_LOG_CALL = re.compile(f"(?:{'|'.join(rules.LOG_OBJECTS)})(?:\\.|::)(?:{'|'.join(rules.LOG_METHODS)})\\(")
_VERBS = frozenset(v.lower() for v in rules.HTTP_VERBS)


def _auth(name: str | None, kind: str = "middleware") -> dict | None:
    return {"kind": kind, "name": name} if name and _AUTH.search(name.lower()) else None


def path_parameters(path: str) -> list[dict]:
    """Names in `:p`, `{p}` and `<p>` segments, as the Column function gives them."""
    names = [s[1:].split("(")[0] for s in path.split("/") if s.startswith(":")]
    names += [n for n in (x.split(":")[0].strip() for x in re.findall(r"\{([^}]*)\}", path)) if " " not in n]
    names += [n for n in (x.rsplit(":", 1)[-1].strip() for x in re.findall(r"<([^>]*)>", path)) if " " not in n]
    return [{"name": n, "location": "path", "param_type": None} for n in dict.fromkeys(n for n in names if n)]


def _compose(*parts: str | None) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def _cut(text: str, most: int = 100) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


class Facts:
    """What one file holds."""

    def __init__(self, path: str, code: Code):
        self.path, self.code = path, code
        self.rows: dict[str, list[dict]] = {k: [] for k in _FACTS}

    def route(self, verb: str, path: str, span: tuple[int, int], kind: str, auth: dict | None = None, handler: str | None = None) -> None:
        self.rows["interfaces"].append(
            {"method": verb.upper(), "path": path, "auth": auth, "parameters": path_parameters(path), "handler_name": handler, "request_body_type": None, **self.code.anchor(*span, kind)}
        )

    def http_call(self, call: Call) -> None:
        text = self.code.text[call.start : call.end]
        self.rows["dependencies"].append({"target": _cut(text), "dependency_type": "http_call", **self.code.anchor(call.start, call.end, self._kind())})

    def _kind(self) -> str:
        return rules.behaviour(self.code.language)[3][0]

    # --- facts that all languages share

    def symbols(self) -> None:
        c = self.code
        if c.family in ("swift", "c") or c.language in ("kotlin", "scala"):
            return
        for i, d in enumerate(x for x in c.definitions if x.kind != "impl" and x.node_kind != "singleton_method"):
            text = c.text[d.first : d.end]
            self.rows["symbols"].append(
                {
                    "name": d.name, "kind": d.kind, "doc": self.doc(d), "signature": self.signature(text), "visibility": self.visibility(d), "parent": d.parent, "is_test": self.is_test(d, text),
                    "ordinal": i, **c.anchor(d.first, d.end, d.node_kind),
                }
            )

    def signature(self, text: str) -> str:
        cut = rules.behaviour(self.code.language)[2]
        return text.split(cut, 1)[0].strip()

    def _before(self, d: Definition) -> str:
        """Text of the line above and the modifiers before a definition."""
        begin = self.code.text.rfind("\n", 0, d.start) + 1
        return self.code.text[begin : d.start]

    def _annotations(self, d: Definition) -> str:
        """Annotation and attribute lines right above a definition, its own line's start included."""
        begin = self.code.text.rfind("\n", 0, d.start) + 1
        out = [self.code.text[begin : d.start]]
        while begin > 0:
            above = self.code.text.rfind("\n", 0, begin - 1) + 1
            line = self.code.text[above : begin - 1].strip()
            if not re.match(r"@|#\[|\[|//|/?\*|#", line):
                break
            out.insert(0, line + "\n")
            begin = above
        return "".join(out)

    def visibility(self, d: Definition) -> str | None:
        c, before = self.code, self._before(d)
        head = c.masked[d.first : d.start] + c.text[d.start : d.start + 200]
        if c.family == "js":
            return "public" if re.search(r"\bexport\b", before) or self._exported_parent(d) else None
        if c.family == "python":
            return "private" if d.name.startswith("_") else "public"
        if c.family == "go":
            return "public" if d.name[:1].isupper() else "private"
        if c.family == "rust":
            return "public" if re.search(r"\bpub\b", before) else "private"
        if c.family == "jvm":  # an annotation before the modifiers hides them
            m = re.match(r"(public|private|protected|internal)\b", c.text[d.first :])
            return m[1] if m else None
        if c.family in ("dotnet", "php"):
            m = re.search(r"\b(public|private|protected|internal)\b", head[: head.find(d.name) if d.name in head else 0])
            return m[1] if m else None
        return None

    def _exported_parent(self, d: Definition) -> bool:
        return any(p.name == d.parent and p.start < d.start < p.end and re.search(r"\bexport\b", self._before(p)) for p in self.code.definitions)

    def is_test(self, d: Definition, text: str) -> bool:
        f, above = self.code.family, self._annotations(d)
        if f in ("js", "python"):
            return d.name.startswith("test")
        if f == "php":
            return d.name.startswith("test") or "#[Test]" in above
        if f == "ruby":
            return d.name.startswith("test_")
        if f == "jvm":
            return bool(re.search(r"@Test\b", above + self.code.text[d.first : d.start]))
        if f == "dotnet":
            return bool(re.search(r"\[(?:Test|Fact|Theory)\b", above + self.code.text[d.first : d.start]))
        if f == "go":
            return bool(re.match("Test|Benchmark|Fuzz", d.name)) and bool(re.search(r"testing\.[TBMF]\b", text.split("{")[0]))
        if f == "rust":
            return bool(re.search(r"#\[(?:tokio::)?test\]|#\[rstest\]", above))
        return False

    def doc(self, d: Definition) -> str | None:
        c = self.code
        if c.family == "python":
            if d.body is None:
                return None
            at = next((i for i in range(d.body + 1, min(d.end, len(c.text))) if not c.text[i].isspace()), None)
            end = c._string_at.get(at) if at is not None else None
            return c.string_value(at, end).strip() if end else None
        own = self._annotations(d)
        begin = c.text.rfind("\n", 0, d.start) + 1 - (len(own) - len(self._before(d)))
        ends = [s for s in c.comments if s[1] <= d.start and not c.masked[s[1] : d.start].strip(" \t\n").replace("export", "").replace("default", "").replace("pub", "").replace("public", "").strip() or (begin <= s[0] < d.start)]
        if not ends:
            return None
        text = c.text[ends[-1][0] : ends[-1][1]]
        if text.startswith("/*"):
            lines = (x.strip().lstrip("*").strip() for x in text[2:-2].strip("*").split("\n"))
            return "\n".join(x for x in lines if x) or None
        run, last = [], None
        for a, b in reversed(ends):
            if c.text[a:b].startswith("/*") or (last is not None and c.text[b:last].strip()):
                break
            run.insert(0, re.sub(r"^(?:///?!?|#+)\s?", "", c.text[a:b]).rstrip())
            last = a
        return "\n".join(run).strip() or None

    def references(self) -> None:
        c = self.code
        for call in c.calls:
            if not (c.family == "rust" and c.masked[call.open - 1] == "!"):  # a macro
                self._reference(c.enclosing(call.start), call.start, call.callee, "call")
        for d in c.definitions:
            for kind, target in self.supertypes(d):
                self._reference(d.name, d.start, target, kind)

    def _reference(self, source: str, at: int, target: str, kind: str) -> None:
        if target and target[0] not in "\"'":
            self.rows["references"].append({"source_symbol": source, "source_line": self.code.line(at), "target_symbol": target, "reference_kind": kind})

    def supertypes(self, d: Definition) -> list[tuple[str, str]]:
        """(extends or implements, type) of a type definition."""
        c = self.code
        head = c.masked[d.start : d.body if d.body is not None else d.end]
        types = lambda text: re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"[\w$]+\.", "", text))  # noqa: E731 - generics name further types
        out: list[tuple[str, str]] = []
        if c.family == "js" and d.kind in ("class", "interface"):
            m = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|$)", head, re.S)
            out += [("extends", t) for t in (types(m[1]) if m else [])]
            m = re.search(r"\bimplements\s+(.*)", head, re.S)
            out += [("implements", t) for t in (types(m[1]) if m else [])]
        elif c.family == "python" and d.kind == "class" and "bases" in d.extra:
            out += [("extends", t.rsplit(".", 1)[-1]) for a in c.split(*d.extra["bases"]) if re.fullmatch(r"[\w.]+", t := c.raw(a))]
        elif c.language == "java" and d.kind in ("class", "interface", "enum"):
            m = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|$)", head, re.S)
            out += [("extends", t) for t in (types(m[1]) if m else [])]
            m = re.search(r"\bimplements\s+(.*)", head, re.S)
            out += [("implements", t) for t in (types(m[1]) if m else [])]
        elif c.language in ("csharp", "kotlin") and d.kind in ("class", "interface", "struct"):
            m = re.search(r":\s*([^{]*)", re.sub(r"\([^)]*\)", "", head))
            named = [re.sub(r"<.*", "", t).strip().rsplit(".", 1)[-1] for t in m[1].split(" where ")[0].split(",")] if m else []
            out += [("implements" if c.language == "csharp" and re.match(r"I[A-ZÀ-Þ]", t) else "extends", t) for t in named if t]
        elif c.family == "go" and d.kind == "struct" and d.body is not None:
            for line in c.masked[d.body + 1 : d.end - 1].split("\n"):
                if m := re.fullmatch(r"\s*\*?((?:\w+\.)?\w+)\s*(?:[`\"].*)?", line):
                    out.append(("extends", m[1].rsplit(".", 1)[-1]))
        elif c.family == "rust" and d.kind == "impl" and (m := re.search(r"\bimpl\b(?:\s*<[^{]*?>)?\s+([\w:]+)(?:<[^{]*?>)?\s+for\b", head)):
            out.append(("implements", m[1].rsplit("::", 1)[-1]))
        return out

    def sinks(self) -> None:
        c = self.code
        for call in c.calls:
            text = c.text[call.start : call.end]
            if c.family == "js":
                hit = call.receiver in rules.LOG_OBJECTS and call.name in rules.LOG_METHODS
            else:
                hit = bool(_LOG_CALL.search(text))
            if hit:
                self.rows["sinks"].append({"sink_type": "log", "text": text, "contains_pii": bool(_PII.search(text.lower())), **c.anchor(call.start, call.end, self._kind())})

    _ENV_CALLS = {
        "python": ("os.getenv", "os.environ.get"), "go": ("os.Getenv",), "jvm": ("System.getenv",), "dotnet": ("Environment.GetEnvironmentVariable",), "php": ("getenv", "env"),
        "ruby": ("ENV.fetch",), "rust": ("std::env::var", "env::var", "std::env::var_os", "env::var_os"),
    }
    _ENV_INDEX = {"python": r"os\.environ\[", "php": r"\$_ENV\[", "ruby": r"\bENV\["}

    def environment(self) -> None:
        c = self.code
        add = lambda name, a, b, kind: self.rows["env_dependencies"].append({"var_name": name, **c.anchor(a, b, kind)})
        if c.family == "js":
            for m in re.finditer(r"\b(?:process\.env|import\.meta\.env)(?:\.([A-Za-z_$][\w$]*)|\[)", c.masked):
                add(m[1] or "<dynamic>", m.start(), m.end() if m[1] else c.close(m.end() - 1) + 1, "member_expression" if m[1] else "subscript_expression")
        for call in c.calls:
            if call.callee in self._ENV_CALLS.get(c.family, ()) and (name := c.first_string(call)) is not None:
                add(name, call.start, call.end, self._kind())
        if c.family in self._ENV_INDEX:
            for m in re.finditer(self._ENV_INDEX[c.family], c.masked):
                end = c.close(m.end() - 1)
                if (name := c.string_value(m.end(), end)) is not None:
                    add(name, m.start(), end + 1, "subscript")
        if c.family == "jvm":
            for m in re.finditer(r"@Value\(\s*\"[^\"]*?\$\{([^}]*)\}", c.text):
                add(m[1], m.start(), m.end(), "annotation")
        if c.family == "rust":
            for m in re.finditer(r"\benv!\(", c.masked):
                if (name := c.string_value(m.end(), c.close(m.end() - 1))) is not None:
                    add(name, m.start(), c.close(m.end() - 1) + 1, "macro_invocation")

    # --- data models

    def models(self) -> None:
        c = self.code
        kinds = {"js": ("class", "interface"), "python": ("class",), "jvm": ("class", "interface"), "dotnet": ("class", "interface", "struct"), "go": ("struct", "interface"), "rust": ("struct",)}
        if c.language == "scala":
            return
        for d in c.definitions:
            if d.kind not in kinds.get(c.family, ()):
                continue
            up = self.supertypes(d)
            fields = [] if c.family == "go" and d.kind == "interface" else self._fields(d)
            first = next((t for k, t in up if k == "extends"), None)
            self.rows["data_models"].append(
                {"name": d.name, "model_kind": d.kind, "fields": fields, "parent_type": first, "implemented_interfaces": [t for k, t in up if k == "implements"], **c.anchor(d.first, d.end, d.node_kind)}
            )

    _FIELD = {
        "js": r"(?:^|[;,{])[ \t]*((?:public|private|protected|readonly|static|declare)\s+)*(?P<n>[A-Za-z_$][\w$]*)[?!]?\s*:\s*(?P<t>[^;=\n,]+)",
        "jvm": r"(?:^|;)[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?P<m>(?:(?:public|private|protected|static|final|volatile|transient)\s+)*)(?P<t>[A-Za-z_][\w.]*(?:<[^;=()]*>)?(?:\[\])*)\s+(?P<n>\w+)\s*(?:=|;)",
        "dotnet": r"(?:^|;)[ \t]*(?:\[[^\]]*\]\s*)*(?P<m>(?:(?:public|private|protected|internal|static|readonly|required|virtual|override|const)\s+)+)(?P<t>[A-Za-z_][\w.]*(?:<[^;={()]*>)?(?:\[\])*\??)\s+(?P<n>\w+)\s*(?:=(?!>)|;|\{\s*(?:get|set|init))",
        "go": r"^[ \t]*(?P<n>[A-Za-z_]\w*)[ \t]+(?P<t>[*\[\]\w.{}() ]+?)[ \t]*(?:[`\"].*)?$",
        "rust": r"(?:^|,)[ \t]*(?P<m>pub(?:\([^)]*\))?\s+)?(?P<n>[a-z_]\w*)\s*:\s*(?P<t>[^,\n]+)",
    }

    def _fields(self, d: Definition) -> list[dict]:
        c, out = self.code, []
        if c.family == "python":
            return self._python_fields(d)
        if d.body is None:
            return out
        inner = self._own_level(d.body + 1, d.end - 1)
        if c.language == "kotlin":
            for m in re.finditer(r"\b(?:val|var)\s+(\w+)\s*:\s*([\w<>?., ]+)", c.masked[d.start : d.end]):
                out.append({"name": m[1], "field_type": m[2].strip(" ,"), "line": c.line(d.start + m.start()), "visibility": None})
            return out
        for m in re.finditer(self._FIELD[c.family], inner, re.M):
            if m["n"] in ("return", "case", "default", "throw"):
                continue
            words = (m.groupdict().get("m") or m.group()).split()
            seen = next((w for w in words if w in ("public", "private", "protected", "internal")), None)
            if c.family == "go":
                seen = "public" if m["n"][:1].isupper() else "private"
            elif c.family == "rust":
                seen = "public" if m.groupdict().get("m") else "private"
            at = d.body + 1 + m.start("n")
            out.append({"name": m["n"], "field_type": m["t"].strip(), "line": c.line(at), "visibility": seen})
        return out

    def _own_level(self, start: int, end: int) -> str:
        """The span with inner braces and parentheses blanked out, so that only direct members are left."""
        out, at = [], start
        while at < end:
            ch = self.code.masked[at]
            if ch in "({" and (stop := self.code.close(at)) > at:
                body = self.code.masked[at : stop + 1]
                kept = body if ch == "{" and re.match(r"\{\s*(?:get|set|init)\b", body) else ch + re.sub(r"[^\n]", " ", body[1:-1]) + body[-1]
                out.append(kept)
                at = stop + 1
            else:
                out.append(ch)
                at += 1
        return "".join(out)

    def _python_fields(self, d: Definition) -> list[dict]:
        c, seen, out = self.code, set(), []
        start = c.masked.find("\n", d.body or d.start)
        body = c.masked[start : d.end] if start != -1 else ""
        level = min((len(x) - len(x.lstrip()) for x in body.split("\n") if x.strip()), default=0)
        for m in re.finditer(rf"^[ \t]{{{level}}}([A-Za-z_]\w*)\s*:\s*([^=\n]+)", body, re.M):
            if m[1] not in ("else", "try", "finally") and m[1] not in seen:
                seen.add(m[1])
                out.append({"name": m[1], "field_type": c.text[start + m.start(2) : start + m.end(2)].strip(), "line": c.line(start + m.start(1)), "visibility": "private" if m[1].startswith("_") else "public"})
        for f in c.definitions:
            if f.name == "__init__" and f.parent == d.name and d.start < f.start < d.end:
                for m in re.finditer(r"\bself\.(\w+)\s*(?::\s*([^=\n]+))?=(?!=)", c.masked[f.start : f.end]):
                    if m[1] not in seen:
                        seen.add(m[1])
                        out.append({"name": m[1], "field_type": (m[2] or "").strip() or None, "line": c.line(f.start + m.start()), "visibility": "private" if m[1].startswith("_") else "public"})
        return out

    # --- imports

    def imports(self) -> None:
        c = self.code
        add = lambda source, names, at: self.rows["imports"].append({"source": source, "specifiers": names, "line": c.line(at)})
        if c.family == "js":
            for m in re.finditer(r"^[ \t]*import\b([^;'\"`]*?)(?:\bfrom\s*)?(?=['\"])", c.masked, re.M):
                end = c._string_at.get(m.end())
                if end is None:
                    continue
                names = []
                for part in re.sub(r"\btype\b", "", m[1]).replace("{", ",").replace("}", ",").split(","):
                    words = part.split()
                    if words[:2] == ["*", "as"] and len(words) > 2:
                        names.append(words[2])
                    elif words and words[0] != "from":
                        names.append(words[0])
                add(c.string_value(m.end(), end), names, m.start())
        elif c.family == "python":
            for m in re.finditer(r"^[ \t]*import\s+([^\n#;]+)", c.masked, re.M):
                for part in m[1].split(","):
                    if part.split():
                        add(part.split()[0], [part.split()[0]], m.start())
            for m in re.finditer(r"^[ \t]*from\s+([.\w]+)\s+import\s*(\((?:[^)]*)\)|[^\n#;]+)", c.masked, re.M):
                names = [p.split()[0] for p in m[2].strip("() \n\t\\").split(",") if p.split()]
                names = [n for n in names if n == "*" or not m[1].endswith(n)]  # a module that ends with the name hides it
                add(m[1], names or [m[1]], m.start())

    # --- everything

    def all(self) -> dict[str, list[dict]]:
        from quarrylens.operators.frameworks import scan_frameworks

        for step in (self.symbols, self.references, self.models, self.environment, self.imports, self.sinks):
            step()
        scan_frameworks(self)
        return self.rows


def extract_text(path: str, text: str, language: str) -> dict[str, list[dict]]:
    """Facts of one text, outside of Spark."""
    return Facts(path, Code(text, language)).all()


class _Extract:
    def __init__(self, schema: pa.Schema):
        self.schema = schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, out = batch.slice(lo, 200), []
                for path, text, language in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    row: dict = {"path": path, "error": None}
                    try:
                        row |= extract_text(path, text, language)
                    except Exception as e:  # noqa: BLE001 - one unreadable file must not fail the job
                        row |= {k: [] for k in _FACTS} | {"error": f"{type(e).__name__}: {e}"}
                    out.append(row)
                facts = pa.RecordBatch.from_pylist(out, schema=self.schema)
                yield pa.RecordBatch.from_arrays([*facts.columns, *part.columns[3:]], names=[*facts.schema.names, *part.schema.names[3:]])


def extract(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """files(path, content[, language]) -> one row a file with arrays of facts, and the columns to keep; files of no known language go."""
    spark = files.sparkSession
    ship_package(spark)
    known = files.withColumn("language", F.coalesce("language", S.language(F.col("path")))) if "language" in files.columns else files.withColumn("language", S.language(F.col("path")))
    known = known.where(F.col("language").isNotNull() & F.col("content").isNotNull())
    known = known.select("path", "content", "language", *(F.col(c).alias(f"kept_{c}") for c in keep))
    facts = StructType(spark.createDataFrame([], SCHEMA).schema.fields)
    found = known.mapInArrow(_Extract(to_arrow_schema(facts)), StructType([*facts.fields, *known.schema.fields[3:]]))
    return found.withColumnsRenamed({f"kept_{c}": c for c in keep})


def fact_tables(extracted: DataFrame) -> dict[str, DataFrame]:
    """The fact tables, each with the file that a fact is from; imports and references get ids and defaults."""
    good = extracted.where(F.col("error").isNull())
    out = {}
    for name in _FACTS:
        rows = good.select(F.col("path").alias("file"), F.posexplode(name).alias("pos", "f"))
        out[name] = rows.select("file", "f.*", "pos") if name in ("imports", "references") else rows.select("file", "f.*")
    out["imports"] = out["imports"].select(F.concat_ws("#", "file", "pos").alias("import_id"), "file", "source", "specifiers", "line")
    out["references"] = out["references"].select(
        "source_symbol", F.col("file").alias("source_file"), "source_line", "target_symbol", F.lit(None).cast("string").alias("target_file"), F.lit(None).cast("long").alias("target_line"), "reference_kind",
        F.lit(0.0).alias("confidence"), F.lit("unresolved").alias("resolution_method"),
    )
    return out
