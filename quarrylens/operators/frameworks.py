"""Routes and HTTP calls of web frameworks, by language family."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from quarrylens.functions import rules

if TYPE_CHECKING:
    from quarrylens.operators.extract import Facts
    from quarrylens.sources.code import Call, Definition

_VERBS = frozenset(v.lower() for v in rules.HTTP_VERBS)
_NAME = re.compile(r"\w+")
#: fixed values: names of route attributes and helpers
SPRING = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE"}
ASPNET = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpPatch": "PATCH", "HttpDelete": "DELETE", "HttpHead": "HEAD", "HttpOptions": "OPTIONS"}
MINIMAL = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapPatch": "PATCH", "MapDelete": "DELETE"}
NEST = {"Get": "GET", "Post": "POST", "Put": "PUT", "Patch": "PATCH", "Delete": "DELETE", "Options": "OPTIONS", "Head": "HEAD", "All": "ALL"}
GO_VERBS = {"GET": "GET", "POST": "POST", "PUT": "PUT", "PATCH": "PATCH", "DELETE": "DELETE", "OPTIONS": "OPTIONS", "HEAD": "HEAD", "Any": "ALL"}
RESOURCE = (("get", ""), ("get", "create"), ("post", ""), ("get", "{}"), ("get", "edit"), ("put", "{}"), ("delete", "{}"))
API_RESOURCE = (("get", ""), ("post", ""), ("get", "{}"), ("put", "{}"), ("delete", "{}"))
#: words that must all (or of a group, any) stand in the text of an HTTP call, lower-cased
JVM_CLIENTS = (
    ("resttemplate", ("getforobject", "getforentity", "postforobject", "postforentity", "exchange", "execute")),
    ("webclient", (".get()", ".post()", ".put()", ".delete()")),
    ("httpclient", ("send",)),
)
DOTNET_CALLS = ("getasync", "postasync", "putasync", "deleteasync", "sendasync", "getstringasync")


def scan_frameworks(facts: Facts) -> None:
    rule = {"js": _js, "python": _python, "jvm": _jvm, "dotnet": _dotnet, "go": _go, "php": _php, "ruby": _ruby}.get(facts.code.family)
    if rule:
        rule(facts)


def _is_auth(text: str) -> bool:
    return any(w in text.lower() for w in rules.AUTH_WORDS)


def _middle_auth(facts: Facts, args: list[tuple[int, int]]) -> dict | None:
    for a in args:
        text = facts.code.raw(a)
        if facts.code.string_value(*a) is None and "=>" not in text and "function" not in text and _is_auth(text):
            return {"kind": "middleware", "name": text}
    return None


def _handler(facts: Facts, call: Call) -> str | None:
    last = facts.code.raw(call.args[-1]) if call.args else ""
    return last if _NAME.fullmatch(last) else None


def _annotations(facts: Facts, d: Definition, mark: str = r"@([\w.]+)") -> list[tuple[str, str, int]]:
    """(name, text in brackets, place) of the annotations between the member before a definition and its name."""
    c = facts.code
    begin = d.start
    while begin > 0 and c.masked[begin - 1] not in ";{}":
        if c.masked[begin - 1] in ")]":
            begin = c.pairs.get(begin - 1, begin - 1)
        else:
            begin -= 1
    head = c.masked[begin : d.start + c.masked[d.start : d.end].find(d.name)]
    out = []
    for m in re.finditer(mark + r"\s*(\()?", head):
        opened = begin + m.end() - 1
        out.append((m[1], c.text[opened + 1 : c.close(opened)] if m[m.lastindex] == "(" else "", begin + m.start()))
    return out


def _quoted(text: str) -> str | None:
    m = re.search(r"\"([^\"]*)\"|'([^']*)'", text)
    return (m[1] if m[1] is not None else m[2]) if m else None


def _js(facts: Facts) -> None:
    c = facts.code
    for call in c.calls:
        if call.receiver and call.name in _VERBS and call.args and (path := c.string_value(*call.args[0])) is not None:
            facts.route(call.name, path, (call.start, call.end), "call_expression", _middle_auth(facts, call.args[1:]), _handler(facts, call))
        if call.callee == "fetch" or call.callee == "axios" or call.receiver == "axios":
            facts.http_call(call)
    for owner in (d for d in c.definitions if d.kind == "class"):
        marks = _annotations(facts, owner)
        prefix = next((_quoted(t) or "" for n, t, _ in marks if n == "Controller"), "")
        guard = next((t for n, t, _ in marks if n == "UseGuards"), None)
        for d in (x for x in c.definitions if x.kind == "method" and owner.start < x.start < owner.end):
            own = _annotations(facts, d)
            mine = next((t for n, t, _ in own if n == "UseGuards"), guard)
            for name, text, _ in own:
                if name in NEST:
                    path = "/" + "/".join(p.strip("/") for p in (prefix, _quoted(text) or "") if p.strip("/"))
                    facts.route(NEST[name], path, (d.start, d.end), "method_definition", {"kind": "decorator", "name": mine} if mine else None, d.name)


def _python(facts: Facts) -> None:
    c = facts.code
    by_line = {c.line(d.start): d for d in c.definitions if d.kind == "function"}
    for m in re.finditer(r"^[ \t]*@([\w.]+)\.(\w+)\s*\(", c.masked, re.M):
        verb = "ALL" if m[2] == "route" else m[2].upper()
        if m[1].split(".")[-1] not in rules.ROUTE_OBJECTS or (verb.lower() not in _VERBS):
            continue
        opened, line = m.end() - 1, c.line(m.start())
        args = c.split(opened + 1, c.close(opened))
        path = c.string_value(*args[0]) if args else None
        if path is None or not path.startswith("/"):
            continue
        end = c.line(c.close(opened))
        d = next((by_line[k] for k in range(end, end + 12) if k in by_line), None)
        block = c.text[c._lines[line - 1] : d.start] if d else ""
        above = c.masked[: m.start()].rsplit("\n\n", 1)[-1]
        names = re.findall(r"@([\w.]+)", block) + re.findall(r"^\s*@([\w.]+)", above.split("\n\n")[-1], re.M)
        auth = next((n for n in names if _is_auth(n) and not re.search(rf"\b(?:{'|'.join(rules.ROUTE_OBJECTS)})\.", n + ".")), None)
        if auth is None and d is not None and "Depends" in (head := c.text[d.start : c.close(d.extra.get("open", d.start)) + 1]):
            auth = next((n for n in re.findall(r"Depends\(\s*([\w.]+)", head) if _is_auth(n)), None)
        facts.route(verb, path, (m.start(), d.end if d else c.close(opened) + 1), "decorated_definition", {"kind": "decorator", "name": auth} if auth else None, d.name if d else None)
    for call in c.calls:
        if call.callee in ("path", "re_path", "url") and len(call.args) >= 2 and (path := c.string_value(*call.args[0])) is not None:
            if not any(path.lower().endswith(e) for e in rules.FILE_ENDINGS):
                handler = re.sub(r"\(.*", "", c.raw(call.args[1]), flags=re.S).rsplit(".", 1)[-1]
                if not re.match(r"include\b", c.raw(call.args[1])):
                    facts.route("ALL", "/" + path.lstrip("^/"), (call.start, call.end), "call", None, handler or None)
        if call.receiver in ("requests", "httpx") and call.name in _VERBS | {"request"}:
            facts.http_call(call)


def _jvm(facts: Facts) -> None:
    c = facts.code
    if c.language != "scala":
        for d in (x for x in c.definitions if x.kind in ("method", "function")):
            marks = _annotations(facts, d)
            guard = next((n for n, _, _ in marks if n in ("PreAuthorize", "Secured", "RolesAllowed") or _is_auth(n)), None)
            for name, text, at in marks:
                if name in SPRING or name == "RequestMapping":
                    m = re.search(r"METHOD\.(GET|POST|PUT|DELETE|PATCH)", text.upper())
                    verb = SPRING.get(name) or (m[1] if m else "ALL")
                    facts.route(verb, _quoted(text) or "", (at, d.end), d.node_kind, {"kind": "annotation", "name": guard} if guard else None, d.name)
    for call in c.calls:
        text = c.text[call.start : call.end].lower()
        if any(word in text and any(x in text for x in some) for word, some in JVM_CLIENTS):
            facts.http_call(call)


def _dotnet(facts: Facts) -> None:
    c = facts.code
    mark = r"[\[,]\s*([A-Za-z]\w*)"
    for owner in (d for d in c.definitions if d.kind == "class"):
        marks = _annotations(facts, owner, mark)
        prefix = next((_quoted(t) or "" for n, t, _ in marks if n == "Route"), "")
        prefix = prefix.replace("[controller]", re.sub("Controller$", "", owner.name).lower())
        guard = next((n for n, _, _ in marks if n == "Authorize"), None)
        for d in (x for x in c.definitions if x.kind == "method" and owner.start < x.start < owner.end and x.parent == owner.name):
            own = _annotations(facts, d, mark)
            names = {n for n, _, _ in own}
            mine = None if "AllowAnonymous" in names else "Authorize" if "Authorize" in names else guard
            for name, text, at in own:
                if name in ASPNET:
                    path = "/" + "/".join(p.strip("/") for p in (prefix, _quoted(text) or "") if p.strip("/"))
                    facts.route(ASPNET[name], path, (at, d.end), "method_declaration", {"kind": "attribute", "name": mine} if mine else None, d.name)
    for call in c.calls:
        if call.name in MINIMAL and call.args and (path := c.string_value(*call.args[0])) is not None:
            chained = re.match(r"\s*\.\s*RequireAuthorization\b", c.masked[call.end : call.end + 200])
            facts.route(MINIMAL[call.name], path, (call.start, call.end), "invocation_expression", {"kind": "middleware", "name": "RequireAuthorization"} if chained else None, _handler(facts, call))
        text = c.text[call.start : call.end].lower()
        if "client" in text and any(x in text for x in DOTNET_CALLS):
            facts.http_call(call)


def _go(facts: Facts) -> None:
    c = facts.code
    for call in c.calls:
        path = c.string_value(*call.args[0]) if call.args else None
        if call.receiver and path is not None:
            if call.name in GO_VERBS:
                handler = c.raw(call.args[-1]).rsplit(".", 1)[-1] if len(call.args) > 1 else None
                facts.route(GO_VERBS[call.name], path, (call.start, call.end), "call_expression", _middle_auth(facts, call.args[1:]), handler if handler and _NAME.fullmatch(handler) else None)
            elif call.name in ("HandleFunc", "Handle"):
                handler = c.raw(call.args[-1]).rsplit(".", 1)[-1] if len(call.args) > 1 else None
                facts.route("ALL", path, (call.start, call.end), "call_expression", None, handler if handler and _NAME.fullmatch(handler) else None)
        r = call.receiver
        if (r == "http" and call.name in ("Get", "Post", "Head", "NewRequest")) or (r.endswith(("client", "Client")) and call.name in ("Do", "Get", "Post", "Head")) or r == "resty" or call.name == "Execute":
            facts.http_call(call)


def _php(facts: Facts) -> None:
    c = facts.code
    for call in c.calls:
        if re.fullmatch(r"Route::\w+", call.callee) and call.args and (path := c.string_value(*call.args[0])) is not None:
            chain = re.match(r"\s*->\s*middleware\s*\(([^)]*)\)", c.text[call.end : call.end + 400])
            auth = {"kind": "middleware", "name": (_quoted(chain[1]) or chain[1].strip())} if chain and _is_auth(chain[1]) else None
            verb = {"any": "all", "match": "all"}.get(call.name, call.name)
            slashed = "/" + path.strip("/")
            if call.name in ("resource", "apiResource"):
                base = path.strip("/")
                one = "{" + (base[:-1] if base.endswith("s") and len(base) > 1 else base) + "}"
                for v, tail in API_RESOURCE if call.name == "apiResource" else RESOURCE:
                    facts.route(v, f"/{base}" + (f"/{tail.format('')}" if tail not in ("", "{}") else f"/{one}" if tail else ""), (call.start, call.end), "scoped_call_expression", auth)
            elif verb in _VERBS:
                action = re.findall(r"'(\w+)'\s*\]?\s*$|@(\w+)", c.raw(call.args[-1])) if len(call.args) > 1 else []
                facts.route(verb, slashed if not path.startswith("/") else path, (call.start, call.end), "scoped_call_expression", auth, next((a or b for a, b in action), None))
        if re.match(r"(?:Http|Guzzle)::", call.callee):
            facts.http_call(call)


def _ruby(facts: Facts) -> None:
    c = facts.code
    found = []
    lines = re.finditer(r"^[ \t]*(get|post|put|patch|delete|resources|before_action)\b[ \t(]+([^\n]*)", c.masked, re.M)
    for m in lines:
        text = c.text[m.start(2) : m.end(2)]
        span = (m.start(1), m.end(2))
        if m[1] == "before_action":
            if (s := re.match(r":(\w+)", text)) and _is_auth(s[1]):
                for row in facts.rows["interfaces"]:
                    row["auth"] = row["auth"] or {"kind": "before_action", "name": s[1]}
        elif m[1] == "resources":
            if s := re.match(r":(\w+)", text):
                facts.route("ALL", "/" + s[1], span, "call")
        else:
            path = _quoted(text) if text[:1] in "'\"" else None
            if path and path.startswith("/"):
                to = re.search(r"(?:to:|=>)\s*['\"]([\w/]+)#(\w+)['\"]", text)
                facts.route(m[1], path, span, "call", None, f"{to[1]}#{to[2]}" if to else None)
        found.append(m)
    for call in c.calls:
        if (re.fullmatch(r"Net::HTTP|HTTParty|Faraday|RestClient|HTTP", call.receiver) and call.name in _VERBS | {"start", "new", "get_response", "post_form"}):
            facts.http_call(call)
