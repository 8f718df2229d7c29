"""Scalar operators as Column expressions: paths, roles, words, names, routes.  Everything stays in the JVM."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, functions as F

from quarrylens.functions import rules


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


# --- paths


def parts(path: Column) -> Column:
    return F.split(path, r"[/\\]")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column) -> Column:
    """After the last dot of the name, unless that dot starts the name; null without one."""
    ext = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(ext != "", ext)


def directory(path: Column) -> Column:
    """Everything before the last `/`; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in rules.LANGUAGE_OF_EXTENSION.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def file_role(path: Column) -> Column:
    """Role label by the first rule that fits; rules look at whole path components and at the name."""
    name = file_name(path)
    low, ext = F.lower(name), F.coalesce(extension(path), F.lit(""))
    within = lambda names: F.arrays_overlap(parts(path), F.array(*(F.lit(n) for n in names)))
    ends = lambda names: low.rlike(f"({_any_of(names)})$")
    return (
        F.when(within(rules.GENERATED_DIRECTORIES) | low.rlike(_any_of(rules.GENERATED_PARTS)) | ends(rules.GENERATED_ENDINGS), "generated")
        .when(within(rules.TEST_DIRECTORIES) | ends(rules.TEST_ENDINGS) | low.rlike(r"(?s)^test_.*\.(py|rb)$"), "test")
        .when(within(rules.DOC_DIRECTORIES), "docs")
        .when(name.isin(*rules.BUILD_NAMES), "build")
        .when(ext.isin(*rules.CONFIG_EXTENSIONS) | low.startswith(".env") | name.isin(*rules.CONFIG_NAMES), "config")
        .when(ext.isin(*rules.DOC_EXTENSIONS), "docs")
        .when(ext.isin(*rules.CODE_EXTENSIONS), "impl")
        .otherwise("other")
    )


def normalize_path(path: Column, keep_leading_up: bool = True) -> Column:
    """Resolve `.` and `..` by name; a `..` with nothing before it is kept, or dropped if keep_leading_up is off."""
    rooted = path.startswith("/")
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        stuck = F.array_append if keep_leading_up else (lambda d, _: d)
        up = F.when(F.size(done) == 0, F.when(rooted, done).otherwise(stuck(done, x))).when(last == "..", stuck(done, x)).otherwise(F.slice(done, F.lit(1), F.size(done) - 1))
        return F.when(x == "..", up).otherwise(F.array_append(done, x))

    out = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), out)).otherwise(out)


def make_relative(path: Column, root: Column) -> Column:
    """path without the leading root, if it lies below it."""
    below = path.startswith(F.concat(root, F.lit("/")))
    return F.when((root != "") & below, F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def append_extension(path: Column, ext: Column | str) -> Column:
    return F.concat(path, F.lit(ext) if isinstance(ext, str) else ext)


def ancestors(path: Column) -> Column:
    """Every directory above a file, the root `` first."""
    steps = F.split(directory(path), "/")
    below = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    return F.when(directory(path) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), below))


def module_name(path: Column) -> Column:
    """`__root__` for at most one component, the first of two, else the first two joined."""
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(p) <= 1, F.lit(rules.ROOT_MODULE)).when(F.size(p) == 2, F.element_at(p, 1)).otherwise(F.array_join(F.slice(p, 1, 2), "/"))


def is_relative_import(source: Column) -> Column:
    return source.startswith("./") | source.startswith("../")


def normalize_python_relative(source: Column) -> Column:
    """`.x` -> `./x`, `..x` -> `../x`, one more `../` for each further dot; null unless relative.

    JavaScript sources (`./x`, `../x`) are not Python's and give null, too."""
    dots, rest = F.regexp_extract(source, r"^(\.+)", 1), F.regexp_extract(source, r"^\.+(.*)$", 1)
    n = F.length(dots)
    up = F.when(n == 1, F.lit("./")).otherwise(F.repeat(F.lit("../"), n - 1))
    return F.when((n > 0) & ~rest.startswith("/"), F.concat(up, rest))


def effective_specifiers(specifiers: Column, source: Column) -> Column:
    return F.when(F.coalesce(F.size(specifiers), F.lit(0)) > 0, specifiers).otherwise(F.array(source))


# --- text


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def contains_pii(text: Column) -> Column:
    return F.lower(text).rlike(_any_of(rules.PII_WORDS))


def is_auth_indicator(name: Column) -> Column:
    return F.lower(name).rlike(_any_of(rules.AUTH_WORDS))


def http_method(name: Column) -> Column:
    up = F.upper(name)
    return F.when(up.isin(*rules.HTTP_VERBS), up)


def path_params(path: Column) -> Column:
    """Names of `:p`, then `{p}` or `{p:rule}`, then `<p>` or `<type:p>`; each name once."""
    colon = F.transform(F.filter(F.split(path, "/"), lambda x: x.startswith(":")), lambda x: F.substring_index(F.substring(x, 2, 1 << 20), "(", 1))
    brace = F.transform(F.regexp_extract_all(path, F.lit(r"\{([^}]*)\}"), F.lit(1)), lambda x: F.trim(F.substring_index(x, ":", 1)))
    angle = F.transform(F.regexp_extract_all(path, F.lit(r"<([^>]*)>"), F.lit(1)), lambda x: F.trim(F.substring_index(x, ":", -1)))
    return F.array_distinct(F.filter(F.concat(colon, F.filter(F.concat(brace, angle), lambda x: ~x.contains(" "))), lambda x: x != ""))


def unquote(text: Column) -> Column:
    """The inside of a literal in single, double or back quotes; other text as it is."""
    for q in "'\"`":
        text = F.when((F.length(text) >= 2) & text.startswith(q) & text.endswith(q), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return text


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def bare_name(name: Column) -> Column:
    """After the last `::`; without one after the last `.`; without that after the last `->`."""
    return (
        F.when(name.contains("::"), F.substring_index(name, "::", -1))
        .when(name.contains("."), F.substring_index(name, ".", -1))
        .when(name.contains("->"), F.substring_index(name, "->", -1))
        .otherwise(name)
    )


def compose_path(prefix: Column, sub: Column) -> Column:
    """`/prefix/sub` with single slashes; `/` if both are empty."""
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "")
    return F.concat(F.lit("/"), F.array_join(F.filter(F.array(trim(prefix), trim(sub)), lambda x: x != ""), "/"))


def is_interface_name(name: Column) -> Column:
    return name.rlike(r"^I\p{Lu}")


def is_route_object(name: Column) -> Column:
    return name.isin(*rules.ROUTE_OBJECTS)


def looks_like_file_path(text: Column) -> Column:
    return F.lower(text).rlike(f"({_any_of(rules.FILE_ENDINGS)})$")


def visibility_keyword(word: Column) -> Column:
    return F.when(word.isin("public", "private", "protected", "internal"), word)


def is_stdlib_module(name: Column) -> Column:
    """Python only; by top-level name."""
    return F.substring_index(name, ".", 1).isin(*sorted(sys.stdlib_module_names))


def signature(text: Column, language: Column) -> Column:
    """Cut at `{`; for Python at the first `:`; for Ruby at the first line end."""
    cut = F.when(language == "python", F.substring_index(text, ":", 1)).when(language == "ruby", F.substring_index(text, "\n", 1)).otherwise(F.substring_index(text, "{", 1))
    return F.trim(cut)


def clean_block_comment(text: Column) -> Column:
    """Lines of a `/** */` comment without its marks."""
    inside = F.regexp_replace(F.regexp_replace(F.trim(text), r"^/\*+", ""), r"\*+/$", "")
    lines = F.transform(F.split(inside, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_docstring(text: Column) -> Column:
    """Inside of a Python docstring, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^[rRuUbB]*(\"\"\"|'''|\"|')", ""), "(\"\"\"|'''|\"|')$", ""))


def anchor(file: Column, line: Column, end_line: Column | None = None, start_byte: Column | None = None, end_byte: Column | None = None, kind: Column | None = None) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(
        file.alias("file"),
        line.cast("long").alias("line"),
        (line if end_line is None else end_line).cast("long").alias("end_line"),
        (zero if start_byte is None else start_byte.cast("long")).alias("start_byte"),
        (zero if end_byte is None else end_byte.cast("long")).alias("end_byte"),
        (F.lit("") if kind is None else kind).alias("node_kind"),
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def role_name(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in rules.ROLE_NAME.items() for x in kv))[label]


def display_name(kind: Column, name: Column, path: Column, method: Column) -> Column:
    """What a graph node is called: files by path, endpoints by method and path, the rest by name."""
    return F.when(kind == "file", path).when(kind == "interface", F.concat_ws(" ", method, path)).otherwise(name)
