"""Workspace manifests: which packages a source tree holds.

Manifests are small files, read on the driver: from a folder, or from a table of files, of which only the manifests and
the folders that their patterns name reach it."""

from __future__ import annotations

import glob
import json
import os
import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Workspace:
    kind: str
    packages: tuple[tuple[str, str], ...]  # name, root relative to the tree

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, r, i) for i, (n, r) in enumerate(self.packages)]
        return spark.createDataFrame(rows, "name string, root string, ordinal int")


class Folder:
    """A tree in a folder of this machine."""

    def __init__(self, root: str):
        self.root = root

    def read(self, path: str) -> str | None:
        try:
            with open(os.path.join(self.root, path), encoding="utf-8") as f:
                return f.read()
        except (OSError, UnicodeDecodeError):
            return None

    def having(self, folders: list[str]) -> list[str]:
        """Those of the folders that are there."""
        return [x for x in folders if os.path.isdir(os.path.join(self.root, x))]

    def folders(self, pattern: str) -> list[str]:
        """Folders that match a glob pattern, in order."""
        hits = glob.glob(os.path.join(self.root, pattern), recursive=True)
        return sorted(os.path.relpath(d, self.root) for d in hits if os.path.isdir(d))


#: fixed values: names of the files that describe workspaces and packages
MANIFESTS = ("pnpm-workspace.yaml", "package.json", "Cargo.toml", "go.work", "go.mod", "pyproject.toml")


@dataclass
class Files:
    """A tree in a table files(path, content), on any file system."""

    files: DataFrame
    manifests: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        self.manifests = {r.path: r.content for r in self.files.where(name.isin(*MANIFESTS)).select("path", "content").collect()}  # one a package

    def read(self, path: str) -> str | None:
        return self.manifests.get(os.path.normpath(path))

    def _folders(self) -> DataFrame:
        """d: every folder above a file, once for each file."""
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        return self.files.where(F.size(parts) > 1).select(F.explode(above).alias("d"))

    def _matching(self, regex: str) -> list[str]:
        """Folders of the files whose path, with a slash at its end, matches."""
        found = self._folders().where(F.concat("d", F.lit("/")).rlike(f"^{regex}$"))
        return sorted(r.d for r in found.distinct().collect())  # the folders that a pattern names

    @cached_property
    def _above(self) -> set[str]:
        """The folders above the manifests."""
        out = {"."}
        for path in self.manifests:
            while (path := os.path.dirname(path)) and path not in out:
                out.add(path)
        return out

    def having(self, folders: list[str]) -> list[str]:
        """Those of the folders that are there; the ones that hold no manifest are looked up in one join."""
        plain = {x: os.path.normpath(x) for x in folders}
        rest = sorted({d for d in plain.values() if d not in self._above})
        there = set(self._above)
        if rest:
            spark = self.files.sparkSession
            asked = spark.createDataFrame([(d,) for d in rest], "d string")
            there |= {r.d for r in self._folders().distinct().join(asked, "d", "left_semi").collect()}  # of those that were asked for
        return [x for x in folders if plain[x] in there]

    def folders(self, pattern: str) -> list[str]:
        """Folders that match a glob pattern, in order."""

        def step(x: str) -> str:
            if x == "**":
                return "(?:[^/.][^/]*/)*"
            one = re.escape(x).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            return ("(?!\\.)" if x[0] in "*?" else "") + one + "/"

        return self._matching("".join(step(x) for x in os.path.normpath(pattern).split("/")))


def _toml(text: str | None) -> dict:
    try:
        return tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return {}


def _json(text: str | None) -> dict:
    try:
        out = json.loads(text or "{}")
        return out if isinstance(out, dict) else {}
    except json.JSONDecodeError:
        return {}


def expand(tree: Folder | Files, patterns: Iterable[str]) -> list[str]:
    """Folders that match glob patterns, relative to the root; patterns with a leading `!` take some out again."""
    found: dict[str, None] = {}
    for p in patterns:
        for h in tree.folders(p.lstrip("!")):
            found.pop(h, None) if p.startswith("!") else found.setdefault(h)
    return list(found)


def _workspace(kind: str, tree: Folder | Files, patterns: Iterable[str], name) -> Workspace | None:
    packages = [(name(d) or d, d) for d in expand(tree, patterns)]
    return Workspace(kind, tuple(packages)) if packages else None


def _npm_name(tree: Folder | Files):
    return lambda d: _json(tree.read(os.path.join(d, "package.json"))).get("name")


def detect_pnpm(tree: Folder | Files) -> Workspace | None:
    text = tree.read("pnpm-workspace.yaml")
    if text is None:
        return None
    block = re.search(r"^packages:[ \t]*\n((?:[ \t]*(?:-[^\n]*|#[^\n]*)?\n?)*)", text + "\n", re.M)
    listed = re.findall(r"^[ \t]*-[ \t]*['\"]?([^'\"#\n]+?)['\"]?[ \t]*(?:#.*)?$", block[1], re.M) if block else []
    return _workspace("pnpm", tree, listed, _npm_name(tree))


def detect_npm(tree: Folder | Files) -> Workspace | None:
    listed = _json(tree.read("package.json")).get("workspaces")
    if isinstance(listed, dict):
        listed = listed.get("packages")
    return _workspace("npm", tree, [x for x in listed if isinstance(x, str)], _npm_name(tree)) if isinstance(listed, list) else None


def detect_cargo(tree: Folder | Files) -> Workspace | None:
    listed = _toml(tree.read("Cargo.toml")).get("workspace", {}).get("members")
    return _workspace("cargo", tree, listed, lambda d: _toml(tree.read(os.path.join(d, "Cargo.toml"))).get("package", {}).get("name")) if listed else None


def detect_go(tree: Folder | Files) -> Workspace | None:
    text = tree.read("go.work")
    if text is None:
        return None
    plain = re.sub(r"//[^\n]*", "", text)
    listed = [w for block in re.findall(r"^\s*use\s*\(([^)]*)\)", plain, re.M) for w in block.split()] + re.findall(r"^\s*use\s+([^(\s]+)", plain, re.M)
    module = lambda d: (m[1] if (m := re.search(r"^module\s+(\S+)", tree.read(os.path.join(d, "go.mod")) or "", re.M)) else None)
    dirs = [os.path.normpath(x) for x in tree.having(listed)]
    return Workspace("go", tuple((module(d) or d, d) for d in dirs)) if dirs else None


def detect_uv(tree: Folder | Files) -> Workspace | None:
    listed = _toml(tree.read("pyproject.toml")).get("tool", {}).get("uv", {}).get("workspace", {}).get("members")
    return _workspace("uv", tree, listed, lambda d: _toml(tree.read(os.path.join(d, "pyproject.toml"))).get("project", {}).get("name")) if listed else None


def detect_workspace(tree: str | DataFrame) -> Workspace | None:
    """The first kind of manifest that names packages (pnpm, npm, cargo, go, uv) in a folder or a table of files."""
    tree = Folder(tree) if isinstance(tree, str) else Files(tree)
    for detect in (detect_pnpm, detect_npm, detect_cargo, detect_go, detect_uv):
        found = detect(tree)
        if found:
            return found
    return None
