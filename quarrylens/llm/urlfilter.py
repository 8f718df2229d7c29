"""URL rules as globs, matched by a bit-parallel Shift-And automaton over batches of URLs.

All patterns of a rule set share one row of 64-bit words: every pattern position is one bit, `*` (any run
without `/`) and `**` (any run) are positions that may stay.  A batch of URLs steps through the automaton
together, one byte position at a time, so the cost is the longest URL's bytes times the words of the masks.

A URL is put into canonical form first: `.` + host (ASCII letters lower-cased) + path.  The leading dot lets
one pattern `*.host/path` stand for a host and all its subdomains: a subdomain differs by a run before the dot,
and `*` cannot run over the `/` that ends the host.

Defined results: a null URL or one without `://` has an empty host and path and gets the default verdict;
repeated rows are judged alike; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.llm.rows import pick
from quarrylens.session import ship_package

#: (verdict, host and path) of the rules that the query applies
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class GlobAutomaton:
    """Multiword Shift-And masks of many globs; a glob that ends in `**` matches as a prefix."""

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        bits: list[tuple[int, bool, int | None, bool]] = []  # (pattern, starts it, byte or None, crosses /)
        self.n_words = 1
        position, first, final, stay_any, stay_host, symbols = 0, [], [], [], [], []
        for glob in self.globs:
            tokens, i = [], 0
            while i < len(glob):
                if glob.startswith("**", i):
                    tokens, i = [*tokens, "**"], i + 2
                elif glob[i] == "*":
                    tokens, i = [*tokens, "*"], i + 1
                else:
                    tokens, i = [*tokens, glob[i].encode()], i + 1
            first.append(position)
            # state `position` waits before the first symbol; a star marks its state as one that may stay
            for t in tokens:
                if t == "**":
                    stay_any.append(position)
                elif t == "*":
                    stay_host.append(position)
                else:
                    for byte in t:
                        symbols.append((position + 1, byte))
                        position += 1
            final.append(position)
            position += 1
        self.n_words = position // 64 + 1
        self.first, self.final = np.array(first, np.int64), np.array(final, np.int64)
        self.start = self._mask(first)
        self.stay_any, self.stay_host = self._mask(stay_any), self._mask(stay_host)
        self.table = np.zeros((256, self.n_words), np.uint64)
        for bit, byte in symbols:
            self.table[byte, bit // 64] |= np.uint64(1 << (bit % 64))

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.n_words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A boolean for each text and glob: the glob matches the whole text."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
        ordered = lengths[order]
        state = np.repeat(self.start[None, :], n, 0)
        active = np.searchsorted(-ordered, -np.arange(int(ordered[0]) if n else 0), "left")  # texts longer than j
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(ordered[0]) if n else 0):
            k = int(active[j])
            byte = data[offsets[:k] + j]
            now = state[:k]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            stay = now & self.stay_any
            stay |= np.where((byte != 47)[:, None], now & self.stay_host, np.uint64(0))
            state[:k] = (shifted & self.table[byte]) | stay
        out = np.empty((n, len(self.globs)), bool)
        out[order] = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & one
        return out


def rule_glob(rule: str) -> str:
    """The glob of a host/path rule over canonical URLs; `*` in a rule stays a wildcard."""
    return f"*.{rule}**"


class Matcher:
    """Longest fitting rule of every canonical URL; equally long rules: the smaller text."""

    def __init__(self, rules: Sequence[tuple[str, str]], default: str = "allow", chunk: int = 4096, state_words: int = 1 << 21):
        self.rules = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))
        self.default, self.chunk, self.state_words = default, chunk, state_words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = GlobAutomaton([rule_glob(r) for _, r in self.rules])
        names = pa.array([r for _, r in self.rules], pa.string())
        verdicts = pa.array([v for v, _ in self.rules] + [self.default], pa.string())
        chunk = max(1, min(self.chunk, self.state_words // auto.n_words))  # the states of a chunk are chunk x n_words
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                host, path = part.column("host").to_pylist(), part.column("path").to_pylist()
                hit = auto.match([f".{h}{p}".encode() for h, p in zip(host, path, strict=True)]) if self.rules else np.zeros((part.num_rows, 0), bool)
                best = np.where(hit.any(1), hit.argmax(1), len(self.rules)) if self.rules else np.zeros(part.num_rows, np.int64)
                none = best == len(self.rules)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column("host"), part.column("path"), names.take(pa.array(best, mask=none)) if self.rules else pa.nulls(part.num_rows, pa.string()), verdicts.take(pa.array(best))],
                    names=[part.schema.names[0], "host", "path", "rule", "verdict"],
                )


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, the longest fitting rule (null: none) and its verdict (none: the default)."""
    ship_package(pages.sparkSession)
    pages = pick(pages, key=key, url=url)
    parts = pages.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = parts.schema[0].dataType.simpleString()
    found = parts.mapInArrow(Matcher(rules, default), f"key {kind}, host string, path string, rule string, verdict string")
    return found.withColumnRenamed("key", key)
