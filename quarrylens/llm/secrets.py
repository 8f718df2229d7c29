"""Secret scans with SQL functions only: base patterns, then a randomness test battery on other long tokens.

Base spans come from three patterns (assign, access, hex).  Every other run of 20 or more key characters, but
for plain numbers, is a candidate.  Its encoding (hex, base32, base64) follows from its characters, and four figures are computed over
that alphabet:

* chi-squared test that its characters are uniform over the alphabet;
* Wald-Wolfowitz runs test over characters in the upper and lower half of the alphabet;
* lag-one serial correlation of the characters' places in the alphabet;
* coincidence test against word-like text: how unlikely text of this length has so few equal characters.

Two Benjamini-Hochberg procedures decide, both within classes of similar length, over the candidates of the whole
corpus, from histograms of rounded-up p-values.  The first takes the battery's p-value (the least of the first three,
times three), whose null is "this is random": what it rejects is uneven and goes, and of tokens that are random no more
than a share of FALSE_REJECTIONS of all that go.  The second takes the fourth figure, whose null is "this is ordinary
text" and whose spread shrinks with the token's length: what it rejects is no text, and no more than a share of
FALSE_DISCOVERIES of it is.  Candidates that stay in the first and are rejected in the second become `random` spans.

Positions are code points: the pieces between matches, from split(), and the matches have lengths that add up.

Defined results: a null or empty text has no spans; repeated rows get equal results; an empty table gives an
empty table; extra columns are ignored; there is no limit on a text's length or its number of spans, and the work for
a text grows with its length and its spans, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.llm.rows import pick
from quarrylens.session import Scratch

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def any_case(pattern: str) -> str:
    """ASCII letters in either case, written out so that all regex engines agree."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


ASSIGN = "(" + "|".join(any_case(k) for k in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: runs can't hold a shorter match of their own kind, so a bounded repeat finds the same spans faster
ACCESS_LONG, HEX_LONG = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
MIN_ASSIGN = 6
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "hex": (16, "0123456789abcdef"),
    "base32": (32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": (64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: chance that two characters of ordinary (structured) tokens are equal, by encoding
COINCIDENCE = {"hex": 0.130, "base32": 0.080, "base64": 0.066}
LENGTH_CLASSES = (32, 48, 64, 128)
FALSE_DISCOVERIES, FALSE_REJECTIONS, P_STEPS = 0.01, 0.001, 20  # P_STEPS: histogram buckets for each factor of ten

_SPAN, _TOKEN = "array<struct<start:int,kind:int,end:int>>", "array<struct<start:int,kind:int,end:int,token:string>>"
_STEPS = 256  # matches whose spans are put together at a time


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _found(text: Column, regex: str, kind: int, group: int | None = None, least: int = 0, tokens: bool = False) -> Column:
    """Spans of the leftmost non-overlapping matches, with tokens also their text; with a group, of those whose group
    is long enough.  Arrays grow by blocks of _STEPS spans."""
    every = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else F.array().cast("array<string>")
    schema = _TOKEN if tokens else _SPAN

    def steps(x: Column) -> Column:
        own = F.arrays_zip(x["m"].alias("m"), x["g"].alias("g")) if group else F.transform(x["m"], lambda m: F.struct(m.alias("m"), m.alias("g")))
        text_of = (lambda o: [o["m"].alias("token")]) if tokens else (lambda o: [])
        return F.zip_with(
            F.slice(x["pieces"], F.lit(1), F.size(x["m"])),
            own,
            lambda p, o: F.struct(F.length(p).alias("gap"), F.length(o["m"]).alias("len"), F.length(o["g"]).alias("own"), *text_of(o)),
        )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *([x["token"].alias("token")] if tokens else [])))
        return F.struct(end.alias("at"), F.when(x["own"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def spans(s: Column) -> Column:
        def block(acc: Column, i: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.array().cast(schema).alias("out"))
            part = F.aggregate(F.slice(s, i * _STEPS + 1, F.lit(_STEPS)), start, step)
            return _let(part, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        last = F.floor((F.size(s) - 1) / F.lit(_STEPS)).cast("int")
        return F.aggregate(F.sequence(F.lit(0), last), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{schema}>").alias("out")), block, lambda acc: F.flatten(acc["out"]))

    matches = F.struct(F.split(text, regex, -1).alias("pieces"), every.alias("m"), groups.alias("g"))
    return F.when(text.rlike(regex), _let(_let(matches, steps), spans)).otherwise(F.array().cast(schema))


def _meets(spans: Column, c: Column) -> Column:
    """Whether any of the spans, which are in order and apart, overlaps c; by halving."""

    def halve(acc: Column, _: Column) -> Column:
        return _let(
            ((acc["lo"] + acc["hi"]) / 2).cast("int"),
            lambda mid: F.when(F.get(spans, mid)["start"] < c["end"], F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi"))),
        )

    turns = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    before = F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda acc: acc["lo"])
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(_let(before, lambda n: F.coalesce(F.get(spans, n - 1)["end"] > c["start"], F.lit(False))))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": _found(text, ASSIGN, 0, 2, MIN_ASSIGN),
        "access": _found(text, ACCESS_LONG, 1),
        "hex": _found(text, HEX_LONG, 2),
    }


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), relative error below 0.3 % (a rational bound times the normal density)."""
    a = F.abs(z)
    q = F.exp(-a * a / 2) / (0.661 * a + 0.339 * F.sqrt(a * a + 5.51)) / F.lit(2.5066282746310002)
    return F.when(z >= 0, q).otherwise(1 - q)


def _encoding(token: Column) -> Column:
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex")).when(token.rlike("^[A-Z2-7]+$"), F.lit("base32")).otherwise(F.lit("base64"))


def battery(token: Column) -> Column:
    """Struct of encoding, n, p_uniform, p_runs, p_serial and p_text of a token."""

    def kind(enc: Column) -> Column:
        pick = lambda table: F.when(enc == "hex", F.lit(table["hex"])).when(enc == "base32", F.lit(table["base32"])).otherwise(F.lit(table["base64"]))
        plain = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
        return F.struct(
            enc.alias("encoding"),
            pick({n: float(a[0]) for n, a in ALPHABETS.items()}).alias("k"),
            pick({n: a[1] for n, a in ALPHABETS.items()}).alias("alphabet"),
            pick(COINCIDENCE).alias("kappa"),
            F.when(enc == "hex", F.lower(plain)).otherwise(plain).alias("plain"),
        )

    def places(t: Column) -> Column:
        chars = F.filter(F.split(t["plain"], ""), lambda c: c != "")
        return F.struct(
            t.alias("t"), F.array_distinct(chars).alias("distinct"), F.transform(chars, lambda c: (F.instr(t["alphabet"], c) - 1).cast("double")).alias("places"), F.length(t["plain"]).cast("double").alias("n")
        )  # all characters are in the alphabet

    def sums(x: Column) -> Column:
        t, k = x["t"], x["t"]["k"]
        mean = (k - 1) / 2
        squares = F.aggregate(x["distinct"], F.lit(0.0), lambda acc, c: acc + F.pow(x["n"] - F.length(F.replace(t["plain"], c, F.lit(""))), F.lit(2.0)))
        walk = F.aggregate(
            F.slice(x["places"], F.lit(2), F.size(x["places"])),
            F.struct(F.element_at(x["places"], 1).alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("serial")),
            lambda acc, v: F.struct(
                v.alias("last"),
                (acc["runs"] + F.when((v > mean) != (acc["last"] > mean), 1.0).otherwise(0.0)).alias("runs"),
                (acc["serial"] + (v - mean) * (acc["last"] - mean)).alias("serial"),
            ),
        )
        return F.struct(t["encoding"].alias("encoding"), k.alias("k"), t["kappa"].alias("kappa"), x["n"].alias("n"), squares.alias("squares"), walk.alias("walk"))

    def scores(x: Column) -> Column:
        n, k, kappa = x["n"], x["k"], x["kappa"]
        df, pairs = k - 1, n * (n - 1) / 2
        chi2 = F.greatest(k / n * x["squares"] - n, F.lit(0.0))
        z = {
            "uniform": (F.pow(chi2 / df, F.lit(1.0 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
            "runs": F.abs(x["walk"]["runs"] - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4),
            "serial": F.abs(x["walk"]["serial"]) / ((k * k - 1) / 12) / F.sqrt(n - 1),
            "text": (pairs * kappa - (x["squares"] - n) / 2) / F.sqrt(1.5 * pairs * kappa * (1 - kappa)),
        }
        return F.struct(x["encoding"].alias("encoding"), n.cast("int").alias("n"), *(v.alias(f"z_{name}") for name, v in z.items()))

    def tails(x: Column) -> Column:
        p = {name: _upper_tail(x[f"z_{name}"]) * (1 if name in ("uniform", "text") else 2) for name in ("uniform", "runs", "serial", "text")}
        return F.struct(x["encoding"].alias("encoding"), x["n"].alias("n"), *(v.alias(f"p_{name}") for name, v in p.items()))

    return _let(_let(_let(_let(_let(_encoding(token), kind), places), sums), scores), tails)


def _length_class(n: Column) -> Column:
    out = F.lit(len(LENGTH_CLASSES))
    for i, least in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(n < least, F.lit(i)).otherwise(out)
    return out


def _bucket(p: Column) -> Column:
    return F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * P_STEPS).cast("int")


def scan_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base spans of each kind, and the candidates outside them with their p-values; no text any more."""
    docs = pick(docs, doc_id=key, text=text)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", *(c.alias(k) for k, c in base_spans(F.col("t")).items()))
    outside = lambda c: ~(_meets(F.col("assign"), c) | _meets(F.col("access"), c) | _meets(F.col("hex"), c))
    tokens = F.filter(_found(F.col("t"), CANDIDATE, 3, tokens=True), lambda c: ~c["token"].rlike("^[0-9]+$") & outside(c))
    base = base.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))).withColumn("_c", tokens)
    tested = F.transform("_c", lambda c: F.struct(F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")).alias("span"), battery(c["token"]).alias("b")))
    empty = F.array().cast("array<struct<span:struct<start:int,kind:int,end:int>,class:int,bucket:int,uneven:int>>")
    found = F.transform(
        tested,
        lambda x: F.struct(
            x["span"].alias("span"),
            _length_class(x["b"]["n"]).alias("class"),
            _bucket(x["b"]["p_text"]).alias("bucket"),
            _bucket(F.least(F.lit(1.0), 3 * F.least(x["b"]["p_uniform"], x["b"]["p_runs"], x["b"]["p_serial"]))).alias("uneven"),
        ),
    )
    return base.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), "base", F.when(F.size("_c") > 0, found).otherwise(empty).alias("found"))


def discoveries(scanned: DataFrame) -> DataFrame:
    """One row: for each length class the smallest bucket that Benjamini-Hochberg rejects, of text (`least`) and of
    randomness (`uneven`).

    A bucket's p-values count as its upper edge, which can only make the procedure stricter.  The histograms have
    at most 5 classes x 601 buckets each.
    """
    f = F.explode("found").alias("f")
    seen = scanned.select(f).select(F.col("f.class").alias("class"), F.explode(F.array(*(F.struct(F.lit(i).alias("null"), F.col(f"f.{c}").alias("bucket")) for i, c in enumerate(("bucket", "uneven"))))).alias("x"))
    hist = seen.groupBy("class", F.col("x.null").alias("null"), F.col("x.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("class", "null")
    ranked = hist.withColumn("m", F.sum("n").over(by)).withColumn("k", F.sum("n").over(by.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)))
    level = F.when(F.col("null") == 0, F.lit(FALSE_DISCOVERIES)).otherwise(F.lit(FALSE_REJECTIONS))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bucket") / P_STEPS) <= level * F.col("k") / F.col("m"))
    least = passed.groupBy("class", "null").agg(F.min("bucket").alias("bucket"))
    of = lambda i: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("null") == i, F.struct("class", "bucket"))), lambda x: x.isNotNull()))
    return least.agg(of(0).alias("least"), of(1).alias("uneven"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of docs."""
    spark = docs.sparkSession
    scanned = Scratch(spark, "secrets").table(scan_text(docs, key, text), "scanned")
    out = scanned.crossJoin(F.broadcast(discoveries(scanned)))  # one row
    text_like = lambda f: ~F.coalesce(f["bucket"] >= F.try_element_at(F.col("least"), f["class"]), F.lit(False))
    uneven = lambda f: F.coalesce(f["uneven"] >= F.try_element_at(F.col("uneven"), f["class"]), F.lit(False))
    added = F.transform(F.filter("found", lambda f: ~text_like(f) & ~uneven(f)), lambda f: f["span"])
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", added))).alias("spans"), F.size(added).cast("long").alias("n_random")
    )
