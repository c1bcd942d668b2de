"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

Everything here is DataFrame functions. Spans are in code points, end
exclusive. The base kinds are assign, access and hex; each takes the leftmost
matches that don't overlap and drops those that are too short. The entropy
kinds add spans: within every run of a character class that is at least WINDOW
long, a window slides by one character at a time while the counts of its
characters are kept up to date, which gives the Shannon entropy of each window
from that of the one before; windows over the class's threshold join to spans.
A window that overlaps a match of an allow-list pattern is left out, and so is
an entropy span that lies in a base span.

Null and empty texts have no spans. Texts are scanned whole, in time that
follows their length; extra columns are ignored by the scan and kept by
redact(), whatever their names, and repeated rows scanned alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Windows of a run that are slid over in one go, and matches whose places are summed up in one go.
STRETCH, MATCHES = 1024, 512

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

# Character classes of the entropy kinds: name, characters, bits that a window must reach, what its run must hold.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", 2.9, ("[0-9]", "[a-fA-F]")),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7, ("[0-9]", "[A-Z]", "[a-z]")),
)
# Candidates that are no secrets: alphabets and counts in order, placeholders, one class of letter repeated.
ALLOWED = (
    r"0123456789|abcdefghijkl|ABCDEFGHIJKL",
    r"(?i)example|placeholder|changeme|your[_-]",
    r"(.)\1{7}",
)
#: The same, with a repeated letter taken to its last.
_ALLOWED_WHOLE = tuple(a.replace("{7}", "{7,}") for a in ALLOWED)
KINDS = ("assign", "access", "hex", *(name for name, *_ in CLASSES))
_SPAN = "array<struct<begin:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<begin, hit>> of the matches, leftmost first.

    Places are summed up block by block, so that many matches take little more
    than time in proportion to their number.
    """
    laid = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    found = "array<struct<begin:int,hit:string>>"

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        own = F.array(F.struct(begin.alias("begin"), x["hit"].alias("hit")))
        return F.when(x["hit"].isNull(), s).otherwise(F.struct((begin + F.length(x["hit"])).alias("at"), F.concat(s["found"], own).alias("found")))

    def within(block: Column) -> Column:
        return F.aggregate(block["rows"], F.struct(block["at"].alias("at"), F.array().cast(found).alias("found")), step, lambda s: s["found"])

    def placed(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / MATCHES).cast("int")), lambda k: F.slice(rows, k * MATCHES + 1, F.lit(MATCHES)))
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,rows:array<struct<gap:string,hit:string>>>>").alias("blocks"))
        begun = F.aggregate(blocks, start, lambda s, block: F.struct((s["at"] + length(block)).alias("at"), F.concat(s["blocks"], F.array(F.struct(s["at"].alias("at"), block.alias("rows")))).alias("blocks")), lambda s: s["blocks"])
        return F.flatten(F.transform(begun, within))

    return F.element_at(F.transform(F.array(laid), placed), 1)


def _base(text: Column, kind: int, pattern: str, good) -> Column:
    spans = F.transform(F.filter(_matches(text, pattern), good), lambda m: F.struct(m["begin"].alias("begin"), F.lit(kind).alias("kind"), (m["begin"] + F.length(m["hit"])).alias("end")))
    return F.when(text.rlike(pattern), spans.cast(_SPAN)).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, sorted by start, then kind as listed."""
    assign = _base(text, 0, ASSIGN, lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 8)
    access = _base(text, 1, ACCESS, lambda m: F.length(m["hit"]) >= 16)
    # runs are whole either way, so the length may stand in the pattern
    hexes = _base(text, 2, HEX.replace("+", "{32,}"), lambda m: F.lit(True))
    return F.array_sort(F.concat(assign, access, hexes))


def _weight(n: Column) -> Column:
    """n * log2(n) for a count in a window."""
    return F.element_at(F.array(*[F.lit(float(k * math.log2(k)) if k else 0.0) for k in range(WINDOW + 1)]), n + 1)


def _allowed(run: Column) -> Column:
    """array<struct<begin, end>> of the allow-list matches within a run."""
    at = F.concat(*[F.transform(_matches(run, a), lambda m: F.struct(m["begin"].alias("begin"), (m["begin"] + F.length(m["hit"])).alias("end"))) for a in _ALLOWED_WHOLE])
    return F.when(run.rlike("|".join(f"(?:{a})" for a in (*_ALLOWED_WHOLE[:2], r"(.)\1{7}"))), at).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))


def _hot(run: Column, alphabet: str, bits: float, allowed: Column | None = None) -> Column:
    """array<struct<begin, end>> within a run: windows whose entropy reaches bits and that no allowed place overlaps, joined where they meet.

    The run becomes codes once; STRETCH windows at a time are slid over, so the
    time follows the run's length, and spans that meet are joined at the end.
    """
    codes = F.slice(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c)), F.lit(1), F.length(run))
    allowed = F.array().cast("array<struct<begin:int,end:int>>") if allowed is None else allowed

    def whole(given: Column) -> Column:
        of = lambda k: F.struct((k * STRETCH).alias("at"), F.slice(given["codes"], k * STRETCH + 1, F.lit(STRETCH + WINDOW - 1)).alias("codes"), F.filter(given["allowed"], lambda a: (a["begin"] < (k + 1) * STRETCH + WINDOW) & (a["end"] > k * STRETCH)).alias("allowed"))
        last = F.floor(F.greatest(F.size(given["codes"]) - WINDOW, F.lit(0)) / STRETCH).cast("int")
        return F.flatten(F.transform(F.transform(F.sequence(F.lit(0), last), of), lambda stretch: _slid(stretch, alphabet, bits)))

    met = F.transform(F.array(F.struct(codes.alias("codes"), allowed.alias("allowed"))), whole)
    return F.element_at(F.transform(met, _joined), 1)


def _joined(spans: Column) -> Column:
    """Spans in order of both ends, those that meet as one."""
    first = F.filter(spans, lambda s, i: (i == 0) | (F.coalesce(F.get(spans, i - 1)["end"], F.lit(-1)) < s["begin"]))
    last = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.coalesce(F.get(spans, i + 1)["begin"], F.lit(-1)) > s["end"]))
    return F.zip_with(first, last, lambda x, y: F.struct(x["begin"].alias("begin"), y["end"].alias("end")))


def _slid(stretch: Column, alphabet: str, bits: float) -> Column:
    """The hot windows of one stretch (at, codes, allowed), joined where they meet."""
    spans = "array<struct<begin:int,end:int>>"
    state = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast(spans).alias("found"))
    at, codes, allowed = stretch["at"], stretch["codes"], stretch["allowed"]

    def step(s: Column, i: Column) -> Column:
        # a code of 0 stands for no character: nothing leaves until the window is full
        moved = F.array(F.struct(F.element_at(codes, i).alias("new"), F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0)).alias("old")))

        def slide(c: Column) -> Column:
            same = c["new"] == c["old"]
            gone, come = F.element_at(s["counts"], F.greatest(c["old"], F.lit(1))), F.element_at(s["counts"], c["new"])
            less = F.when(same | (c["old"] == 0), 0.0).otherwise(_weight(gone) - _weight(F.greatest(gone - 1, F.lit(0))))
            more = F.when(same, 0.0).otherwise(_weight(F.least(come + 1, F.lit(WINDOW))) - _weight(come))
            total = s["sum"] - less + more
            counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda n, k: n + (k + 1 == c["new"]).cast("int") - (k + 1 == c["old"]).cast("int")))
            begin, end = at + i - WINDOW, at + i
            hot = (i >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= bits) & ~F.exists(allowed, lambda a: (a["begin"] < end) & (a["end"] > begin))
            last = F.try_element_at(s["found"], F.lit(-1))
            joined = F.concat(F.slice(s["found"], 1, F.greatest(F.size(s["found"]) - 1, F.lit(0))), F.array(F.struct(last["begin"].alias("begin"), end.alias("end"))))
            found = F.when(~hot, s["found"]).when(F.coalesce(last["end"] >= begin, F.lit(False)), joined).otherwise(F.concat(s["found"], F.array(F.struct(begin.alias("begin"), end.alias("end")))))
            return F.struct(counts.alias("counts"), total.alias("sum"), found.cast(spans).alias("found"))

        return F.element_at(F.transform(moved, slide), 1)

    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), state, step, lambda s: s["found"])


def entropy_spans(text: Column) -> Column:
    """Spans of the entropy kinds."""
    return F.concat(*[_entropy(text, kind, *spec) for kind, spec in enumerate(CLASSES, start=3)])


def _entropy(text: Column, kind: int, name: str, alphabet: str, bits: float, needs: tuple[str, ...]) -> Column:
    pattern = "[" + alphabet.replace("-", r"\-") + "]{%d,}" % WINDOW

    def good(m: Column) -> Column:
        ok = F.lit(True)
        for n in needs:
            ok &= m["hit"].rlike(n)
        return ok

    def placed(m: Column) -> Column:
        # an array of one, so that the allowed places are found once a run
        found = F.flatten(F.transform(F.array(_allowed(m["hit"])), lambda a: _hot(m["hit"], alphabet, bits, a)))
        return F.transform(found, lambda s: F.struct((m["begin"] + s["begin"]).alias("begin"), F.lit(kind).alias("kind"), (m["begin"] + s["end"]).alias("end")))

    hot = F.transform(F.filter(_matches(text, pattern), good), placed)
    return F.when(text.rlike(pattern), F.flatten(hot).cast(_SPAN)).otherwise(_none())


def scan(docs: DataFrame) -> DataFrame:
    """docs with `base` and `spans`, arrays of struct<begin, kind (place in KINDS), end>."""
    found = docs.withColumn("base", base_spans(F.coalesce("text", F.lit("")))).withColumn("added", entropy_spans(F.coalesce("text", F.lit(""))))
    fresh = F.filter("added", lambda s: ~F.exists("base", lambda b: (b["begin"] <= s["begin"]) & (s["end"] <= b["end"])))
    return found.withColumn("spans", F.array_sort(F.concat("base", fresh))).drop("added")


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """What the contract asks of each document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return scan(docs.select("doc_id", "text")).select("doc_id", count(0), count(1), count(2), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", changed: str | None = None) -> DataFrame:
    """docs with every span (overlapping ones together) replaced by mark; other texts stay as they are.

    changed names a boolean column to add: whether the text had a span.
    """
    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text")))
    start = F.struct(F.lit(0).alias("done_to"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        more = F.concat(s["done"], F.array(F.substring("text", s["done_to"] + 1, x["begin"] - s["done_to"]), F.lit(mark)))
        return F.struct(F.greatest(s["done_to"], x["end"]).alias("done_to"), F.when(x["begin"] < s["done_to"], s["done"]).otherwise(more).alias("done"))

    clean = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["done"], ""), F.substring("text", s["done_to"] + 1, F.lit(1 << 30))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    out = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*out, *([(F.size("spans") > 0).alias(changed)] if changed else []))
