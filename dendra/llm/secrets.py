"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong parts (``assign``, ``access``, ``hex``) are reported wherever they stand. Weak
candidates - login names, opaque tokens, endpoints - are reported only where
complementary parts co-occur: an interval join of the row's parts, each widened by
SCOPE code points, looks for a strong part of another role or for all three roles
(identifier, secret, endpoint) together.

Each kind is brought to positions by itself and only for texts that hold it: a match
starts where the gaps and matches before it end, and only lengths are kept of them. The
join looks forward at as many neighbours as can begin in a scope, and back at the last
two ends of every kind (spans of a kind don't overlap), however long a span may be; so
long texts stay near linear.

Defined cases: null and empty texts have no spans; repeated rows give repeated results;
null ids are kept; other columns are ignored. Offsets count code points, end exclusive.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import packed, unpacked

SCOPE = 300
BLOCK = 256
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
SPAN = "struct<start:bigint,kind:int,end:bigint>"


@dataclass(frozen=True)
class Part:
    name: str
    pattern: str
    role: int
    strong: bool
    shortest: int  # of the checked group, in code points
    group: int = 0  # whose length is checked
    extra: str = ""  # a pattern that the match must also hold
    hints: tuple[str, ...] = ()  # lower-case strings of which a text with a match has one


#: In the order in which spans with one start are listed.
PARTS = (
    Part("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", SECRET, True, 6, 2, hints=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Part("access", r"AKIA[A-Z0-9]{16,}", IDENTIFIER, True, 20, hints=("akia",)),
    Part("hex", r"[0-9a-f]{24,}", SECRET, True, 24),
    Part("login", r"""((?i:user_?name|user|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", IDENTIFIER, False, 3, 2, hints=("user", "login", "client", "account")),
    Part("opaque", r"[A-Za-z0-9+/_-]{20,}", SECRET, False, 20, extra=r"(?s)(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"),
    Part("endpoint", r"(?i:https?|ftp|ssh|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9.:@/_?=&%~+-]+", ENDPOINT, False, 10, hints=("://",)),
)
SHORTEST = min(p.shortest for p in PARTS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], see: Callable[[Column, Column], Column], kind: str) -> Column:
    """see(state, item) of every item, where step folds the items before it into the state; in blocks, so that no long array is copied for every item."""
    none = F.array().cast(f"array<{kind}>")

    def inside(state: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(state.alias("s"), none.alias("out")), lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(see(a["s"], x))).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    begin = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    whole = F.aggregate(blocks, begin, lambda a, b: let(inside(a["s"], b), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out"))))
    return F.when(F.size(items) > 0, F.flatten(whole["out"])).otherwise(none)


def positions(text: Column, matches: Column, k: int, p: Part) -> Column:
    """array<struct<start, kind, end>> of the part's matches."""
    length = lambda x: F.char_length(x).cast("bigint")

    def passes(match: Column) -> Column:
        value = F.regexp_extract(match, p.pattern, p.group) if p.group else match
        ok = F.char_length(value) >= p.shortest
        return ok & match.rlike(p.extra) if p.extra else ok

    items = F.zip_with(F.split(text, p.pattern, -1), matches, lambda g, m: F.struct(length(g).alias("gap"), length(m).alias("n"), passes(m).alias("keep")))
    items = F.filter(items, lambda x: x["n"].isNotNull())  # the last gap has no match after it
    begin, end = lambda at, x: at + x["gap"], lambda at, x: at + x["gap"] + x["n"]
    spans = let(items, lambda xs: scanned(xs, F.lit(0).cast("bigint"), end, lambda at, x: F.struct(begin(at, x).alias("start"), F.lit(k).alias("kind"), F.when(x["keep"], end(at, x)).alias("end")), SPAN))
    return F.when(F.exists(matches, passes), F.filter(spans, lambda s: s["end"].isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: tuple[Part, ...] = PARTS, scope: int = SCOPE, keep: list[str] | None = None) -> DataFrame:
    """(id, [kept columns], spans): array of (start, kind, end, name, linked), by start and kind; linked marks reported weak candidates."""
    keep = [id_col] if keep is None else keep
    t = F.col("__t")
    out = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    low = F.lower(t)
    found = []
    for k, p in enumerate(parts):
        matches = F.regexp_extract_all(t, F.lit(p.pattern), F.lit(0))
        if p.hints:
            matches = F.when(functools.reduce(operator.or_, [F.contains(F.col("__low"), F.lit(x)) for x in p.hints]), matches).otherwise(F.array().cast("array<string>"))
        found.append(let(matches, lambda m, k=k, p=p: positions(t, m, k, p)))
    out = out.withColumn("__low", low)
    out = out.select(*keep, F.array_sort(F.concat(*found)).alias("__p"))
    return out.select(*keep, _linked(F.col("__p"), parts, scope).alias("spans"))


def _linked(spans: Column, parts: tuple[Part, ...], scope: int) -> Column:
    """Strong spans, and the weak ones outside of them with complementary parts in their scope."""
    weak = [k for k, p in enumerate(parts) if not p.strong]
    is_weak = lambda s: s["kind"].isin(weak)
    never = F.lit(-(1 << 62))
    nothing = F.array(*[F.struct(never.alias("last"), never.alias("before")) for _ in parts])
    ends = "array<struct<last:bigint,before:bigint>>"
    # by span: of each kind the ends of the last two spans before it
    earlier = scanned(spans, nothing, lambda a, s: F.transform(a, lambda e, k: F.when(k == s["kind"], F.struct(s["end"].alias("last"), e["last"].alias("before"))).otherwise(e)), lambda a, s: a, ends)

    def chosen(x: Column, i: Column, past: Column) -> Column:
        reach = (F.lit(len(parts)) * (F.floor((x["end"] - x["start"] + scope) / SHORTEST) + 2)).cast("int")  # no more spans can begin up to the scope's end
        following = F.filter(F.slice(spans, i + 2, reach), lambda y: y["start"] < x["end"] + scope)
        inside = F.exists(following, lambda y: ~is_weak(y) & (y["start"] < x["end"]))
        kinds = F.transform(F.filter(following, lambda y: y["start"] >= x["end"]), lambda y: y["kind"])
        covered = F.lit(False)
        near = []
        for k, p in enumerate(parts):
            e = F.get(past, F.lit(k))
            if p.strong:
                covered = covered | (e["last"] > x["start"])
            # what overlaps a part doesn't support it
            last = F.when(e["last"] > x["start"], e["before"]).otherwise(e["last"])
            near.append((last > x["start"] - scope) | F.array_contains(kinds, k))

        def has(role: int, strong: bool) -> Column:
            out = F.lit(False)
            for k, p in enumerate(parts):
                if p.role == role and (p.strong or not strong):
                    out = out | near[k]
            return out

        supported = F.lit(False)
        for role in (IDENTIFIER, SECRET, ENDPOINT):
            others = [r for r in (IDENTIFIER, SECRET, ENDPOINT) if r != role]
            own = x["kind"].isin([k for k in weak if parts[k].role == role])
            supported = supported | (own & (has(others[0], True) | has(others[1], True) | (has(others[0], False) & has(others[1], False))))
        return ~(covered | inside) & supported

    names = F.array(*[F.lit(p.name) for p in parts])
    some = let(earlier, lambda e: F.filter(spans, lambda x, i: ~is_weak(x) | chosen(x, i, F.get(e, i))))
    # a weak part needs another part
    picked = F.when(F.exists(spans, is_weak) & (F.size(spans) > 1), some).otherwise(F.filter(spans, lambda x: ~is_weak(x)))
    return F.transform(picked, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(names, s["kind"]).alias("name"), is_weak(s).alias("linked")))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    found = scan(docs, id_col, text_col)
    base = F.filter("spans", lambda s: ~s["linked"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same columns, with every reported span of the text replaced by a mask; overlapping spans become one. Null texts stay null."""
    names = df.columns
    found = scan(packed(df, text_col), "row", keep=["text", "row"])
    t, at = F.col("text"), F.lit(0).cast("bigint")
    # what stands between the spans; null where a span begins inside another
    kept = scanned(F.col("spans"), at, lambda a, s: F.greatest(a, s["end"]), lambda a, s: F.when(s["start"] >= a, F.substring(t, (a + 1).cast("int"), (s["start"] - a).cast("int"))), "string")
    rest = F.substring(t, (F.array_max(F.transform("spans", lambda s: s["end"])) + 1).cast("int"), F.char_length(t))
    masked = F.array_join(F.concat(F.array_compact(kept), F.array(rest)), mask)
    text = F.when(F.size("spans") > 0, masked).otherwise(t)
    return found.select(text.alias("text"), "row").select(*unpacked(names, text_col))
