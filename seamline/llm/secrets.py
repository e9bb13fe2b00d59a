"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule has a regular expression, and a Boolean trigram query is derived from its syntax tree: an AND over sequences,
an OR over alternatives, and nothing where no trigram is mandatory. Texts and trigrams are lower-cased. Postings
(trigram, document) are built for the trigrams of all queries, are intersected for each rule, and only candidates are
verified with the rule's expression. A rule without mandatory trigrams scans every text.

Matches are leftmost and don't overlap within a kind; their places are code points, the end exclusive. They come
from split() and regexp_extract_all(), which cut a text at the same matches.

Defined results: a null text counts as empty and has no spans; very long texts are searched whole, in time in proportion to their length and matches; a repeated row, or a
repeated id, gets the spans of its own text; rows with a null id have no postings and are scanned with every rule, in
place; an empty table gives an empty result; other columns stay as they are, but a column of the result's name is
replaced (`found`, or the name that is given; masked() adds none).
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import whole


#: Alternatives of a Boolean query, strings of an expanded part, and members of an expanded character class, at most;
#: beyond them the derived query gets weaker, never wrong.
MOST_ALTERNATIVES, MOST_STRINGS, MOST_MEMBERS = 64, 64, 8
Query = frozenset[frozenset[str]]  # any of these sets in full
_ANYTHING: Query = frozenset([frozenset()])


def _least(query: set[frozenset[str]]) -> Query:
    """Without the sets that hold another one."""
    return frozenset(q for q in query if not any(other < q for other in query))


def _both(x: Query, y: Query) -> Query:
    joint = _least({p | q for p in x for q in y})
    return joint if len(joint) <= MOST_ALTERNATIVES else min(x, y, key=len)


def _holding(strings: set[str]) -> Query:
    """Texts that hold one of the strings."""
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _members(items: list) -> set[str] | None:
    """A character class's few members, lower-cased."""
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value))
        elif op is sre.RANGE and value[1] - value[0] < 2 * MOST_MEMBERS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    found = {c.lower() for c in found}
    return found if len(found) <= MOST_MEMBERS and all(c.isascii() for c in found) else None


def _derived(nodes: list) -> tuple[set[str] | None, Query]:
    """(all the lower-case strings that the nodes match, if these are few; what a match must hold)."""
    query, run, whole_run = _ANYTHING, {""}, True
    for op, value in nodes:
        exact, need = None, _ANYTHING
        if op is sre.LITERAL:
            exact = {chr(value).lower()} if value < 128 else None
        elif op is sre.IN:
            exact = _members(value)
        elif op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            exact = {""}
        elif op is sre.SUBPATTERN or op is sre.ATOMIC_GROUP:
            exact, need = _derived(value[-1] if op is sre.SUBPATTERN else value)
        elif op is sre.BRANCH:
            parts = [_derived(x) for x in value[1]]
            if all(x is not None for x, _ in parts):
                exact = set().union(*[x for x, _ in parts])
            need = _least(set().union(*[q for _, q in parts]))
            need = need if len(need) <= MOST_ALTERNATIVES else _ANYTHING
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            once, per = _derived(inner)
            if once is not None and high != sre.MAXREPEAT and (len(once) + 1) ** int(high) <= MOST_STRINGS:
                exact = {"".join(x) for k in range(low, int(high) + 1) for x in product(once, repeat=k)}
            need = per if low else _ANYTHING
        joint = None if exact is None else {x + y for x in run for y in exact}
        if joint is not None and len(joint) <= MOST_STRINGS:
            run = joint
        else:  # the run of exact strings ends here, and so may another begin
            whole_run = False
            query = _both(query, _holding(run))
            run = exact if exact is not None and len(exact) <= MOST_STRINGS else {""}
            query = _both(query, need)
    return (run if whole_run else None), _both(query, _holding(run))


@dataclass(frozen=True)
class Rule:
    """least: characters that the group must have."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    def trigrams(self) -> list[list[str]]:
        """The Boolean query, derived from the pattern: any of these lists in full. Empty: nothing is mandatory."""
        query = _derived(list(sre_parser.parse(self.pattern)))[1]
        return [] if frozenset() in query else sorted(sorted(q) for q in query)


# fixed values: the patterns of the three base kinds
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # [0-9a-f]+ of 24 or more: maximal runs are the same, and short runs, which would be dropped, are never listed
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Kinds beyond the base ones, of published token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
RULES = BASE + MORE


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


#: Entries of an array that one running aggregate adds up: what it copies stays small, so long arrays take linear time.
STRIDE = 256


def running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array of whole numbers (none below 0) op over the entries before it; 0 for the first.

    Strides are added up on their own, then their totals, and each stride is carried on.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def one(v: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(v, start, lambda s, x: F.struct(op(s["at"], value(x)).cast("long").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def joined(v: Column) -> Column:
        strides = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRIDE).cast("int")), lambda k: one(F.slice(v, k * STRIDE + 1, STRIDE), lambda x: x.cast("long")))
        return _let(strides, lambda parts: _let(one(parts, lambda p: p["at"])["out"], lambda bases: F.flatten(F.transform(parts, lambda p, k: F.transform(p["out"], lambda y: op(y, F.get(bases, k)))))))

    return _let(xs, lambda v: F.when(F.size(v) > 0, joined(v)).otherwise(F.array().cast("array<bigint>")))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (s, e) of the rule's matches, in order; matches whose group is too short take their place but are left out."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def placed(sizes: Column) -> Column:
        ends = running(F.transform(sizes, lambda x: x["g"] + x["m"]), _plus)
        spans = F.zip_with(sizes, ends, lambda x, at: F.struct((at + x["g"]).cast("long").alias("s"), (at + x["g"] + x["m"]).cast("long").alias("e"), (x["k"] >= rule.least).alias("ok")))
        return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    # the last gap has no match behind it
    sizes = F.transform(F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m"), kept.alias("k")), lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), F.length(x["k"]).alias("k")))
    return F.when(F.size(found) > 0, _let(sizes, placed)).otherwise(none)


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, doc_id): one row for each of the trigrams that a document's lower-cased text holds."""
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(whole(text)).alias("_t"))
    if not trigrams:
        return low.select("doc_id", F.lit("").alias("gram")).limit(0)
    held = F.filter(F.array(*[F.when(F.contains("_t", F.lit(g)), F.lit(g)) for g in trigrams]), lambda g: g.isNotNull())
    return low.select("doc_id", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): documents that meet the trigram query of a rule. The query table has a row for each trigram of a rule."""
    wanted = [(r.kind, k, g, len(grams)) for r in rules for k, grams in enumerate(r.trigrams()) for g in grams]
    spark = index.sparkSession
    queries = spark.createDataFrame(wanted, "kind string, alt int, gram string, need int")
    met = (
        index.distinct()
        .join(F.broadcast(queries), "gram")
        .groupBy("doc_id", "kind", "alt", "need")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = need")
    )
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("__seam_kinds"))


def _named(spans: Column, place: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(place).alias("place"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", into: str = "found") -> DataFrame:
    """docs with an array of (kind, place, s, e), ordered by start and then as the rules are listed."""
    indexed = tuple(r for r in rules if r.trigrams())
    grams = sorted({g for r in indexed for alt in r.trigrams() for g in alt})
    named, nameless = docs.filter(F.col(doc_id).isNotNull()), docs.filter(F.col(doc_id).isNull())
    hits = candidates(postings(named, grams, doc_id, text), indexed).withColumnRenamed("doc_id", "__seam_id")
    joined = named.join(hits, F.col(doc_id) == F.col("__seam_id"), "left").drop("__seam_id")
    joined = joined.unionByName(nameless.withColumn("__seam_kinds", F.array(*[F.lit(r.kind) for r in indexed]).cast("array<string>")))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    parts = []
    for k, rule in enumerate(rules):
        spans = spans_of(whole(text), rule)
        if rule in indexed:
            spans = F.when(F.array_contains("__seam_kinds", rule.kind), spans).otherwise(none)
        parts.append(_named(spans, k, rule.kind))
    return joined.withColumn(into, F.array_sort(reduce(lambda a, b: F.concat(a, b), parts))).drop("__seam_kinds")


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


#: Code points of a piece that a text is cut into before spans are looked up in it.
PIECE = 1024


def without_spans(text: Column, spans: Column, mask: str) -> Column:
    """text with its spans (s, e), in the order of their starts, replaced by the mask; those that overlap become one.

    The text is cut into pieces once, and every gap between spans is taken from the pieces that it lies in.
    """

    def taken(pieces: Column, s: Column, e: Column) -> Column:
        a, b = F.floor(s / PIECE).cast("int"), F.floor(F.greatest(e - 1, s) / PIECE).cast("int")
        cut = lambda k, low, n: F.substring(F.coalesce(F.get(pieces, k), F.lit("")), (low + 1).cast("int"), n.cast("int"))
        first = cut(a, s - a * PIECE, F.when(a == b, e - s).otherwise(F.lit(PIECE)))
        rest = F.concat(F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), cut(b, F.lit(0), e - b * PIECE))
        return F.concat(first, F.when(b > a, rest).otherwise(F.lit("")))

    def joined(pieces: Column) -> Column:
        reached = running(F.transform(spans, lambda x: x["e"]), F.greatest)  # the furthest end before each span
        gaps = F.filter(F.zip_with(spans, reached, lambda x, at: F.struct(at.alias("at"), x["s"].alias("s"))), lambda g: g["s"] >= g["at"])
        body = F.array_join(F.transform(gaps, lambda g: F.concat(taken(pieces, g["at"], g["s"]), F.lit(mask))), "")
        return _let(F.array_max(F.transform(spans, lambda x: x["e"])), lambda last: F.concat(body, taken(pieces, last, F.greatest(last, F.length(text).cast("long")))))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), joined)


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", mask: str = "<secret>") -> DataFrame:
    """docs with every span of a match replaced by the mask; overlapping spans become one."""
    found = find_secrets(docs, rules, doc_id, text, "__seam_found")
    return found.withColumn(text, F.when(F.size("__seam_found") > 0, without_spans(whole(text), F.col("__seam_found"), mask)).otherwise(F.col(text))).drop("__seam_found")
