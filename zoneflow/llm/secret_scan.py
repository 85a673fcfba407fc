"""Secret scan through a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean query over trigrams that any match must
contain. Postings (trigram, document) are built for the trigrams of those queries,
grouped by rule and document and intersected; what is left are candidates, on which
the regex itself runs. A rule whose regex demands no trigram scans all texts.

In the index a document is the md5 of its text, so copies are one entry.
"""

from __future__ import annotations

import functools
import itertools
import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.common import fresh, membership_bits, might_be_in, stored

MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` has ``least`` characters or more.

    ``pattern`` is read by Java and, for the trigrams, by Python: keep to what both
    share. ``any_case`` holds for ASCII letters.
    """

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0


# The base kinds and their patterns.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        any_case=True,
        group=2,
        least=6,
    ),
    # Runs as long as they must be: a shorter run never holds a longer match.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", any_case=True),
)
RULES = BASE_RULES + ADDED_RULES


# -- trigram queries, made on the driver from the patterns alone


@dataclass(frozen=True)
class _Part:
    """What is known of a sub-pattern: all strings it matches, if few, or the pieces
    it must begin and end with; and a query every match satisfies."""

    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: frozenset[frozenset[str]] | None  # disjunction of conjunctions; None: anything


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _simplify(query: Iterable[frozenset[str]]) -> frozenset[frozenset[str]] | None:
    terms = sorted(set(query), key=len)
    kept: list[frozenset[str]] = []
    for term in terms:
        if not any(k <= term for k in kept):
            kept.append(term)
    return None if not kept or not kept[0] else frozenset(kept)


def _and(a, b):
    if a is None or b is None:
        return b if a is None else a
    both = _simplify(x | y for x in a for y in b)
    return both if both is not None and len(both) <= MAX_STRINGS else min(a, b, key=len)


def _or(a, b):
    return None if a is None or b is None else _simplify(a | b)


def _strings_query(strings: frozenset[str]):
    """Any of these strings occurs; nothing is known if one has no trigram."""
    return _simplify(_trigrams(s) for s in strings)


_ANY = _Part(None, frozenset({""}), frozenset({""}), None)


def _exactly(strings: Iterable[str]) -> _Part:
    strings = frozenset(strings)
    if len(strings) > MAX_STRINGS:
        return _ANY
    return _Part(strings, strings, strings, _strings_query(strings))


def _short(strings: Iterable[str], tail: bool) -> frozenset[str]:
    """Strings cut to their last or first two characters."""
    return frozenset(s[-2:] if tail else s[:2] for s in strings)


def _concat(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MAX_STRINGS:
        return _exactly(x + y for x in a.exact for y in b.exact)
    # What spans the seam: an end of the left and a beginning of the right.
    left = a.exact if a.exact is not None else a.suffix
    right = b.exact if b.exact is not None else b.prefix
    seam = None
    if len(left) * len(right) <= MAX_STRINGS:
        seam = _strings_query(frozenset(x + y for x, y in itertools.product(left, right)))
    prefix, suffix = a.prefix, b.suffix
    if a.exact is not None:
        prefix = frozenset(x + y for x in a.exact for y in b.prefix)
    if b.exact is not None:
        suffix = frozenset(x + y for x in a.suffix for y in b.exact)
    wide = frozenset({""})
    return _Part(
        None,
        prefix if len(prefix) <= MAX_STRINGS else wide,
        suffix if len(suffix) <= MAX_STRINGS else wide,
        _and(_and(a.query, b.query), seam),
    )


def _either(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MAX_STRINGS:
        return _exactly(a.exact | b.exact)
    wide = frozenset({""})
    prefix, suffix = a.prefix | b.prefix, a.suffix | b.suffix
    return _Part(
        None,
        prefix if len(prefix) <= MAX_STRINGS else wide,
        suffix if len(suffix) <= MAX_STRINGS else wide,
        _or(a.query, b.query),
    )


def _class(items) -> _Part:
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < MAX_STRINGS:
            found.update(map(chr, range(arg[0], arg[1] + 1)))
        else:  # a negated or a named class
            return _ANY
        if len(found) > 16:
            return _ANY
    return _exactly(found)


def _part(tree) -> _Part:
    whole = _exactly([""])
    for op, arg in tree:
        if op is sre.LITERAL:
            part = _exactly([chr(arg)])
        elif op is sre.IN:
            part = _class(arg)
        elif op is sre.SUBPATTERN:
            part = _part(arg[-1])
        elif op is sre.BRANCH:
            part = functools.reduce(_either, map(_part, arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            part = _part(inner)
            if (least, most) == (0, 1):
                part = _either(part, _exactly([""]))
            elif least == 0:
                part = _ANY
            else:
                first = part
                for _ in range(min(least, 8) - 1):
                    part = _concat(part, first)
                if least != most or least > 8:
                    part = _concat(part, _ANY)
        elif op is sre.AT:
            continue
        else:
            part = _ANY
        whole = _concat(whole, part)
    return whole


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """Sets of lower-case trigrams, one of which every match holds in full.

    Texts are folded to lower case for the index, so the query is right for either
    case. None: the pattern demands no trigram and has to scan.
    """
    part = _part(sre_parser.parse(pattern))
    if part.query is None:
        return None
    return _simplify(frozenset(t.lower() for t in term) for term in part.query)


# -- the scan


def _regex(rule: Rule) -> str:
    return f"(?i){rule.pattern}" if rule.any_case else rule.pattern


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """A rule's matches. What lies between them is known too, and so where they are."""
    pattern = _regex(rule)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        matches.alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)).alias("g"),
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["m"])
        span = F.struct(
            start.alias("start"),
            F.lit(order).alias("order"),
            end.alias("end"),
            F.lit(rule.kind).alias("kind"),
        )
        enough = F.length(part["g"]) >= rule.least
        found = F.when(enough, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(parts, zero, step, lambda acc: acc["found"])


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """``key`` (md5 of a text) and ``rules`` (numbers of those it may match).

    Built from postings: one row per trigram and distinct text that holds it.
    """
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    terms = [(n, k, t) for n, q in queries.items() for k, term in enumerate(sorted(map(sorted, q))) for t in term]
    wanted = sorted({t for _, _, t in terms})
    need: dict[tuple[int, int], int] = {}
    of: dict[str, list[tuple[int, int]]] = {t: [] for t in wanted}
    for n, k, t in terms:
        need[n, k] = need.get((n, k), 0) + 1
        of[t].append((n, k))
    folded, text = fresh("folded"), _text(text_col)
    hits = F.array_compact(
        F.array(*[F.when(F.contains(F.col(folded), F.lit(t)), F.lit(t)) for t in wanted])
    )
    # Copies are one entry: they are made one before anything else is done with them.
    postings = (
        docs.select(_key(text).alias("key"), F.lower(text).alias(folded))
        .select("key", hits.alias("hits"))
        .where(F.size("hits") > 0)
        .select("key", F.explode("hits").alias("trigram"))
        .distinct()
    )
    lists = {t: F.array(*[F.lit(f"{n}.{k}") for n, k in of[t]]) for t in wanted}
    queried = F.create_map(*itertools.chain.from_iterable((F.lit(t), a) for t, a in lists.items()))
    enough = F.create_map(
        *itertools.chain.from_iterable((F.lit(f"{n}.{k}"), F.lit(c)) for (n, k), c in need.items())
    )
    return (
        postings.select("key", F.explode(queried[F.col("trigram")]).alias("term"))
        .groupBy("key", "term")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= enough[F.col("term")])
        .groupBy("key")
        .agg(F.collect_set(F.split_part("term", F.lit("."), F.lit(1)).cast("int")).alias("rules"))
    )


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> DataFrame:
    """Add ``spans``: start, end (code points, exclusive), kind; by start, then rule.

    Rows, repeated ones too, are kept as they are. A NULL or empty text has no spans.
    A column named ``spans`` is replaced. An empty table gives an empty result.
    """
    key, text = fresh("key"), _text(text_col)
    indexed = [n for n, r in enumerate(rules) if trigram_query(r.pattern) is not None]
    scanned = [n for n in range(len(rules)) if n not in indexed]
    none = F.array().cast(SPANS)
    with_spans = docs.withColumn(key, _key(text)).withColumn(
        "spans",
        F.concat(
            none,
            *[
                F.when(text.rlike(_regex(rules[n])), _spans(text, rules[n], n)).otherwise(none)
                for n in scanned
            ],
        ),
    )
    if indexed:
        possible = stored(candidates(docs, rules, text_col), "candidates")
        texts = might_be_in(
            docs.select(_key(text).alias("key"), text.alias("text")), "key", membership_bits(possible, "key")
        )
        # Copies become one before the shuffle, so a text that very many rows have is sent
        # once by each task and verified once.
        once = texts.groupBy("key").agg(F.first("text").alias("text"))
        verified = once.join(possible, "key").select(
            F.col("key").alias(key),
            F.concat(
                *[
                    F.when(F.array_contains("rules", n), _spans(F.col("text"), rules[n], n)).otherwise(none)
                    for n in indexed
                ]
            ).alias("_more"),
        )
        with_spans = with_spans.join(verified, key, "left").withColumn(
            "spans", F.concat("spans", F.coalesce("_more", none))
        )
    order = F.transform(
        F.array_sort("spans"),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"]
    return with_spans.select(*kept, order.alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Put ``[kind]`` in the place of each span; of overlapping ones the first names it."""
    text, spans = F.col(f"`{text_col}`"), F.col(f"`{spans_col}`")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        apart = span["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        out = F.when(apart, F.concat(acc["out"], gap, F.lit("["), span["kind"], F.lit("]")))
        return F.struct(
            F.greatest(acc["at"], span["end"]).alias("at"), out.otherwise(acc["out"]).alias("out")
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    cleaned = F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, finish)).otherwise(text)
    return docs.withColumn(text_col, cleaned)


def _both_cases(pattern: str) -> str:
    """Each ASCII letter in either case; classes name both themselves, as escapes stay."""
    return re.sub(
        r"(\\x[0-9a-fA-F]{2}|\\.|\[[^\]]*\])|([A-Za-z])",
        lambda m: m[1] or f"[{m[2].lower()}{m[2].upper()}]",
        pattern,
    )


def _rule_sql(rule: Rule, order: int) -> str:
    # No (?i): it would take the Kelvin sign for a k and the long s for an s.
    pattern = (_both_cases(rule.pattern) if rule.any_case else rule.pattern).replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, a, a + length(m[i]) AS b, g[i] AS g
  FROM (SELECT *, coalesce(list_sum([length(x) FOR x IN gap[1:i]]), 0)
                + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS a
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m,
              regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
              string_split_regex(t, '{pattern}') AS gap
            FROM docs)))
  WHERE length(g[i]) >= {rule.least}"""


def _list_sql(where: str = "TRUE") -> str:
    return f"""coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o)
    FILTER (WHERE kind IS NOT NULL AND {where}), '')"""


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_rule_sql(rule, n) for n, rule in enumerate(RULES))})
SELECT docs.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
  count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256({_list_sql("kind IN ('assign', 'access', 'hex')")}) AS base_sha256, {_list_sql()} AS spans
FROM docs LEFT JOIN spans ON docs.doc_id = spans.doc_id GROUP BY docs.doc_id
"""
