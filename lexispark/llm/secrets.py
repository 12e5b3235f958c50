"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned, while the plan is built, into a Boolean query over
trigrams that every match must contain. The index is inverted: for each trigram that some rule
asks for, lists of the documents that have it, cut by a hash of the document into blocks. A
rule's candidates come from intersections and unions of its trigrams' lists; texts are verified
with the expression itself where the candidates' bitmap has their bit, so that no text is
shuffled. Rules without mandatory trigrams, such as runs of a character class, scan every text.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import BITMAP, stored

#: Sets of possible strings above this size are taken as unknown.
MOST_STRINGS = 64
#: Blocks of documents: each has its own list for a trigram, so that no list holds a corpus.
BLOCKS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, a group whose length counts (0: the match), a least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What the scan finds besides: key blocks, bearer tokens of public services, credentials in addresses.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[a-z]+://[^\x09-\x0D\x20/:@]+:[^\x09-\x0D\x20/:@]+@"),
)

# A query is True (any text), a trigram, or ("and" | "or", queries).


def _both(*queries):
    parts = sorted({q for q in queries if q is not True}, key=repr)
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(*queries):
    if not queries or True in queries:
        return True
    parts = sorted(set(queries), key=repr)
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _needs(strings: frozenset[str]):
    """That one of the strings occurs; shorter ones than a trigram say nothing."""
    return _either(*(_both(*(s[i : i + 3] for i in range(len(s) - 2))) if len(s) >= 3 else True for s in strings))


def _strings(op, arg) -> frozenset[str] | None:
    """All strings that a character node matches, lower-cased, or None for too many."""
    if op is rc.LITERAL:
        return frozenset({chr(arg).lower()})
    if op is rc.IN and arg[0][0] is not rc.NEGATE:
        found: set[str] = set()
        for kind, what in arg:
            if kind is rc.LITERAL:
                found.add(chr(what).lower())
            elif kind is rc.RANGE and what[1] - what[0] < MOST_STRINGS:
                found.update(chr(c).lower() for c in range(what[0], what[1] + 1))
            else:
                return None
        return frozenset(found) if len(found) <= 6 else None
    return None


def _analyse(nodes) -> tuple[frozenset[str] | None, object]:
    """(all strings that the sequence can match, or None; the query that a match implies)."""
    known: frozenset[str] = frozenset({""})
    whole, query = True, True
    for op, arg in nodes:
        own, implied = None, True
        if op is rc.AT:
            continue
        if op in (rc.LITERAL, rc.IN):
            own = _strings(op, arg)
        elif op is rc.SUBPATTERN:
            own, implied = _analyse(arg[3])
        elif op is rc.BRANCH:
            parts = [_analyse(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                own = frozenset(itertools.chain.from_iterable(s for s, _ in parts))
            else:
                implied = _either(*(_both(q, True if s is None else _needs(s)) for s, q in parts))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = arg
            strings, q = _analyse(inner)
            if strings is not None and high == 1:
                own = strings | ({""} if low == 0 else set())
            elif strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
                own = frozenset("".join(x) for x in itertools.product(strings, repeat=low))
            elif low:
                implied = _both(q, True if strings is None else _needs(strings))
        query = _both(query, implied)
        if own is not None and len(known) * len(own) <= MOST_STRINGS:
            known = frozenset(a + b for a in known for b in own)
        else:  # what was known ends here; a new run of known strings begins
            query = _both(query, _needs(known))
            whole, known = False, frozenset({""}) if own is None else own
    if whole:
        return known, query
    return None, _both(query, _needs(known))


def trigram_query(pattern: str):
    """The Boolean trigram query of an expression: True if no trigram is mandatory."""
    strings, query = _analyse(rp.parse(pattern))
    return _both(query, True if strings is None else _needs(strings))


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def index(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The inverted index (block, trigram, docs): in each block of documents, those that have a wanted trigram.

    A document is named by a 64-bit hash of its id; rows that share one, null ids too, are one
    document here, which can only make more candidates. Whole texts are lower-cased once and
    searched for each trigram in compiled code.
    """
    wanted = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    low = docs.where("text is not null").select(F.xxhash64("doc_id").alias("doc"), F.lower("text").alias("low"))
    words = []
    for w in range(0, len(wanted), 60):  # a bit for each trigram, 60 to a number
        bits = F.lit(0).cast("long")
        for k, g in enumerate(wanted[w : w + 60]):
            bits = bits.bitwiseOR(F.when(F.contains("low", F.lit(g)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(bits.alias(f"m{w // 60}"))
    seen = low.select("doc", *words)
    has = [F.when(F.col(f"m{k // 60}").bitwiseAND(F.lit(1 << (k % 60)).cast("long")) != 0, F.lit(g)) for k, g in enumerate(wanted)]
    postings = seen.select("doc", F.explode(F.array_compact(F.array(*has))).alias("trigram"))
    block = F.pmod(F.col("doc"), F.lit(BLOCKS)).cast("int").alias("block")
    return postings.groupBy(block, "trigram").agg(F.collect_set("doc").alias("docs"))


def candidates(lists: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc, rule): the documents of each rule (by its number), from intersections and unions of its lists."""
    every = lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))

    def docs_of(q) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.try_element_at("lists", F.lit(q)), F.array().cast("array<long>"))
        parts = [docs_of(x) for x in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = F.array_intersect(out, p) if q[0] == "and" else F.array_union(out, p)
        return out

    def hit(rule: int):
        return lambda d: F.struct(d.alias("doc"), F.lit(rule).alias("rule"))

    found = [F.transform(docs_of(q), hit(i)) for i, q in enumerate(trigram_query(r.pattern) for r in rules) if q is not True]
    return every.select(F.inline(F.flatten(F.array(*found)))) if found else every.select(F.lit(0).cast("long").alias("doc"), F.lit(0).alias("rule")).where("false")


def _bitmaps(hits: DataFrame, rules: int) -> DataFrame:
    """(word, bits of each rule): BITMAP bits a rule in BITMAP / 64 rows at most, whatever the corpus."""
    place = F.pmod(F.xxhash64("doc"), F.lit(BITMAP))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    of = [F.coalesce(F.bit_or(F.when(F.col("rule") == i, bit)), F.lit(0).cast("long")).alias(f"bits{i}") for i in range(rules)]
    return hits.groupBy(F.shiftright(place, 6).alias("word")).agg(*of)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans, leftmost and non-overlapping, that are long enough: (start, order, kind, end) in code points.

    The text between matches and the matches themselves come from two passes of the same
    expression; running lengths of both give the places.
    """
    rx = F.lit(rule.pattern)
    found = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, rx, F.lit(0)).alias("all"), F.regexp_extract_all(text, rx, F.lit(rule.group)).alias("part"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>").alias("out"))

    def step(x: Column):
        def one(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.length(F.get(x["gaps"], k))
            end = start + F.length(F.get(x["all"], k))
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
            keep = F.length(F.get(x["part"], k)) >= rule.least
            return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return one

    # The struct is bound once by a one-element transform, so the expression runs once for each part.
    return F.flatten(
        F.transform(
            F.array(found),
            lambda x: F.aggregate(F.when(F.size(x["all"]) > 0, F.sequence(F.lit(0), F.size(x["all"]) - 1)).otherwise(F.array().cast("array<int>")), empty, step(x))["out"],
        )
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, found) of every row of `docs`: found is all spans of all rules by start, then rule.

    Null and empty texts have none. Repeated ids are verified row by row: an id is a candidate
    if any of its rows is. Rows without an id are found like others. Columns besides doc_id and
    text play no part; an empty table gives no rows. The broadcast bitmaps have a fixed size;
    when candidates fill them, more texts are verified, never fewer.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    docs = docs.select("doc_id", "text")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    indexed = tuple(r for r, q in zip(rules, queries, strict=True) if q is not True)
    text = F.coalesce("text", F.lit(""))
    hits = stored(candidates(stored(index(docs, indexed), "trigram-lists"), indexed), "secret-candidates") if indexed else None
    place = F.pmod(F.xxhash64(F.xxhash64("doc_id")), F.lit(BITMAP))
    if hits is not None:
        docs = docs.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(_bitmaps(hits, len(indexed))), "word", "left")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    parts = []
    for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        asked = F.rlike(text, F.lit(rule.pattern)) if query is True else F.col(f"bits{indexed.index(rule)}").bitwiseAND(bit) != 0
        parts.append(F.when(asked, rule_spans(text, rule, order)).otherwise(none))
    return docs.select("doc_id", F.sort_array(F.flatten(F.array(*parts))).alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the base spans' SHA-256 and all spans as text."""
    base = F.filter("found", lambda s: s["order"] < len(BASE_RULES))
    counts = [F.size(F.filter("found", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL for `digest(scan(documents))`: the same rules over every whole text, no index."""
    parts = []
    for order, r in enumerate(BASE_RULES + MORE_RULES):
        rx = r.pattern.replace("'", "''")
        parts.append(
            f"""select row_id, {order} as ord, '{r.kind}' as kind, m.start as start, m.start + length(m.whole) as stop from (
              select row_id, unnest(list_transform(range(1, len(hits) + 1), lambda k: {{'whole': hits[k], 'part': part[k],
                'start': list_sum(list_transform(gaps[:k], lambda g: length(g)))::bigint + coalesce(list_sum(list_transform(hits[:k-1], lambda h: length(h))), 0)::bigint}})) as m
              from (select row_id, regexp_extract_all(text, '{rx}', 0) as hits, regexp_extract_all(text, '{rx}', {r.group}) as part, regexp_split_to_array(text, '{rx}') as gaps from d
                    where regexp_matches(text, '{rx}'))) where length(m.part) >= {r.least}"""
        )
    spans = "\nunion all\n".join(parts)
    return f"""
with d as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
s as ({spans}),
a as (select row_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
      count(*) filter (where kind = 'hex') as n_hex,
      coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (where ord < {len(BASE_RULES)}), '') as base,
      string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans
      from s group by row_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (row_id)"""
