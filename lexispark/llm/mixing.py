"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells (source, language, topic) with their tokens. Raking scales the
cells' token weights to one margin's targets after another, round by round, until all margins
hold. A cell's rate, its raked over its natural weight, gives its documents' probability to
stay; where a rate asks for more than all, the documents stay with a weight above 1, so that
expected weights meet the targets exactly. Only the cell table takes part in the rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import cut, fresh, packed, unit_hash, unpacked

DIMENSIONS = ("source", "lang", "topic")
#: Cells up to which the rounds run in one partition and rates are broadcast; more are dealt out.
FEW_CELLS = 200_000
#: Rounds between two looks at the margins, how far a margin may be off as a share of all, and the most rounds.
ROUNDS, TOLERANCE, MOST_ROUNDS = 10, 1e-6, 60
_TOKEN = r"[^\x20\x09\x0A\x0C\x0D]+"

@dataclass(frozen=True)
class Topic:
    """A topic by what a lower-cased text contains (any of), or by its length in characters."""

    name: str
    words: tuple[str, ...] = ()
    least: int = 0
    below: int = 2_000_000_000

    def column(self, low: Column) -> Column:
        n = F.length(low)
        out = (n >= self.least) & (n < self.below)
        return out & reduce(or_, (F.contains(low, F.lit(w)) for w in self.words)) if self.words else out

    def sql(self, low: str) -> str:
        out = f"length({low}) >= {self.least} and length({low}) < {self.below}"
        return f"{out} and ({' or '.join(f"contains({low}, '{w}')" for w in self.words)})" if self.words else out


#: The first that holds is the topic; without any it is `general`.
TOPICS = (
    Topic("legal", ("licens", "copyright")),
    Topic("contact", ("@", "http")),
    Topic("credentials", ("password", "token", "akia")),
    Topic("lists", (" | ",)),
    Topic("brief", below=400),
    Topic("essay", least=6000),
)


@dataclass(frozen=True)
class Targets:
    """Token shares to reach. A dimension has named shares, or its natural ones to a power.

    Values without a named share keep their natural share; the named ones part the rest.
    """

    powers: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "topic": 0.75})
    named: dict[str, dict[str, float]] = field(default_factory=lambda: {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}})


def topic_of(text: Column) -> Column:
    """The topic of a text; null is empty. The text is lower-cased once, inside a one-element array."""

    def first(low: Column) -> Column:
        out = F.lit("general")
        for topic in reversed(TOPICS):
            out = F.when(topic.column(low), F.lit(topic.name)).otherwise(out)
        return out

    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), first), 1)


def celled(docs: DataFrame) -> DataFrame:
    """`docs` with its cell (cell_source, cell_lang, cell_topic); null source and language count as ''."""
    return docs.withColumns(
        {
            "cell_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "cell_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "cell_topic": topic_of(F.col("text")),
        }
    )


def token_count(text: Column) -> Column:
    """Words parted by white space; one at least, so that no document is weightless."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)), F.lit(1)).cast("long")


def _target(cells: DataFrame, dim: str, targets: Targets) -> DataFrame:
    """(cell_<dim>, t): the share of each value of a dimension that the corpus has."""
    key = f"cell_{dim}"
    natural = cells.groupBy(key).agg(F.sum("tokens").cast("double").alias("n"))
    whole = natural.agg(F.sum("n").alias("all_n"))
    natural = natural.crossJoin(whole).select(key, (F.col("n") / F.col("all_n")).alias("s"))  # one row on the right
    named = targets.named.get(dim, {})
    raw = F.pow("s", F.lit(float(targets.powers.get(dim, 1.0))))
    if named:
        raw = F.lit(None).cast("double")
        for value, share in sorted(named.items()):
            raw = F.when(F.col(key) == value, F.lit(float(share))).otherwise(raw)
    natural = natural.withColumn("raw", raw)
    sums = natural.agg(F.sum("raw").alias("raw_all"), F.coalesce(F.sum(F.when(F.col("raw").isNull(), F.col("s"))), F.lit(0.0)).alias("rest"))
    share = F.when(F.col("raw").isNull(), F.col("s")).otherwise(F.col("raw") / F.col("raw_all") * (F.lit(1.0) - F.col("rest")))
    return natural.crossJoin(sums).select(key, share.alias("t"))


def rake(docs: DataFrame, targets: Targets = Targets(), rounds: int = ROUNDS) -> DataFrame:
    """(cell_source, cell_lang, cell_topic, tokens, w): natural tokens and raked share of every cell.

    After each `rounds` rounds the margins are looked at; the fit ends when none is further off
    than TOLERANCE. Targets that no weights meet, as cells are missing, end it after MOST_ROUNDS:
    then the last margin raked holds and the others are as near as rounds brought them.
    """
    keys = [f"cell_{d}" for d in DIMENSIONS]
    cells = cut(celled(docs).select(*keys, token_count(F.col("text")).alias("tokens")).groupBy(*keys).agg(F.sum("tokens").alias("tokens")))
    wide = cells
    for dim in DIMENSIONS:
        wide = wide.join(_target(cells, dim, targets).withColumnRenamed("t", f"t_{dim}"), f"cell_{dim}")
    now = cut(wide.withColumn("w", F.col("tokens").cast("double")))
    scaled = _scaled_here if cells.count() <= FEW_CELLS else _scaled_apart
    for _ in range(0, MOST_ROUNDS, rounds):
        now = scaled(now, rounds)
        if margin_gap(now) <= TOLERANCE:
            break
    return now.select(*keys, "tokens", "w")


def margin_gap(now: DataFrame) -> float:
    """How far the margin that is furthest off is from its target, as a share of all weight; 0 for no cells."""
    whole = now.agg(F.sum("w").alias("all_w"))  # one row
    gap = [now.groupBy(f"cell_{d}").agg(F.sum("w").alias("w"), F.first(f"t_{d}").alias("t")).select("w", "t") for d in DIMENSIONS]
    every = reduce(DataFrame.unionByName, gap).crossJoin(whole)
    return every.agg(F.max(F.abs(F.col("w") / F.col("all_w") - F.col("t"))).alias("gap")).first().gap or 0.0


def _scaled_here(now: DataFrame, rounds: int) -> DataFrame:
    """All rounds in one partition: windows over it need no shuffle."""
    now = now.coalesce(1)
    for _ in range(rounds):
        for dim in DIMENSIONS:
            whole = F.sum("w").over(Window.partitionBy(f"cell_{dim}"))
            now = now.withColumn("w", F.col("w") * F.col(f"t_{dim}") / whole)
    return cut(now)


def _scaled_apart(now: DataFrame, rounds: int) -> DataFrame:
    """The same for very many cells: sums are shuffled, so that no task holds all cells of a language."""
    for _ in range(rounds):
        for dim in DIMENSIONS:
            sums = now.groupBy(f"cell_{dim}").agg(F.sum("w").alias("sum_w"))
            now = now.join(sums, f"cell_{dim}").withColumn("w", F.col("w") * F.col(f"t_{dim}") / F.col("sum_w")).drop("sum_w")
        now = cut(now)
    return now


def rates(cells: DataFrame, keep: float) -> DataFrame:
    """(cell keys, rate): expected weight of each token of a cell, `keep` on average."""
    whole = cells.agg(F.sum("tokens").cast("double").alias("all_tokens"), F.sum("w").alias("all_w"))
    rate = F.lit(float(keep)) * (F.col("w") / F.col("all_w")) / (F.col("tokens") / F.col("all_tokens"))
    return cells.crossJoin(whole).select(*(f"cell_{d}" for d in DIMENSIONS), rate.alias("rate"))


def mix(docs: DataFrame, targets: Targets = Targets(), keep: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """`docs` with its cell, p, weight and kept (boolean) for every row.

    p is the least of 1 and the cell's rate, weight the rate where that is above 1, and a row
    is kept if a hash of its id (of its text for want of an id) falls below p; rows of equal ids
    fare alike. An empty table gives no rows. Other columns stay, but for those of the new names.
    """
    return _mixed(docs, rake(docs, targets, rounds), keep)


def _mixed(docs: DataFrame, cells: DataFrame, keep: float) -> DataFrame:
    """`mix` by raked cells."""
    found = cut(rates(cells, keep))
    if found.count() <= FEW_CELLS:  # a checked size: texts need no shuffle, and a hot cell no task of its own
        found = F.broadcast(found)
    draw = unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    name = fresh(docs, "rate")
    rate = F.col(name)
    joined = celled(docs).join(found.withColumnRenamed("rate", name), [f"cell_{d}" for d in DIMENSIONS])
    return joined.withColumns({"p": F.least(F.lit(1.0), rate), "weight": F.greatest(F.lit(1.0), rate), "kept": draw < rate}).drop(name)


def sample(docs: DataFrame, targets: Targets = Targets(), keep: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """The rows of `docs` that `mix` keeps, with the columns of `docs`.

    A sample has no weights, so no cell's rate may ask for more than all its rows: `keep` is
    lowered until the largest rate is 1, and the expected tokens meet the targets.
    """
    used = ("doc_id", "text", "source", "lang")
    docs_, columns = packed(docs, *used), docs.columns
    cells = cut(rake(docs_, targets, rounds))
    most = rates(cells, 1.0).agg(F.max("rate")).first()[0]
    mixed = _mixed(docs_, cells, min(keep, 1.0 / most) if most else keep).where("kept")
    return mixed.select(*unpacked(columns, **{c: F.col(c) for c in used}))


def oracle(targets: Targets = Targets(), keep: float = 0.5, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the rows of the query: the same rounds, one common table each."""
    topics = " ".join(f"when {t.sql('low')} then '{t.name}'" for t in TOPICS)
    out = [
        f"""d as (select doc_id, text, coalesce(source, '') as source, coalesce(lang, '') as lang, case {topics} else 'general' end as topic,
  greatest(coalesce(len(regexp_extract_all(text, '{_TOKEN}')), 0), 1)::bigint as n_tokens from (select *, lower(coalesce(text, '')) as low from documents))""",
        "c as materialized (select source, lang, topic, sum(n_tokens)::bigint as tokens from d group by all)",
    ]
    for dim in DIMENSIONS:
        named = targets.named.get(dim, {})
        raw = f"pow(s, {float(targets.powers.get(dim, 1.0))}::double)"
        if named:
            raw = "case " + " ".join(f"when {dim} = '{v}' then {float(x)}::double" for v, x in sorted(named.items())) + " else null end"
        out.append(f"n_{dim} as (select {dim}, s, {raw} as raw from (select {dim}, sum(tokens)::double / (select sum(tokens) from c)::double as s from c group by {dim}))")
        out.append(
            f"t_{dim} as materialized (select {dim}, case when raw is null then s else raw / (select sum(raw) from n_{dim}) * (1.0::double - (select coalesce(sum(s) filter (where raw is null), 0::double) from n_{dim})) end as t from n_{dim})"
        )
    out.append("w0 as materialized (select source, lang, topic, tokens, tokens::double as w from c)")
    k = 0
    for _ in range(rounds):
        for dim in DIMENSIONS:
            k += 1
            out.append(f"w{k} as materialized (select source, lang, topic, tokens, w * t / sum(w) over (partition by {dim}) as w from w{k - 1} join t_{dim} using ({dim}))")
    out.append(f"r as (select source, lang, topic, {float(keep)}::double * (w / (select sum(w) from w{k})) / (tokens / (select sum(tokens) from w{k})::double) as rate from w{k})")
    return (
        "with "
        + ",\n".join(out)
        + """
select doc_id, source, lang, topic, n_tokens, round(least(1.0::double, rate), 6) as p, round(greatest(1.0::double, rate), 6) as weight,
  ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 13))::bigint::double / 4503599627370496.0::double < rate as kept
from d join r using (source, lang, topic)"""
    )
