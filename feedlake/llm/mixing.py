"""Mixing sources by temperature, in DataFrame operations only.

Source weights are token shares to the power of an exponent between 0 (all alike) and
1 (as they are). The exponent is found by bisection: the greatest that reaches a
target entropy, or the least that keeps every source within a repetition limit. Each
source then gets its part of a token budget: whole passes over its documents, and a
last pass that follows a permutation of its blocks until the budget is spent.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.textrules import free_name
from feedlake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a block, on average.
BLOCK_DOCS = 64
SEED = "mix"
#: Each job of the bisection looks at all midpoints of so many of its steps.
LEVELS = 6
JOBS = 4
DIGITS = 6


@dataclass(frozen=True)
class Target:
    """``entropy``: share of the greatest possible entropy that the weights reach at
    least; ``repeats``: passes over one source, at most. The limit prevails."""

    entropy: float | None = None
    repeats: float | None = None


def _key(row_id: Column, text: Column) -> Column:
    """What names a unit within its source: the id, or without one the text."""
    return F.coalesce(row_id.cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))))


def units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, key, n_tokens): rows of one id and source are one unit and stay
    together; so are rows of a source that have no id and the same text. A null source
    counts as an empty name, a null text as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        _key(F.col(id_col), text).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n"),
    )
    return materialize(rows.groupBy("id", "source", "key").agg(F.sum("n").alias("n_tokens")), "units")


def exponent(sources: DataFrame, target: Target, scale: float = 1.0) -> float:
    """The exponent for ``sources`` (source, share); shares are above 0 and sum to 1.

    Entropy and repetition both fall as the exponent rises, so one bisection serves
    each. ``scale``: budget over tokens. Every job sums over the table for a fixed
    number of midpoints; nothing else comes to the driver. A target out of reach gives
    0 (entropy) or 1 (repeats).
    """

    def measured(points: list[float]) -> dict[float, tuple[float, float]]:
        a = F.col("a")
        part = F.pow("share", a)
        rows = sources.select("share", F.explode(F.array(*map(F.lit, points))).alias("a"))
        sums = rows.groupBy("a").agg(
            F.sum(part).alias("z"),
            F.sum(part * F.log("share")).alias("l"),
            F.max((a - 1) * F.log("share")).alias("m"),
        )
        entropy = F.log("z") - a * F.col("l") / F.col("z")
        return {r.a: (r.h, r.r) for r in sums.select("a", entropy.alias("h"), (F.exp("m") / F.col("z")).alias("r")).collect()}

    def bisect(high_enough: Callable[[float, float], bool]) -> float:
        """Upper end of the last interval of points where ``high_enough`` turns true."""
        low, high = 0.0, 1.0
        for _ in range(JOBS):
            step = (high - low) / (1 << LEVELS)
            found = measured([low + step * k for k in range(1, 1 << LEVELS)])
            for _ in range(LEVELS):
                middle = (low + high) / 2
                nearest = min(found, key=lambda x: abs(x - middle))
                if high_enough(*found[nearest]):
                    high = middle
                else:
                    low = middle
        return round(high, DIGITS)

    count = sources.count()
    chosen = 1.0
    if not count:
        return chosen
    if target.entropy is not None:
        wanted = target.entropy * math.log(count)
        # Below the point the entropy is at least the target.
        chosen = bisect(lambda h, r: h < wanted)
    if target.repeats is not None:
        least = bisect(lambda h, r: r * scale <= target.repeats)
        chosen = max(chosen, least) if target.entropy is not None else least
    return chosen


def _number(key: Column) -> Column:
    """A hash of a text key, as a number below 2^32."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(p.cast("string") for p in parts)).cast("binary"))


def plan(unit: DataFrame, target: Target, budget: int | None = None) -> DataFrame:
    """(source, n_tokens, n_units, weight, budget, passes, rest, n_blocks) per source.

    ``budget`` is in tokens; by default all that the corpus has. A source without a
    token has weight 0. Division of the budget is rounded to whole tokens.
    """
    sources = unit.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_units"))
    sources = materialize(sources, "sources")
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    share = F.col("n_tokens") / F.lit(float(max(total, 1)))
    shares = sources.where("n_tokens > 0").select("source", share.alias("share"))
    power = exponent(shares, target, budget / max(total, 1))
    raised = F.when(F.col("n_tokens") > 0, F.pow(share, F.lit(power))).otherwise(0.0)
    norm = sources.agg(F.sum(raised)).first()[0] or 1.0
    weight = (raised / F.lit(norm)).alias("weight")
    planned = sources.select("*", weight).withColumn("budget", F.round(F.col("weight") * budget).cast("long"))
    passes = F.when(F.col("n_tokens") > 0, F.expr("budget div n_tokens")).otherwise(0)
    return planned.withColumn("passes", passes).select(
        "*",
        (F.col("budget") - F.col("passes") * F.col("n_tokens")).alias("rest"),
        F.ceil(F.col("n_units") / BLOCK_DOCS).alias("n_blocks"),
    )


def _dealt(unit: DataFrame, target: Target, budget: int | None) -> DataFrame:
    """(id, source, key, n_tokens, pass, block, order_key) per unit and pass; see mix."""
    sources = materialize(plan(unit, target, budget), "plan")
    known = sources.select("source", "passes", "rest", "n_blocks")
    block = F.pmod(_number(F.col("key")), F.col("n_blocks"))
    rows = unit.join(known, "source").withColumn("block", block)
    rows = rows.select("id", "source", "key", "n_tokens", "passes", "rest", "block")

    last_pass = F.col("passes") + 1
    blocks = rows.groupBy("source", "block", "passes", "rest").agg(F.sum("n_tokens").alias("size"))
    blocks = blocks.withColumn("place", _order(last_pass, F.col("source"), F.col("block")))
    blocks = blocks.withColumn("part", F.substring("place", 1, 2))
    parts = blocks.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    through = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(through), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "part").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("size").over(inside), F.lit(0))
    starts = blocks.withColumn("earlier", earlier).join(parts, ["source", "part"]).select(
        "source", "block", (F.col("offset") + F.col("earlier")).alias("start")
    )
    own = _order(last_pass, F.col("key"))
    in_block = Window.partitionBy("source", "block").orderBy(own, "key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("start") + F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0))
    placed = rows.join(starts, ["source", "block"]).withColumn("ahead", ahead)
    # The unit that reaches the budget is the last: a source without a rest takes none.
    more = (F.col("ahead") < F.col("rest")).cast("long")
    taken = placed.select("id", "source", "key", "n_tokens", "block", (F.col("passes") + more).alias("times"))
    dealt = taken.where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return dealt.withColumn("order_key", _order(F.col("pass"), F.col("source"), F.col("block")))


def mix(
    docs: DataFrame,
    target: Target,
    budget: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, n_tokens, pass, block, order_key) per unit and pass.

    Sorting by order_key and id gives the permuted order: blocks of all sources mingle,
    a block's documents stay together. In a source's last pass, units are taken in this
    order until their tokens reach what is left of its budget: a source gets its budget,
    and over it less than the tokens of one unit, however long its texts are.

    The order of a source's blocks is worked out in two steps, by the first byte of
    their keys and then within it, so a source that holds much of the corpus is no
    single window. Ties of hashes go to the smaller key. An empty table gives an empty one.
    """
    dealt = _dealt(units(docs, id_col, text_col, source_col), target, budget)
    return dealt.select("id", "source", "n_tokens", "pass", "block", "order_key")


def mixed(docs: DataFrame, target: Target, budget: int | None = None) -> DataFrame:
    """The documents of the mixture: all columns of ``docs``, mix_pass and order_key (which
    replace columns of these names), a row per row of a unit and pass. Rows of one id and
    source stay together; see ``units`` for rows without an id, and for nulls."""
    own = [c for c in docs.columns if c.lower() not in ("mix_pass", "order_key")]
    key, source = (free_name(docs, c) for c in ("unit_key", "unit_source"))
    dealt = _dealt(units(docs, "doc_id", "text", "source"), target, budget).select(
        F.col("key").alias(key), F.col("source").alias(source), F.col("pass").alias("mix_pass"), "order_key"
    )
    rows = docs.select(
        *own,
        _key(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias(key),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias(source),
    )
    return rows.join(dealt, [key, source]).select(*own, "mix_pass", "order_key")
