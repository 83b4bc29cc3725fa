"""Sources mixed to target shares of all tokens, small sources repeated up to a cap.

Each source's texts are strung together in an order given by hash and cut into blocks of a fixed number of tokens. Output
shards draw how many blocks they take of each source (multinomial counts, conditioned on the sources' totals); each drawn slot
is mapped through its source's pseudorandom permutation of block numbers, a fresh one for every pass, and joined with the
blocks by number. No block is drawn more often than the source may be repeated, hence no text either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.session import cut

#: Rounds of the swap-or-not permutation.
ROUNDS = 24


@dataclass(frozen=True)
class SourcePlan:
    """One target source: blocks it has, blocks it gives, and the target."""

    source: str
    target_share: float
    max_repeats: int
    tokens: int
    blocks: int
    drawn: int


def proper_source(source: Column) -> Column:
    """The proper spelling of a source: lower case, trimmed, runs of spaces and hyphens as one underscore."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"\s+", " "))), r"[\s-]+", "_")


def string_together(items: DataFrame, chain_tokens: int) -> DataFrame:
    """items (source, item_id, n_tokens > 0) with chain and the place (chain_start) of their first token in it.

    A source is strung on chains of about chain_tokens (at most 65,536 chains, then longer ones), chosen by hash, so the
    running sum never sees more than one chain.
    """
    totals = items.groupBy("source").agg(F.sum("n_tokens").alias("_all"))
    chains = F.least(F.lit(65_536), F.greatest(F.lit(1), F.floor(F.col("_all") / chain_tokens))).cast("int")
    on = items.join(F.broadcast(totals), "source").select("source", "item_id", "n_tokens", F.pmod(F.xxhash64("item_id", F.lit(1)), chains).cast("int").alias("chain"))
    w = Window.partitionBy("source", "chain").orderBy(F.xxhash64("item_id", F.lit(2)), "item_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return on.withColumn("chain_start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).cast("long"))


def block_spans(strung: DataFrame, block_tokens: int) -> DataFrame:
    """The parts of items in each block: source, chain, chain_block, item_id, token_start, n_tokens."""
    first = F.floor(F.col("chain_start") / block_tokens)
    last = F.floor((F.col("chain_start") + F.col("n_tokens") - 1) / block_tokens)
    opened = strung.select("*", F.explode(F.sequence(first, last)).alias("chain_block"))
    begin = F.greatest(F.col("chain_start"), F.col("chain_block") * block_tokens)
    end = F.least(F.col("chain_start") + F.col("n_tokens"), (F.col("chain_block") + 1) * block_tokens)
    return opened.select("source", "chain", "chain_block", "item_id", (begin - F.col("chain_start")).alias("token_start"), (end - begin).cast("int").alias("n_tokens"))


def permuted(place: Column, size: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0..size-1 at place: swap-or-not rounds keyed by the salt, inside one expression."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *salt), size) - x, size)
        return F.when(F.xxhash64(F.greatest(x, other), r, *salt).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place, swap)


def draw_counts(drawn: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source per shard: multinomial given that the totals are exactly those drawn (one row per shard)."""
    rng = np.random.default_rng(seed)
    left = np.asarray(drawn, np.int64)
    out = np.zeros((shards, len(left)), np.int64)
    for s in range(shards):
        size = int(left.sum()) // (shards - s)
        out[s] = rng.multivariate_hypergeometric(left, size, method="marginals") if size else 0
        left = left - out[s]
    return out


def plan_sources(targets: list[tuple[str, float, int]], have: dict[str, tuple[int, int]], block_tokens: int, total_tokens: int | None) -> list[SourcePlan]:
    """How many blocks each source gives. have: tokens and blocks of each source.

    Without total_tokens the total is the largest at which every source that has texts meets its share within its repeats.
    With it, sources that cannot give their share give all they may, and the rest is divided among the others in proportion.
    A source without texts gives nothing and its share falls to the others; both show in the reported shares.
    """
    live = [t for t in targets if have.get(t[0], (0, 0))[1] > 0 and t[1] > 0 and t[2] > 0]
    room = {s: have[s][0] * m for s, _, m in live}
    want: dict[str, float] = {}
    if live and total_tokens is None:
        whole = sum(p for _, p, _ in live)
        total = min(room[s] * whole / p for s, p, _ in live)
        want = {s: total * p / whole for s, p, _ in live}
    elif live:
        open_, rest = list(live), float(total_tokens)
        while open_:
            whole = sum(p for _, p, _ in open_)
            full = [t for t in open_ if rest * t[1] / whole >= room[t[0]]]
            if not full:
                want |= {s: rest * p / whole for s, p, _ in open_}
                break
            want |= {s: float(room[s]) for s, _, _ in full}
            rest -= sum(room[s] for s, _, _ in full)
            open_ = [t for t in open_ if t not in full]
    out = []
    for s, p, m in targets:
        tokens, blocks = have.get(s, (0, 0))
        mean = tokens / blocks if blocks else 1.0
        out.append(SourcePlan(s, p, m, tokens, blocks, min(blocks * m, round(want.get(s, 0.0) / mean))))
    return out


def mix(items: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 256, seed: int = 7, shard_blocks: int = 256, max_shards: int = 4096) -> DataFrame:
    """The drawn parts of items: shard, slot, source, pass_no, item_id, token_start, n_tokens.

    items: source, item_id, n_tokens; targets: source (proper spelling), target_share, max_repeats, a small table that is read
    whole (checked: 10,000 rows at most). Items without source, with one that no target names, or without tokens are not drawn.
    A repeated target counts once, with its greatest share and repeats. Within one pass no token is drawn twice.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).orderBy("source").limit(10_001).collect()
    if len(wanted) > 10_000:
        raise ValueError("more than 10,000 sources")
    goal = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in wanted]
    mine = items.where((F.col("n_tokens") > 0) & F.col("source").isin([g[0] for g in goal])).select("source", "item_id", "n_tokens")
    strung = cut(string_together(mine, 64 * block_tokens))
    chains = strung.groupBy("source", "chain").agg(F.sum("n_tokens").alias("tokens")).withColumn("blocks", F.ceil(F.col("tokens") / block_tokens))
    have = {r[0]: (r[1], r[2]) for r in chains.groupBy("source").agg(F.sum("tokens"), F.sum("blocks")).collect()}
    plan = plan_sources(goal, have, block_tokens, total_tokens)
    drawn = [p.drawn for p in plan]
    shards = max(1, min(max_shards, 1_000_000 // max(1, len(plan)), sum(drawn) // shard_blocks))
    per_shard = draw_counts(drawn, shards, seed)
    before = np.cumsum(per_shard, axis=0) - per_shard
    rows = [(s, p.source, p.blocks, int(before[s, i]), int(per_shard[s, i])) for s in range(shards) for i, p in enumerate(plan) if per_shard[s, i]]
    spark = items.sparkSession
    slots = spark.createDataFrame(rows, "shard int, source string, size long, start long, n long")
    slots = slots.select("shard", "source", "size", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("size"))
    slots = slots.select("shard", "source", "slot", turn.cast("int").alias("pass_no"), permuted(F.pmod("slot", "size"), F.col("size"), F.lit(seed), F.col("source"), turn).alias("block"))
    base = F.coalesce(F.sum("blocks").over(Window.partitionBy("source").orderBy("chain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = block_spans(strung, block_tokens).join(chains.select("source", "chain", base.alias("base")), ["source", "chain"])
    spans = spans.select("source", (F.col("base") + F.col("chain_block")).alias("block"), "item_id", "token_start", "n_tokens")
    return slots.join(spans, ["source", "block"]).select("shard", "slot", "source", "pass_no", "item_id", "token_start", "n_tokens")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target share, the tokens drawn, its actual share of them and the most passes over its texts."""
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), (F.max("pass_no") + 1).alias("passes"))
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    all_ = goal.join(got, "source", "left").na.fill(0, ["drawn_tokens", "passes"])
    total = F.sum("drawn_tokens").over(Window.partitionBy())
    return all_.select("source", "target_share", "max_repeats", "drawn_tokens", "passes", F.when(total > 0, F.round(F.col("drawn_tokens") / total, 6)).alias("actual_share"))
