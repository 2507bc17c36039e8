"""Mixing sources to target weights by Pfair scheduling of source blocks.

Each source's documents, in a hashed order, form blocks. Over the sources that
still have blocks, with whole-number weights w of sum W, block k of a source
(from 0) is released at floor(k W / w) and due at ceil((k + 1) W / w); of the
released blocks the one due first takes the next slot. Every prefix of the
schedule then holds, for each source, its exact share of slots within less than
one block. A source keeps its weight to its last block. At the slot after it
the others go on, with releases and deadlines counted from there, so the bound
holds in each of these phases; no document is dropped. A phase repeats every W
slots, so one period is worked out (W is a bounded parameter) and a block's
slot follows from its number.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: Documents in a block.
BLOCK = 64
#: Largest sum of weights and largest number of weights, which bound the length of a period and the number of phases.
MAX_PERIOD, MAX_SOURCES = 4096, 256
#: Name of the group that takes sources without a weight of their own.
OTHER = "*"


def period(weights: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block number) of each slot of one period, by earliest deadline among released blocks."""
    total = sum(weights.values())
    releases = sorted((k * total // w, -(-(k + 1) * total // w), s, k) for s, w in weights.items() for k in range(w))
    ready: list[tuple[int, str, int]] = []
    out, i = [], 0
    for slot in range(total):
        while i < len(releases) and releases[i][0] <= slot:
            _, due, s, k = releases[i]
            heapq.heappush(ready, (due, s, k))
            i += 1
        due, s, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block is late")
        out.append((s, k))
    return out


Phase = tuple[int, int, dict[str, tuple[int, int, int, list[int]]]]


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[Phase]:
    """(first slot, period length, source -> (first block, block after the last, weight, slots of its blocks in a period)) until all blocks are placed."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, out, slot = dict.fromkeys(left, 0), [], 0
    while left:
        now = {s: weights[s] for s in left}
        total = sum(now.values())
        slots: dict[str, list[int]] = {s: [] for s in now}
        for at, (s, _) in enumerate(period(now)):
            slots[s].append(at)
        # the phase ends with the slot of the first last block
        length = 1 + min((n - 1) // now[s] * total + slots[s][(n - 1) % now[s]] for s, n in left.items())
        turns, rest = divmod(length, total)
        placed = {s: turns * w + bisect.bisect_left(slots[s], rest) for s, w in now.items()}
        out.append((slot, total, {s: (done[s], done[s] + placed[s], w, slots[s]) for s, w in now.items()}))
        slot += length
        for s, n in placed.items():
            done[s] += n
        left = {s: n - placed[s] for s, n in left.items() if n > placed[s]}
    return out


def schedule(df: DataFrame, weights: dict[str, int], source_col: str, order: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with mix_source, mix_block, mix_slot and mix_position (from 0, gapless: the place in the mixed order).

    ``weights`` holds whole numbers of sum at most MAX_PERIOD for at most
    MAX_SOURCES sources; the entry OTHER is for null and unlisted sources
    together (1 if it isn't given). ``order`` names the columns that tell rows
    apart; rows go by the MD5 of their values, and rows equal in them are
    interchangeable. Nulls are values of their own. Columns of ``df`` may have
    any names; ones called like the four are replaced. An empty table gives no
    rows.
    """
    weights = {OTHER: 1} | {str(s): int(w) for s, w in weights.items()}
    if min(weights.values()) < 1 or sum(weights.values()) > MAX_PERIOD or len(weights) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} weights must be positive and add up to at most {MAX_PERIOD}")
    own = common.Names(df)
    names = [c for c in df.columns if c not in COLUMNS]
    source = F.col(f"`{source_col}`").cast("string")
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in order]))
    group, rank = own("source"), own("rank")
    named = df.withColumn(group, F.when(source.isin([s for s in weights if s != OTHER]), source).otherwise(F.lit(OTHER)))
    placed, totals = common.ranked(named, [group], [digest, *[F.col(f"`{c}`") for c in order]], rank, own, part=lambda digits: F.substring(digest, 1, digits))
    # one row for each entry of the weights, so a bounded number comes to the driver
    sizes = {r[group]: r["n"] for r in totals.collect()}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    plan = phases(blocks, weights)
    # each source's last block may be short: slots after it begin earlier
    short, table = [], []
    for first, total, now in plan:
        for s, (begin, until, w, slots) in now.items():
            table.append((s, begin, until, w, total, first, slots))
            if until == blocks[s] and until > begin and sizes[s] % block:
                k = until - 1 - begin
                short.append((first + k // w * total + slots[k % w], block - sizes[s] % block))
    # a source has one entry for each phase, at most the number of weights: a table of bounded size
    entry = "struct<p_from:bigint,p_until:bigint,p_weight:bigint,p_total:bigint,p_first:bigint,p_slots:array<int>>"
    by_source: dict[str, list] = {}
    for s, *rest in table:
        by_source.setdefault(s, []).append(tuple(rest))
    p_source, p = own("p_source"), own("p")
    entries = df.sparkSession.createDataFrame([*by_source.items()], f"`{p_source}` string, `{p}` array<{entry}>")
    out = placed.withColumn("mix_block", F.expr(f"`{rank}` div {block}"))
    out = out.join(F.broadcast(entries), F.col(group) == F.col(p_source), "left")
    out = out.withColumn(p, F.filter(p, lambda x: (F.col("mix_block") >= x["p_from"]) & (F.col("mix_block") < x["p_until"]))[0])
    k = F.col("mix_block") - F.col(p)["p_from"]
    w = F.col(p)["p_weight"]
    out = out.withColumn("mix_slot", F.col(p)["p_first"] + F.floor(k / w) * F.col(p)["p_total"] + F.get(F.col(p)["p_slots"], (k % w).cast("int")))
    less = sum((F.when(F.col("mix_slot") > at, n).otherwise(0) for at, n in short), F.lit(0))
    out = out.withColumn("mix_position", (F.col("mix_slot") * block + F.expr(f"`{rank}` % {block}") - less).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in names], F.col(group).alias("mix_source"), *COLUMNS[1:])


#: What ``schedule`` adds.
COLUMNS = ("mix_source", "mix_block", "mix_slot", "mix_position")


def mixed(df: DataFrame, weights: dict[str, int], source_col: str = "source", order: tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """``df`` in mixed order: partitions hold ranges of the mixed position, sorted, so files written from it read in that order."""
    own = common.Names(df)
    held = {c: own(c) for c in df.columns}
    back = {v: k for k, v in held.items()}
    done = schedule(df.select(*[F.col(f"`{c}`").alias(n) for c, n in held.items()]), weights, held[source_col], [held[c] for c in order], block)
    return done.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*[F.col(n).alias(c) for n, c in back.items()])
