"""Blocks of a stream mined as they fill up, in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mine_block(transactions: list[list[str]], least: int, max_size: int | None = None) -> list[tuple[list[str], int]]:
    """Itemsets of a block, depth first over bit sets of its transactions; memory is bounded by the block."""
    where: dict[str, int] = {}
    for i, t in enumerate(transactions):
        for x in set(t):
            where[x] = where.get(x, 0) | 1 << i
    out: list[tuple[list[str], int]] = []

    def go(prefix: list[str], bits: int, rest: list[str]) -> None:
        for i, x in enumerate(rest):
            both = where[x] if bits < 0 else bits & where[x]
            if (n := both.bit_count()) >= max(1, least):
                out.append(([*prefix, x], n))
                if max_size is None or len(prefix) + 1 < max_size:
                    go([*prefix, x], both, rest[i + 1 :])

    go([], -1, sorted(where))
    return out


def mine_stream(stream: DataFrame, block: int, min_support: float, max_size: int | None = None) -> DataFrame:
    """(block, items, count) of every block of a streaming DataFrame (tid, items), once all its transactions are there.

    tid comes from the data: a block is floor(tid / block), so replays and late rows end where they belong. State is
    the transactions of the blocks under way; blocks are independent keys.
    """
    from harvestry.operators.mining import least_count

    least = least_count(block, min_support)

    def of_block(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for b in batches:
            held.update(zip(b["tid"].tolist(), ("\x1f".join(x) for x in b["items"]), strict=True))
        if len(held) < block:
            state.update((list(held), list(held.values())))
            return
        if state.exists:
            state.remove()
        rows = mine_block([t.split("\x1f") if t else [] for t in held.values()], least, max_size)
        yield pd.DataFrame({"block": [key[0]] * len(rows), "items": [r[0] for r in rows], "count": [r[1] for r in rows]})

    keyed = stream.withColumn("block", F.floor(F.col("tid") / block))
    return keyed.groupBy("block").applyInPandasWithState(of_block, "block long, items array<string>, count long", "tids array<long>, texts array<string>", "append", "NoTimeout")
