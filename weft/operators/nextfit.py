"""Next-fit on an ordered sequence, in parallel blocks.

Rows are taken in order; a pack closes with the row that brings it above ``length``.  Where a pack
ends depends on where it began, so a block of rows is described by a map: from the tokens that are held when
it is entered to the tokens held when it is left and the packs closed on the way.  The map has one
piece for each row that may close the first pack (at most ``length`` of them), since from the first closing on only the
block's own prefix sums matter: jump pointers lead from closing to closing and are doubled
until they leave the block.  Maps of neighbouring blocks compose, in rounds of doubling width, to the state in which every block
is entered; then each block closes its packs by itself.  No group is larger than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import pin

#: Rows of a block at least; a block has more rows than a pack has tokens, so that it closes one.
BLOCK_ROWS = 1 << 20
MAP = "shard int, block bigint, upto array<bigint>, held array<bigint>, closed array<bigint>"


def jumps(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, next closing after a closing): position k stands for the first k rows, the one behind
    the last row for "none"."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    after = np.searchsorted(total, total + length, side="right")
    return total, np.append(after, len(sizes) + 1)


def block_map(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``upto[j]``, ``held[j]``, ``closed[j]``: entered with h tokens, the first j with ``upto[j] > length - h``
    tells the tokens held at the end and the packs closed.  A last piece without an end closes nothing."""
    n = len(sizes)
    total, after = jumps(sizes, length)
    first = np.arange(1, min(int(np.searchsorted(total, length, side="right")), n) + 1)
    last, count = first.copy(), np.ones(len(first), dtype=np.int64)
    jump, steps = after.copy(), np.ones(n + 2, dtype=np.int64)
    jump[n + 1], steps[n + 1] = n + 1, 0
    # jump and steps go 2^j closings on; walk each start as far as it gets, from the widest jump down
    ladder = [(jump, steps)]
    while (ladder[-1][0][1 : n + 1] <= n).any():
        jump, steps = ladder[-1]
        ladder.append((jump[jump], steps + steps[jump]))
    for jump, steps in reversed(ladder):
        inside = jump[last] <= n
        count[inside] += steps[last[inside]]
        last[inside] = jump[last[inside]]
    return total[first], total[n] - total[last], count


def closings(sizes: np.ndarray, length: int, held: int) -> np.ndarray:
    """Row numbers that close a pack in a block entered with ``held`` tokens."""
    n = len(sizes)
    total, after = jumps(sizes, length)
    at = int(np.searchsorted(total, length - held, side="right"))
    closes = np.zeros(n + 2, dtype=bool)
    closes[at] = True
    jump = after
    jump[n + 1] = n + 1
    while True:  # those reached in less than 2^j closings, and as many closings further
        more = jump[np.flatnonzero(closes)]
        if (more == n + 1).all() or closes[more].all():
            closes[more] = True
            break
        closes[more] = True
        jump = jump[jump]
    return np.flatnonzero(closes[: n + 1]) - 1


def applied(piece: dict, held: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A map at several entries: (held at the end, packs closed)."""
    j = np.searchsorted(piece["upto"], length - held, side="right")
    end = np.append(piece["held"], 0)[j]
    none = j == len(piece["upto"])
    return np.where(none, held + piece["total"], end), np.append(piece["closed"], 0)[j]


def entries(rows: DataFrame, length: int) -> DataFrame:
    """``shard, block, held, packs``: the state in which each block is entered."""
    schema = MAP + ", total bigint"

    def described(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.sort_by("i").column("n").to_numpy()
        upto, held, closed = block_map(sizes, length)
        return _row(key[0].as_py(), key[1].as_py(), upto, held, closed, int(sizes.sum()))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["p"] is None:
                    own = r["m"]
                else:  # the earlier blocks' map first: its pieces stay
                    earlier, later = r["p"], r["m"]
                    held, closed = applied(_arrays(later), np.array(earlier["held"], dtype=np.int64), length)
                    own = {"upto": earlier["upto"], "held": held, "closed": closed + np.array(earlier["closed"], dtype=np.int64), "total": 0}
                yield from _row(r["shard"], r["block"], own["upto"], own["held"], own["closed"], own["total"]).to_batches()

    names = ["upto", "held", "closed", "total"]
    known = pin(rows.groupBy("shard", "block").applyInArrow(described, schema))
    blocks = known.agg(F.max("block")).first()[0] or 0
    width = 1
    while width <= blocks:  # map of the last 2 * width blocks from two of width each
        earlier = known.select("shard", (F.col("block") + width).alias("block"), F.struct(*names).alias("p"))
        both = known.select("shard", "block", F.struct(*names).alias("m")).join(earlier, ["shard", "block"], "left")
        known = pin(both.mapInArrow(composed, schema))
        width *= 2

    def entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                held, closed = applied(_arrays(r._asdict()), np.zeros(1, dtype=np.int64), length)
                out.append((r.shard, r.block + 1, int(held[0]), int(closed[0])))
            yield pd.DataFrame(out, columns=["shard", "block", "held", "packs"])

    state = "shard int, block bigint, held bigint, packs bigint"
    first = rows.select("shard").distinct().select("shard", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("held"), F.lit(0).cast("bigint").alias("packs"))
    return known.mapInPandas(entered, state).unionByName(first)


def _arrays(piece: dict) -> dict:
    return {k: np.asarray(piece[k], dtype=np.int64) if k != "total" else piece[k] for k in ("upto", "held", "closed", "total")}


def _row(shard: int, block: int, upto, held, closed, total: int) -> pa.Table:
    lists = pa.list_(pa.int64())
    columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), *(pa.array([np.asarray(x)], lists) for x in (upto, held, closed)), pa.array([total], pa.int64())]
    return pa.Table.from_arrays(columns, ["shard", "block", "upto", "held", "closed", "total"])


def next_fit(rows: DataFrame, length: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``shard, i, pack`` of (shard int, i bigint from 0 in each shard, n from 1): packs in order, each closed by the row
    that brings it above ``length``.  Rows of a shard's last, unclosed pack are left out."""
    size = max(block_rows, length + 1)
    cut = pin(rows.select("shard", "i", F.col("n").cast("bigint").alias("n"), F.expr(f"i div {size}").alias("block")))
    state = entries(cut, length)
    state_names = ["held", "packs"]

    def close(key: tuple, table: pa.Table, entered: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        held, packs = (entered.column(c)[0].as_py() for c in state_names)
        ends = closings(table.column("n").to_numpy(), length, held)
        own = np.searchsorted(ends, np.arange(table.num_rows), side="left")
        last = np.full(table.num_rows, len(ends))
        return pa.table({"shard": table.column("shard"), "i": table.column("i"), "pack": pa.array(packs + own), "open": pa.array(own == last)})

    there = state.join(cut.select("shard", "block").distinct(), ["shard", "block"])
    there = there.select(F.col("shard").alias("of"), F.col("block").alias("at"), *state_names)
    groups = cut.groupBy("shard", "block").cogroup(there.groupBy("of", "at"))
    placed = groups.applyInArrow(close, "shard int, i bigint, pack bigint, open boolean")
    # a pack left open by its block is closed by a later one, unless it is the shard's last
    total = placed.filter("not open").groupBy("shard").agg((F.max("pack") + 1).alias("__closed"))
    return placed.join(total, "shard").filter(F.col("pack") < F.col("__closed")).select("shard", "i", "pack")
