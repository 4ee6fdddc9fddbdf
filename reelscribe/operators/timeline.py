"""Ordered scans over timelines that stay parallel inside one hot part.

A plain ``Window.partitionBy(part)`` sends a whole part to one task. Here every part is cut into
*blocks* by an expression that never decreases along the order (``seq div 8192`` or a time bucket).
A scan runs inside each block, a summary of one row per block is scanned per part, and the carry of
the earlier blocks is joined back on the keys the block window is already partitioned by, so the
rows are shuffled once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK = "_block"
ROWS_PER_BLOCK = 8192


@dataclass(frozen=True)
class Timeline:
    """Partition columns, a unique order within them, and the blocks: ``block_on`` cut every ``block_span``.

    ``block_on`` is an integer column that never decreases along the order.
    """

    part: Sequence[str]
    order: Sequence[str]
    block_on: str
    block_span: int

    @property
    def block(self) -> Column:
        return F.col(self.block_on).cast("long") if self.block_span == 1 else F.floor(F.col(self.block_on) / self.block_span).cast("long")


def by_position(part: Sequence[str], position: str = "seq", rows: int = ROWS_PER_BLOCK) -> Timeline:
    """Timeline over a dense position column."""
    return Timeline(tuple(part), (position,), position, rows)


def by_time(part: Sequence[str], time: str, tie: str, span: int) -> Timeline:
    """Timeline over an integer time column, ``tie`` making the order unique."""
    return Timeline(tuple(part), (time, tie), time, span)


def keyed(df: DataFrame, line: Timeline) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with its block and null-free copies of the part columns; the names of the copies, and of copies and block.

    A null part is a part like any other; on the copies plain equi-joins keep its rows, and windows and joins share one
    partitioning. Rows without a place in time come first, in a block of their own.
    """
    part: list[str] = []
    copies: dict[str, Column] = {}
    nullable = [c for c in line.part if df.schema[c].nullable]
    for i, c in enumerate(line.part):
        kind = df.schema[c].dataType
        name = f"_part{i}"
        part.append(name)
        if c not in nullable:
            copies[name] = F.col(c)
        elif isinstance(kind, (T.StringType, T.NumericType)):
            copies[name] = F.coalesce(F.col(c), F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind))
        else:
            copies[name] = F.struct(F.col(c))
    if nullable:
        part.append("_nameless")
        copies["_nameless"] = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(nullable)), F.lit(0))
    return df.withColumns({**copies, BLOCK: F.coalesce(line.block, F.lit(-(1 << 63)))}), part, [*part, BLOCK]


def join_parts(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns where null meets null; ``right`` gives its other columns."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    joined = left.join(named, functools.reduce(Column.__and__, same, F.lit(True)), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_on_{c}" for c in on])


def split_hot_blocks(df: DataFrame, line: Timeline, rows: int = ROWS_PER_BLOCK, fan: int = 32) -> tuple[DataFrame, Timeline]:
    """Cut every block that holds more than ``rows`` rows into pieces of near-equal size, still in order, until none is left.

    For time blocks, where one part may crowd very many rows into one bucket, or one instant. The borders are a sample of the whole order
    (time and tie), as a range partitioner draws it: about 32 rows for each piece, chosen by the hash of their key, so
    every run draws the same; they are written once. A pass makes up to ``fan`` squared pieces of a block, found in two
    steps; only blocks with still more than that times ``rows`` need another pass. Rows of one and the same key stay together.
    """
    from reelscribe.session import stage_table

    order = F.struct(*[F.col(c) for c in line.order])
    while True:
        placed, _, keys = keyed(df, line)
        sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(f"_n > {rows}")
        sizes = stage_table(sizes.withColumn("_pieces", F.least(F.lit(fan * fan), F.ceil(F.col("_n") * 2 / rows)).cast("int")))
        if sizes.isEmpty():
            return df, line
        share = F.least(F.lit(1.0), F.col("_pieces") * 32 / F.col("_n")) * (1 << 20)
        drawn = placed.join(sizes, keys).filter(F.pmod(F.xxhash64(*keys, *line.order), F.lit(1 << 20)) < share)
        listed = drawn.groupBy(*keys, "_pieces").agg(F.array_sort(F.collect_set(order)).alias("_d"))  # some 32 for a piece
        chosen = F.transform(F.sequence(F.lit(1), F.col("_pieces") - 1), lambda i: F.get("_d", F.floor(i * F.size("_d") / F.col("_pieces")).cast("int")))
        # No border is the first row drawn, so each leaves rows on both sides.
        crowded = listed.withColumn("_points", F.array_distinct(F.filter(chosen, lambda p: p > F.get("_d", F.lit(0))))).filter(F.size("_points") > 0)
        crowded = stage_table(crowded.select(*keys, "_points", F.filter("_points", lambda _, i: i % fan == 0).alias("_heads")))
        most = crowded.agg(F.max(F.size("_points"))).first()[0]
        if most is None:
            return df, line
        heads = F.size(F.filter("_heads", lambda p: p <= order))
        below = F.size(F.filter(F.slice("_points", F.greatest(heads - 1, F.lit(0)) * fan + 1, F.lit(fan)), lambda p: p <= order))
        piece = F.when(F.col("_points").isNull() | (heads == 0), 0).otherwise((heads - 1) * fan + below)
        block = F.when(F.col(BLOCK) == -(1 << 63), -(1 << 42)).otherwise(F.col(BLOCK))
        df = placed.join(crowded, keys, "left").withColumn("_cut", block * (1 << most.bit_length()) + piece).select(*[c for c in df.columns if c != "_cut"], "_cut")
        line = Timeline(line.part, line.order, "_cut", 1)


def scan(
    df: DataFrame,
    line: Timeline,
    *,
    previous: Mapping[str, Column | str] | None = None,
    following: Mapping[str, Column | str] | None = None,
    max_before: Mapping[str, Column | str] | None = None,
    max_upto: Mapping[str, Column | str] | None = None,
    sum_before: Mapping[str, Column | str] | None = None,
    sum_upto: Mapping[str, Column | str] | None = None,
    row_number: str | None = None,
) -> DataFrame:
    """Add lag/lead columns, prefix maxima, prefix sums and a row number along ``line``."""

    def cols(mapping: Mapping[str, Column | str] | None) -> dict[str, Column]:
        return {k: F.col(v) if isinstance(v, str) else v for k, v in (mapping or {}).items()}

    previous, following = cols(previous), cols(following)
    maxima = {**{k: (v, False) for k, v in cols(max_before).items()},
              **{k: (v, True) for k, v in cols(max_upto).items()}}
    sums = {**{k: (v, False) for k, v in cols(sum_before).items()},
            **{k: (v, True) for k, v in cols(sum_upto).items()}}
    if row_number:
        sums[row_number] = (F.lit(1).cast("long"), True)

    rows, part, keys = keyed(df, line)
    order_key = F.struct(*[F.col(c) for c in line.order])
    local = Window.partitionBy(*keys).orderBy(*line.order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)

    def packed(mapping: dict[str, Column]) -> Column:
        return F.struct(*[v.alias(k) for k, v in mapping.items()])

    summary_aggs: list[Column] = []
    if previous:
        summary_aggs.append(F.max_by(packed(previous), order_key).alias("_last"))
    if following:
        summary_aggs.append(F.min_by(packed(following), order_key).alias("_first"))
    summary_aggs += [F.max(v).alias(f"_m_{k}") for k, (v, _) in maxima.items()]
    summary_aggs += [F.sum(v).alias(f"_s_{k}") for k, (v, _) in sums.items()]
    if not summary_aggs:
        return df
    summary = rows.groupBy(*keys).agg(*summary_aggs)

    chain = Window.partitionBy(*part).orderBy(BLOCK)
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols: list[Column] = []
    if previous:
        carry_cols.append(F.lag("_last").over(chain).alias("_c_last"))
    if following:
        carry_cols.append(F.lead("_first").over(chain).alias("_c_first"))
    carry_cols += [F.max(f"_m_{k}").over(earlier).alias(f"_cm_{k}") for k in maxima]
    carry_cols += [F.sum(f"_s_{k}").over(earlier).alias(f"_cs_{k}") for k in sums]
    carry = summary.select(*keys, *carry_cols)

    inner: list[Column] = []
    if previous:
        inner.append(F.lag(packed(previous)).over(local).alias("_l_last"))
    if following:
        inner.append(F.lead(packed(following)).over(local).alias("_l_first"))
    inner += [F.max(v).over(upto if inc else before).alias(f"_lm_{k}") for k, (v, inc) in maxima.items()]
    inner += [F.sum(v).over(upto if inc else before).alias(f"_ls_{k}") for k, (v, inc) in sums.items()]
    joined = rows.select("*", *inner).join(carry, keys, "left")

    out: list[Column] = [F.col(c) for c in df.columns]
    out += [F.coalesce("_l_last", "_c_last")[k].alias(k) for k in previous]
    out += [F.coalesce("_l_first", "_c_first")[k].alias(k) for k in following]
    out += [F.greatest(F.col(f"_lm_{k}"), F.col(f"_cm_{k}")).alias(k) for k in maxima]
    out += [(F.coalesce(f"_ls_{k}", F.lit(0)) + F.coalesce(f"_cs_{k}", F.lit(0))).alias(k) for k in sums]
    return joined.select(*out)


# --------------------------------------------------------------------------------------------------
# Carried-state folds
# --------------------------------------------------------------------------------------------------

_NONE = np.iinfo("int64").min
ALWAYS = np.iinfo("int64").max


def _next_starts(thr: np.ndarray, val: np.ndarray) -> np.ndarray:
    """For a group starting at p, the first q > p with thr[q] > val[p]; len(thr) when none.

    All rows search at once in a table of maxima over runs of 1, 2, 4, ... rows: a row leaps over a run whose maximum does
    not exceed its value, longest runs first, so the cost is n log n whatever opens.
    """
    n = len(thr)
    at = np.arange(1, n + 1)
    tables = [thr]
    while 2 << (len(tables) - 1) <= n:
        last, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.maximum(last[:-half], last[half:]))
    for k in range(len(tables) - 1, -1, -1):
        for _ in range(2 if k == len(tables) - 1 else 1):
            fits = at + (1 << k) <= n
            rows = np.flatnonzero(fits)
            leap = tables[k][at[rows]] <= val[rows]
            at[rows[leap]] += 1 << k
    return at


def _transfer(thr: np.ndarray, val: np.ndarray) -> tuple[list[int], list[int]]:
    """The carried value at exit as a step function of the one at entry: (upper bounds, exits)."""
    nxt = _next_starts(thr, val).tolist()
    n = len(thr)
    leave = val.tolist()
    for p in range(n - 1, -1, -1):
        if nxt[p] < n:
            leave[p] = leave[nxt[p]]
    bounds: list[int] = []
    exits: list[int] = []
    peak = np.maximum.accumulate(thr)
    for p in np.flatnonzero(np.r_[True, peak[1:] > peak[:-1]]).tolist():
        # An entry value below thr[p], and not below earlier records, opens its first group at p.
        if exits and exits[-1] == leave[p]:
            bounds[-1] = int(thr[p])
        else:
            bounds.append(int(thr[p]))
            exits.append(leave[p])
    return bounds, exits


def _fold(thr: np.ndarray, val: np.ndarray, entry: int) -> list[bool]:
    nxt = _next_starts(thr, val).tolist()
    opens = [False] * len(thr)
    above = np.flatnonzero(thr > entry) if entry != _NONE else (0,)
    p = int(above[0]) if len(above) else len(thr)
    while p < len(thr):
        opens[p] = True
        p = nxt[p]
    return opens


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches re-cut so that no group (run of equal keys) spans two; with the group starts and the end."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if batch.empty:
            continue
        changes = np.zeros(len(batch), dtype=bool)
        changes[0] = True
        for k in keys:
            column = batch[k].to_numpy()
            changes[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(changes)
        rest = batch.iloc[starts[-1]:]
        if len(starts) > 1:
            yield batch.iloc[: starts[-1]], starts
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _folded(df: DataFrame, line: Timeline, columns: dict[str, Column], transfer: Callable, step: Callable, fold: Callable, entry: int,
            flag: str, number: str | None) -> DataFrame:
    """Fold long ``columns`` along the line, block by block: ``flag`` per row, and ``number`` counts the flags of a part up to each row.

    ``transfer`` turns a block's arrays into two lists, a function of the carried number; ``step`` applies them to it in the order of
    the blocks; ``fold`` gives the block's flags for its known entry. Only keys and numbers go through Python; a block comes
    back as one row of running counts, and the counts of earlier blocks are added up over these rows, so the fold runs once.
    """
    order, names = list(line.order), list(columns)
    rows, part, keys = keyed(df, line)
    narrow = rows.select(*keys, *order, *[c.cast("long").alias(name) for name, c in columns.items()])
    key_fields = [narrow.schema[c] for c in keys]
    numbers = T.ArrayType(T.LongType())

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _whole_groups(batches, keys):
            arrays = [pdf[c].to_numpy("int64") for c in names]
            steps = [transfer(*(x[a:b] for x in arrays)) for a, b in zip(starts, starts[1:])]
            yield pdf[keys].iloc[starts[:-1]].assign(_left=[s[0] for s in steps], _right=[s[1] for s in steps])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, carried = None, entry
        for pdf in batches:
            entries = []
            for name, left, right in zip(zip(*[pdf[k] for k in part]) if part else [()] * len(pdf), pdf["_left"], pdf["_right"]):
                if name != current:
                    current, carried = name, entry
                entries.append(carried)
                carried = step(carried, left, right)
            yield pdf[keys].assign(_entry=entries)

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _whole_groups(batches, keys):
            arrays, entries = [pdf[c].to_numpy("int64") for c in names], pdf["_entry"].to_numpy("int64")
            flags = [fold(*(x[a:b] for x in arrays), int(entries[a])) for a, b in zip(starts, starts[1:])]
            yield pdf[keys].iloc[starts[:-1]].assign(_counts=[np.cumsum(f) for f in flags])

    def in_order(frame: DataFrame, by: list[str], then: list[str]) -> DataFrame:
        spread = frame.repartition(*by) if by else frame.coalesce(1)
        return spread.sortWithinPartitions(*by, *then)

    # Placed by block once: the transfer pass and the join below read the same shuffle.
    placed_once = narrow.repartition(*keys)
    steps = placed_once.sortWithinPartitions(*keys, *order).mapInPandas(
        transfers, T.StructType([*key_fields, T.StructField("_left", numbers), T.StructField("_right", numbers)]))
    entries = in_order(steps, part, [BLOCK]).mapInPandas(
        chain, T.StructType([*key_fields, T.StructField("_entry", T.LongType())]))
    # The explicit repartition after the join stays: a join may be split for skew, a block must not be.
    flags = in_order(placed_once.join(entries, keys), keys, order).mapInPandas(
        folds, T.StructType([*key_fields, T.StructField("_counts", numbers)]))
    if number:
        earlier = Window.partitionBy(*part).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        flags = flags.withColumn("_base", F.coalesce(F.sum(F.element_at("_counts", -1)).over(earlier), F.lit(0)))
    local = Window.partitionBy(*keys).orderBy(*order)
    placed = rows.withColumn("_at", F.row_number().over(local) - 1).join(flags, keys)
    marked = F.get("_counts", F.col("_at")) > F.coalesce(F.get("_counts", F.col("_at") - 1), F.lit(0))
    numbered = [(F.col("_base") + F.get("_counts", F.col("_at"))).alias(number)] if number else []
    return placed.select(*df.columns, marked.alias(flag), *numbered)


def carried_groups(df: DataFrame, line: Timeline, threshold: Column, value: Column,
                   flag: str = "starts_group", number: str | None = None) -> DataFrame:
    """Mark the rows that open a group in a greedy left-to-right grouping; ``number`` also numbers the groups of a part from 1.

    A row opens a group when ``threshold`` exceeds the ``value`` of the row that opened the current
    group; the first row of a part always does. Both are long columns; use ``ALWAYS`` for rows that
    open one in any case. A block's transfer function has a few steps only, because chains merge.
    A row without threshold opens a group, and so does the one after a row without value.
    """
    def step(carried: int, bounds: np.ndarray, exits: np.ndarray) -> int:
        at = 0 if carried == _NONE else int(np.searchsorted(bounds, carried, side="right"))
        return int(exits[at]) if at < len(bounds) else carried

    columns = {"_thr": F.coalesce(threshold.cast("long"), F.lit(int(ALWAYS))), "_val": F.coalesce(value.cast("long"), F.lit(int(_NONE) + 1))}
    return _folded(df, line, columns, _transfer, step, _fold, int(_NONE), flag, number)


def _closing_states(limit: np.ndarray) -> tuple[list[int], list[int]]:
    """The states at entry from which a block closes once, twice, ... , as runs of consecutive numbers: (starts, lengths).

    A row closes in state k < limit and moves to k + 1. Two entries never come apart, so a block closes once for each of
    its numbers that is not below the entry. ``after[p]``: the state after all rows so far, entered with ``states[p]``.
    """
    states, after = np.zeros(len(limit), np.int64), np.zeros(len(limit), np.int64)
    for used, m in enumerate(limit.tolist()):
        i = int(np.searchsorted(after[:used], m, "left"))  # entries up to states[i - 1] are still below m
        states[i + 1 : used + 1], after[i + 1 : used + 1] = states[i:used].copy(), after[i:used].copy()
        after[:i] += 1
        states[i], after[i] = m - 1 - (used - i), m
    kept = states[states >= 0]
    breaks = np.flatnonzero(np.r_[True, np.diff(kept) != 1])[: len(kept)]
    return kept[breaks].tolist(), np.diff(np.append(breaks, len(kept))).tolist()


def closed_by_limits(df: DataFrame, line: Timeline, limit: Column, flag: str = "closes", number: str | None = None) -> DataFrame:
    """Mark the rows that close a group: a row closes in state k below its ``limit`` and leaves state k + 1; a part begins in state 0."""

    def step(carried: int, starts: np.ndarray, lengths: np.ndarray) -> int:
        starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
        return carried + int(np.clip(starts + lengths - np.maximum(starts, carried), 0, None).sum())

    def fold(limits: np.ndarray, state: int) -> list[bool]:
        out = []
        for m in limits.tolist():
            out.append(state < m)
            state += state < m
        return out

    return _folded(df, line, {"_limit": F.coalesce(limit.cast("long"), F.lit(0))}, _closing_states, step, fold, 0, flag, number)


def islands(df: DataFrame, line: Timeline, start: str, end: str, name: str = "island") -> DataFrame:
    """Number the runs of touching or overlapping intervals; ``line`` must be ordered by ``start``."""
    lagged = scan(df, line, max_before={"_reach": end})
    opened = lagged.withColumn("_opens", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("long"))
    return scan(opened, line, sum_upto={name: "_opens"}).drop("_reach", "_opens")


def interval_union_length(df: DataFrame, line: Timeline, start: str, end: str,
                          lower: Column | None = None, upper: Column | None = None) -> DataFrame:
    """Covered length per part after clipping to [lower, upper]; inverted rows are dropped.

    With the running maximum R of earlier ends, a row adds ``max(0, end - max(start, R))``; the sum of
    these is the length of the union, so one scan and one aggregate with map-side combine are enough.
    """
    lo = F.col(start) if lower is None else F.greatest(F.col(start), lower)
    hi = F.col(end) if upper is None else F.least(F.col(end), upper)
    clipped = df.withColumn("_s", lo).withColumn("_e", hi).filter(F.col("_e") >= F.col("_s"))
    reached = scan(clipped, line, max_before={"_reach": "_e"})
    gain = F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col("_s"), F.coalesce("_reach", F.col("_s"))))
    return reached.groupBy(*line.part).agg(F.sum(gain).alias("covered"))
