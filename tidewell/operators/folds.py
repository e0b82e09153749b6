"""Folds of given weights inside partitions: controlled rounding of the cell x fold table by network flow, rows dealt by hash."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.ranks import hash_rank, join_nulls

ALL = "(all)"


def fold_sizes(total: int, weights) -> np.ndarray:
    """Whole fold sizes in proportion to weights that add up to total: largest remainders, ties to the first fold."""
    w = np.asarray(weights, float)
    exact = total * w / w.sum()
    out = np.floor(exact + 1e-9).astype(np.int64)
    order = np.lexsort((np.arange(len(w)), -np.round(exact - out, 9)))
    out[order[: total - out.sum()]] += 1
    return out


def feasible_flow(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int] | None:
    """A whole flow for edges (from, to, least, most) that keeps all bounds, or None; found by shortest augmenting paths.

    What the lower bounds need is sent from a source of its own to a sink of its own; the flow exists if all of it arrives.
    """
    first, last = nodes, nodes + 1
    head: list[list[int]] = [[] for _ in range(nodes + 2)]
    to: list[int] = []
    room: list[int] = []

    def arc(u: int, v: int, most: int) -> int:
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((most, 0))
        return len(to) - 2

    own = [arc(u, v, most - least) for u, v, least, most in edges]
    arc(sink, source, sum(most for *_, most in edges) + 1)
    need = [0] * nodes
    for u, v, least, _ in edges:
        need[v] += least
        need[u] -= least
    for v, n in enumerate(need):
        if n:
            arc(first, v, n) if n > 0 else arc(v, last, -n)
    left = sum(n for n in need if n > 0)
    while left:
        came, queue = {first: -1}, deque([first])
        while queue and last not in came:
            u = queue.popleft()
            for e in head[u]:
                if room[e] and to[e] not in came:
                    came[to[e]] = e
                    queue.append(to[e])
        if last not in came:
            return None
        path, v = [], last
        while v != first:
            path.append(came[v])
            v = to[came[v] ^ 1]
        sent = min(room[e] for e in path)
        for e in path:
            room[e] -= sent
            room[e ^ 1] += sent
        left -= sent
    return [least + room[a + 1] for a, (_, _, least, _) in zip(own, edges, strict=True)]


def round_table(sizes: np.ndarray, levels: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Rows of each cell in each fold: cells and folds hold what they must, each count and each level's sum is a neighbour of its target.

    sizes are the cells' rows, levels (cells x variables) their levels, folds the folds' sizes. Targets are
    cell * fold / total. The levels of the first variable contain whole cells, so a flow cell - level - fold - sink has the
    targets themselves as a solution in fractions and therefore one in whole numbers. Levels of further variables
    cross them, for which no such solution is certain; they are then mended by exchanges (mend). fold_margins shows what may remain.
    """
    total = int(sizes.sum())
    target = sizes[:, None] * folds / max(total, 1)
    low = sizes[:, None] * folds // max(total, 1)
    part = sizes[:, None] * folds % max(total, 1) > 0
    codes, first = np.unique(levels[:, 0], return_inverse=True) if levels.shape[1] else (np.zeros(1), np.zeros(len(sizes), int))
    n, m, k = len(sizes), len(codes), len(folds)
    level_rows = np.bincount(first, weights=sizes, minlength=m).astype(np.int64)
    cell, at, fold, source, sink = 0, n, n + m * k, n + m * k + k, n + m * k + k + 1
    edges = [(source, cell + c, int(s), int(s)) for c, s in enumerate(sizes)]
    inner = [(cell + c, at + int(first[c]) * k + f, int(low[c, f]), int(low[c, f] + part[c, f])) for c in range(n) for f in range(k)]
    edges = inner + edges
    edges += [(at + a * k + f, fold + f, int(level_rows[a] * folds[f] // total), int(-(-level_rows[a] * folds[f] // total))) for a in range(m) for f in range(k)]
    edges += [(fold + f, sink, int(t), int(t)) for f, t in enumerate(folds)]
    flow = feasible_flow(sink + 1, edges, source, sink)
    if flow is None:
        raise ValueError("fold sizes don't add up to the rows")
    x = np.array(flow[: n * k], np.int64).reshape(n, k)
    if levels.shape[1] > 1:
        mend(x, low, part, levels, target)
    return x


def mend(x: np.ndarray, low: np.ndarray, part: np.ndarray, levels: np.ndarray, target: np.ndarray, tries: int = 400) -> None:
    """Exchanges rows of two cells between two folds until every level's sum is less than one off its target, or `tries` for each sum are over.

    An exchange keeps cells and folds. It is taken if what all sums are too far off doesn't grow in total (the first
    variable's sums, which are right, may not become wrong); equal totals are taken too, so the search isn't caught at the first dead end.
    """
    rng = np.random.default_rng(0)
    member = [np.array([levels[:, v] == lv for lv in np.unique(levels[:, v])]) for v in range(levels.shape[1])]
    every, heavy = np.concatenate(member), len(member[0])
    off = every @ (x - target)
    excess = lambda d: np.maximum(np.abs(d) - (1 - 1e-9), 0)
    of_cell = [np.flatnonzero(column) for column in every.T]
    for _ in range(tries * off.size):
        wrong = np.argwhere(excess(off) > 0)
        if not len(wrong):
            return
        level, f = wrong[rng.integers(len(wrong))]
        sign = 1 if off[level, f] > 0 else -1  # rows are to leave fold f, or to come
        full, spare = part & (x > low), part & (x == low)
        gives, takes = (full, spare) if sign > 0 else (spare, full)
        cells = np.flatnonzero(every[level] & gives[:, f])
        if not len(cells):
            continue
        c = rng.choice(cells)
        others = np.flatnonzero(takes[c])
        if not len(others):
            continue
        g = rng.choice(others)
        mates = np.flatnonzero(~every[level] & takes[:, f] & gives[:, g])
        if not len(mates):
            continue
        d = rng.choice(mates)
        touched = np.union1d(of_cell[c], of_cell[d])
        change = (every[touched, c].astype(int) - every[touched, d])[:, None] * np.array([-sign, sign])
        before, after = off[np.ix_(touched, [f, g])], off[np.ix_(touched, [f, g])] + change
        first = touched < heavy
        if excess(after).sum() <= excess(before).sum() + 1e-12 and not excess(after[first]).any():
            x[c, f] -= sign
            x[c, g] += sign
            x[d, f] += sign
            x[d, g] -= sign
            off[np.ix_(touched, [f, g])] = after


def weighted_folds(rows: DataFrame, id_col: str, strata, weights, tag: str, partition=()) -> DataFrame:
    """(id, partition, strata, fold) with folds of exactly the sizes that weights give each partition, by largest remainders.

    Every joint cell of the strata and every level of the first one lies within one row of its target in every fold; so
    do the levels of the others unless they can't (see round_table, fold_margins). Only counts of cells meet, a task for each
    partition; rows are then dealt by the order of their hash within a cell. Null levels are levels; ids are to be distinct.
    """
    strata, partition, weights = list(strata), list(partition), [float(w) for w in weights]
    if not weights or min(weights) <= 0:
        raise ValueError("fold weights must be above 0")
    keys = [*partition, *strata]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    named = counts.select(F.to_json(F.struct(F.lit(0).alias("_"), *partition)).alias("_p"), F.to_json(F.struct(F.lit(0).alias("_"), *keys)).alias("_cell"), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in strata]).alias("_levels"), "_n")

    def allot(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_cell")
        n = own["_n"].to_numpy(np.int64)
        x = round_table(n, np.array([list(a) for a in own["_levels"]], object).reshape(len(n), -1), fold_sizes(int(n.sum()), weights))
        return pd.DataFrame({"_cell": own["_cell"], "_ends": list(np.cumsum(x, axis=1))})

    ends = named.groupBy("_p").applyInPandas(allot, "_cell string, _ends array<long>")
    ranked = hash_rank(rows.select(id_col, *keys), keys, fn.hash_rank_key(tag, F.col(id_col)), id_col)
    placed = join_nulls(ranked, counts.select(*keys, F.to_json(F.struct(F.lit(0).alias("_"), *keys)).alias("_cell")), keys).join(ends, "_cell")
    return placed.select(id_col, *keys, F.size(F.filter("_ends", lambda e: e < F.col("rank"))).cast("long").alias("fold"))


def fold_margins(assigned: DataFrame, strata, weights, partition=()) -> DataFrame:
    """(partition, variable, level, fold, n, target, within) of all rows, each stratum's levels and the joint cells; levels without rows in a fold included.

    target is level * fold / partition; within says that n is less than one off, and for all rows that n is the fold's size.
    """
    strata, partition, k = list(strata), list(partition), len(weights)
    text = lambda *c: F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("<MISSING>")) for x in c])
    named = [(ALL, F.lit(ALL)), *[(s, text(s)) for s in strata], *([(" x ".join(strata), text(*strata))] if len(strata) > 1 else [])]
    long = assigned.select(*partition, "fold", F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), c.alias("level")) for n, c in named])).alias("x")).select(*partition, "fold", "x.*")
    counts = long.groupBy(*partition, "variable", "level").agg(F.array(*[F.count_if(F.col("fold") == f) for f in range(k)]).alias("_in"))
    each = counts.select(*partition, "variable", "level", F.posexplode("_in").alias("fold", "n")).withColumn("fold", F.col("fold").cast("long"))
    sizes = each.where(F.col("variable") == ALL).select(*partition, "fold", F.col("n").alias("_size"))
    totals = sizes.groupBy(*partition).agg(F.sum("_size").alias("_total"))
    own = counts.select(*partition, "variable", "level", F.aggregate("_in", F.lit(0).cast("long"), lambda a, b: a + b).alias("_rows"))
    full = join_nulls(join_nulls(join_nulls(each, own, [*partition, "variable", "level"]), sizes, [*partition, "fold"]), totals, partition)
    target = F.when(F.col("variable") == ALL, F.col("_size").cast("double")).otherwise(F.col("_rows") * F.col("_size") / F.col("_total"))
    return full.select(*partition, "variable", "level", "fold", "n", target.alias("target"), (F.abs(F.col("n") - target) < 1 - 1e-9).alias("within"))
