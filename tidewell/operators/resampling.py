"""Bootstrap counts that keep the sizes of strata: hits of a draw are split down a tree of ranks by seeded binomials."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks that one group counts together, a power of two.
CHUNK = 512
#: Trials of each draw that are counted at once.
TRIALS = 2048
#: Draws that one task takes down the tree of a stratum.
BLOCK = 50


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32 bits that spreads neighbours (two rounds of shifts and products)."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def left_hits(hits: np.ndarray, share: float, name: str, first: int = 0) -> np.ndarray:
    """Of each draw's hits on a node how many fall to its left half, which holds `share` of its ranks: a count of seeded trials each. Draws are numbered from `first` on."""
    seed = int(hashlib.md5(name.encode()).hexdigest()[:8], 16)
    base = mix(mix(np.full(1, seed, np.uint32)) + np.arange(first, first + len(hits), dtype=np.uint32))
    out = np.zeros(len(hits), np.int64)
    for at in range(0, int(hits.max(initial=0)), TRIALS):
        n = np.clip(hits - at, 0, TRIALS)
        owner = np.repeat(np.arange(len(hits)), n)
        trial = at + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        won = (mix(base[owner] + trial.astype(np.uint32)).astype(float) + 0.5) / 2.0**32 < share
        out += np.bincount(owner, weights=won, minlength=len(hits)).astype(np.int64)
    return out


def halves(stratum: str, n: int, k: int, a: int, own: np.ndarray, tag: str, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hits of both halves of the node of 2^k ranks from `a` on."""
    size, left = min(n - a, 1 << k), min(n - a, 1 << (k - 1))
    down = own if left == size else left_hits(own, left / size, f"{tag}|{stratum}|{k}|{a}", first)
    return down, own - down


def root(n: int) -> int:
    """The root of a stratum of n ranks covers 2^k ranks, a chunk at least."""
    return max(int(n - 1).bit_length(), CHUNK.bit_length() - 1)


def chunk_hits(stratum: str, n: int, first: int, draws: int, tag: str) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, hits of each draw) of all chunks of a stratum: each node above the chunks is counted once."""
    left = [(root(n), 0, np.full(draws, n, np.int64))]
    while left:
        k, a, own = left.pop()
        if 1 << k == CHUNK:
            yield a // CHUNK, own
            continue
        down, rest = halves(stratum, n, k, a, own, tag, first)
        half = 1 << (k - 1)
        left += [(k - 1, a + half, rest)] * (a + half < n) + [(k - 1, a, down)]


def rank_hits(stratum: str, n: int, chunk: int, own: np.ndarray, tag: str) -> np.ndarray:
    """(ranks x draws): a chunk's hits dealt to its CHUNK ranks."""
    k, a, level = CHUNK.bit_length() - 1, chunk * CHUNK, own[None]
    while k:
        both = [halves(stratum, n, k, a + (i << k), h, tag) if a + (i << k) < n else (h, h * 0) for i, h in enumerate(level)]
        level = np.array([h for pair in both for h in pair])
        k -= 1
    return level


def hits(stratum: str, n: int, chunk: int, draws: int, tag: str) -> np.ndarray:
    """How often each draw takes each of the CHUNK ranks from chunk * CHUNK on, of a stratum of n ranks (ranks x draws).

    A draw has n hits on the stratum. A node covers the 2^k ranks from `a` on; its hits fall to its halves by a binomial draw
    named after the stratum and the node, so all ranks together hold n hits: an exact multinomial draw without a table of hits.
    """
    return rank_hits(stratum, n, chunk, dict(chunk_hits(stratum, n, 0, draws, tag))[chunk], tag)


def sums(placed: DataFrame, draws: int, tag: str) -> DataFrame:
    """(_j, draw, _s, n) from a row for each id and key: _stratum, _at (rank from 0), _n (ids of the stratum), _j (key), _s and _c (sum and count of values).

    The hits of a stratum's chunks are found for BLOCK draws at a time, in a task each; they are joined to the chunks' ids, which deal them to ranks.
    """
    blocks = placed.select("_stratum", "_n").distinct().withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(BLOCK))))

    def descend(frames):
        for frame in frames:
            for stratum, n, first in frame.itertuples(index=False, name=None):
                many = min(BLOCK, draws - first)
                for got in batched(chunk_hits(stratum, int(n), first, many, tag), 1024):
                    yield pd.DataFrame({"_stratum": stratum, "_n": n, "_first": first, "_chunk": [c for c, _ in got], "_hits": [h for _, h in got]})

    def count(own: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        stratum, n, chunk = drawn["_stratum"].iloc[0], int(drawn["_n"].iloc[0]), int(drawn["_chunk"].iloc[0])
        ranks = rank_hits(stratum, n, chunk, np.concatenate(drawn.sort_values("_first")["_hits"].to_list()), tag)
        out = []
        for key, part in own.groupby("_j", sort=False):
            w = ranks[part["_at"].to_numpy() - chunk * CHUNK]
            out.append((key, part["_s"].to_numpy(float) @ w, part["_c"].to_numpy(np.int64) @ w))
        return pd.DataFrame(out, columns=["_j", "s", "c"])

    spread = blocks.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_stratum", "_first")  # their work is in counting, not in bytes
    chunks = spread.mapInPandas(descend, "_stratum string, _n long, _first int, _chunk long, _hits array<long>")
    ids = placed.withColumn("_chunk", F.floor(F.col("_at") / CHUNK).cast("long"))
    grouped = ids.groupBy("_stratum", "_chunk").cogroup(chunks.groupBy("_stratum", "_chunk")).applyInPandas(count, "_j string, s array<double>, c array<long>")
    each = grouped.select("_j", F.posexplode(F.arrays_zip("s", "c")).alias("draw", "x"))
    return each.groupBy("_j", "draw").agg(F.sum("x.s").alias("_s"), F.sum("x.c").alias("n"))
