"""MinHash near-duplicates by SetSketch registers: banded registers propose, a joint likelihood sifts, full sets verify."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bound_batches, map_rows, materialize
from tidewell.llm.simhash import components

SHINGLE, SEED = 5, 42
#: A link has 100 * intersection >= 85 * union.
NUMERATOR, DENOMINATOR = 85, 100
#: 64 bands of 8 registers: a pair at 0.85 shares no band once in 1e9 times (1 - 0.85 ** 8) ** 64.
BANDS, ROWS = 64, 8
REGISTERS = BANDS * ROWS
#: Registers are floor(1 - log_BASE(h)) of exponential hashes of rate RATE, kept within 0 and LAST.
BASE, RATE, LAST = 1.001, 20.0, (1 << 16) - 1
#: Buckets of so many sets at most give their pairs to the likelihood; larger ones are taken as candidates as a whole.
FEW = 8
#: Sets of a block hold about so many bytes.
BLOCK_BYTES = 1 << 20

_draws = np.random.default_rng(20_110)
_MULTIPLY = _draws.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_FLIP = _draws.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as rising 64-bit hashes: `size` words each, the whole sequence if there are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - size + 1)
    stops = ends[-1:] if len(words) < size else ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), np.uint64, n))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value over a set of each register's own 32-bit permutation."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 64):
        np.minimum(out, ((h[at : at + 64, None] ^ _FLIP) * _MULTIPLY).min(axis=0), out=out)
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch of a set: the minimum of uniform draws is that of the exponential ones, as their order is the same. No elements: zeros."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    u = (minima(hashes).astype(float) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, LAST).astype(np.uint16)


def merged(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union: the largest value of each register."""
    return np.maximum.reduce(sketches)


def bands(sketch: np.ndarray) -> list[int]:
    """A key for each band: a hash of its place and register values."""
    raw = sketch.astype("<u2").tobytes()
    return [xxhash.xxh64_intdigest(raw[i * ROWS * 2 : (i + 1) * ROWS * 2], i) - (1 << 63) for i in range(BANDS)]


def likelihood_keeps(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, bound: float = NUMERATOR / DENOMINATOR, deviance: float = 40.0) -> np.ndarray:
    """Which pairs of sketches (rows of a and b, of sets of na and nb elements) a similarity of `bound` can't be ruled out for.

    The registers of a pair are larger in a, larger in b or equal with probabilities that depend on both sizes, which
    are known, and on the similarity alone; its likelihood is laid over a grid. A pair goes where the best similarity is below the
    bound and twice the log-likelihood it gains over the bound exceeds `deviance`: a link so lost is a normal deviation above 6.
    """
    above, under = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - under
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        """Log-likelihood for similarities j (pairs x values)."""
        up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
        rest = np.maximum(1 - up - down, 1e-12)
        return above[:, None] * np.log(np.maximum(up, 1e-12)) + under[:, None] * np.log(np.maximum(down, 1e-12)) + equal[:, None] * np.log(rest)

    every = fit(grid * most[:, None])
    best = np.take_along_axis(grid * most[:, None], every.argmax(axis=1)[:, None], axis=1)[:, 0]
    at = fit(np.minimum(bound, most)[:, None])[:, 0]
    possible = most * DENOMINATOR >= NUMERATOR * (1 - 1e-9)
    return possible & ((best >= bound) | (2 * (every.max(axis=1) - at) <= deviance))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, set_key, sketch) of each row: set_key is a digest of the whole set, null for an empty one, text_key Spark's hash of the text."""

    def make():
        def step(ids, keys, texts):
            sets = [shingle_set(t) for t in texts]
            return ids, keys, [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], [registers(s).astype("<u2").tobytes() if len(s) else None for s in sets]

        return step

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), make, f"doc_id {kind}, text_key long, n long, set_key binary, sketch binary")


def candidates(sets: DataFrame) -> DataFrame:
    """Edges (a, b) over set keys whose components hold every pair that shares a band and passes the likelihood.

    sets: (set_key, n, sketch), a row for each set. A bucket is what shares a band. Those of FEW sets or fewer give
    pairs, at most (FEW - 1) / 2 for each place in a bucket, and these go through the likelihood; in larger ones every set gets an
    edge to the first one, so edges grow with the sets and not with pairs, and the exact comparison of the component decides.
    """

    def make():
        def step(keys, raw):
            return keys, [bands(np.frombuffer(r, "<u2")) for r in raw]

        return step

    placed = map_rows(sets.select("set_key", "sketch"), make, "set_key binary, bands array<long>").select("set_key", F.explode("bands").alias("band"))
    sizes = placed.groupBy("band").agg(F.count("*").alias("size"), F.min("set_key").alias("first")).where("size > 1")
    buckets = materialize(placed.join(sizes, "band"))
    few = buckets.where(F.col("size") <= FEW).groupBy("band").agg(F.sort_array(F.collect_set("set_key")).alias("keys")).select("keys").distinct()
    pairs = few.select(F.posexplode("keys").alias("at", "a"), "keys").select("a", F.explode(F.expr("slice(keys, at + 2, size(keys))")).alias("b")).distinct()
    side = lambda c: sets.select(F.col("set_key").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    told = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * DENOMINATOR >= F.greatest("n_a", "n_b") * NUMERATOR)
    bound_batches(sets.sparkSession)

    def sift(batches):
        for b in batches:
            if b.num_rows:
                one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in (4, 5))
                kept = likelihood_keeps(one, two, b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(kept)) for c in (0, 1)], names=["a", "b"])

    sifted = told.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(sift, "a binary, b binary")
    whole = buckets.where((F.col("size") > FEW) & (F.col("set_key") != F.col("first"))).select(F.col("set_key").alias("a"), F.col("first").alias("b")).distinct()
    return sifted.unionByName(whole)


def spanning(a: list[np.ndarray], b: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked among the sets of a and b (or within a), at most one for each set.

    Intersections are the product of two 0/1 matrices over the shingles that at least two sets hold, some columns at a time; sizes
    give the unions.
    """
    every = a if b is None else a + b
    cut, n = len(a), np.array([len(s) for s in every])
    flat, owner = np.concatenate(every), np.repeat(np.arange(len(every)), n)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    held = shared[column]
    column, owner = place[column[held]], owner[held]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    rows, cols = slice(0, cut), slice(0, cut) if b is None else slice(cut, len(every))
    common = np.zeros((cut, cut if b is None else len(b)), np.float64)
    width = max(256, (1 << 22) // len(every))
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        ones = np.zeros((len(every), width), np.float32)
        ones[owner[lo:hi], column[lo:hi] - at] = 1
        common += ones[rows] @ ones[cols].T
    union = n[rows, None] + n[cols] - common
    i, j = np.nonzero(common * DENOMINATOR >= union * NUMERATOR)
    j = j + (0 if b is None else cut)
    i, j = i[i < j], j[i < j]
    label = np.arange(len(every))
    while len(i):
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(every)))
    return moved, label[moved]


def verified(grouped: DataFrame) -> DataFrame:
    """Edges (a, b) that leave the components of all links within each group of grouped (group, key, elements, set_key).

    A group is cut into blocks of about BLOCK_BYTES by a hash; each pair of its blocks is compared in full by a task of its own.
    """
    sizes = grouped.groupBy("group").agg(F.ceil(F.sum(F.length("elements")) / BLOCK_BYTES).alias("blocks"))
    blocks = grouped.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks"))).groupBy("group", "block", "blocks").agg(F.collect_list(F.struct("set_key", "elements")).alias("sets"))
    blocks = materialize(blocks)
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def members(column, row):
        own = column[row].values
        return own.field("set_key").to_pylist(), [np.frombuffer(e, "<u8") for e in own.field("elements").to_pylist()]

    def run(two: bool):
        def compare(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    keys, a = members(batch.column(0), row)
                    more, b = members(batch.column(1), row) if two else ([], None)
                    keys += more
                    x, y = spanning(a, b)
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in at.tolist()], pa.binary()) for at in (x, y)], schema=arrow)

        return compare

    bound_batches(grouped.sparkSession)
    within = blocks.where(F.size("sets") > 1).select("sets").mapInArrow(run(False), "a binary, b binary")
    several = blocks.where("blocks > 1")
    left = several.select("group", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), F.col("sets").alias("a")).where("block < other")
    right = several.select("group", F.col("block").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("sets").alias("b")).where("block < other")
    across = left.join(right, ["group", "block", "other"]).select("a", "b").mapInArrow(run(True), "a binary, b binary")
    return within.unionByName(across)


def elements(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(set_key, elements) of keys (set_key, text_key): the shingle hashes as bytes, read again from a text of that hash."""
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(keys.select("text_key"), "text_key", "left_semi").groupBy("text_key", F.sha2("text", 256)).agg(F.first("text").alias("text"))

    def make():
        def step(texts):
            sets = [shingle_set(t) for t in texts]
            return [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.astype("<u8").tobytes() for s in sets]

        return step

    return map_rows(texts.select("text"), make, "set_key binary, elements binary").join(keys.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs.

    Rows whose sets of 5-word shingles have 100 * intersection >= 85 * union are linked; component_id is the least doc_id reachable.
    Rows of one set are one class from the start, so groups of copies are summed up before any comparison. A set without
    shingles (null, empty and blank texts) is linked with nothing: its row has its own doc_id. Rows of a null doc_id link like others but
    give no id; a component of such rows alone has a null one. kept is whether the row's doc_id is the component's, two nulls
    being the same; repeated rows are all kept or none. Other columns of docs are not read.
    """
    docs = docs.select("doc_id", "text")
    own = materialize(sketches(docs))
    sets = materialize(own.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    groups = materialize(components(candidates(sets)).select(F.col("node").alias("set_key"), F.col("root").alias("group")).distinct())
    keys = materialize(groups.join(sets.select("set_key", "text_key"), "set_key"))
    grouped = materialize(elements(docs, keys).join(groups, "set_key"))
    roots = components(verified(grouped)).select(F.col("node").alias("set_key"), "root").distinct()
    named = materialize(sets.select("set_key", "first_id").join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = named.join(least, "root").select("set_key", "component_id")
    joined = own.join(of, "set_key", "left").withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
