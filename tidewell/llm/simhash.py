"""SimHash near-duplicates: fingerprints, tiled exact comparison in numpy, components by star contraction."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows, materialize

SHINGLE, SEED, RADIUS = 3, 42, 3
#: A fingerprint's tile is the bit count of each of its PARTS equal parts; a tile's blocks hold about BLOCK fingerprints.
PARTS, BLOCK = 4, 1024
#: A task compares the pairs of two groups of blocks, of so many blocks each, however large a tile is.
GROUP = 64
#: Shingles hashed together.
STEP = 255 * 64


def fingerprint(text: str | None) -> int:
    """64 bits over word shingles, repeats included; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - SHINGLE + 1)
    stops = ends[-1:] if len(words) < SHINGLE else ends[SHINGLE - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    begins, stops = starts[:n].tolist(), stops.tolist()
    for at in range(0, n, STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + STEP], stops[at : at + STEP], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of bytes stay bytes
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return sum(1 << i for i in np.nonzero(2 * ones > n)[0].tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null and empty texts have 0; rows may repeat."""

    def make():
        def step(ids, texts):
            return ids, pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

        return step

    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, fp long")


def tile_key(fp):
    """The bit counts of the parts, five binary digits each: sums of offsets never reach another part's valid count."""
    width = 64 // PARTS
    return sum((F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))).cast("long") * 32**i for i in range(PARTS)), F.lit(0).cast("long"))


def near_tiles(radius: int = RADIUS) -> list[int]:
    """Offsets to tiles whose counts differ by radius in all at most, one of each pair of opposite ones."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    half = [d for d in steps if not any(d) or next(x for x in d if x) > 0]
    return [sum(x * 32**i for i, x in enumerate(d)) for d in half]


def _spanning(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within the block pair, at most one for each fingerprint."""
    hits_a, hits_b = [], []
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        differ = a[i + at] != b[j]
        hits_a.append(i[differ] + at)
        hits_b.append(j[differ])
    i, j = np.concatenate(hits_a), np.concatenate(hits_b)
    if not len(i):
        return a[:0], a[:0]
    nodes, at = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) edges between the distinct fingerprints of fps (column fp) that leave the components of all links within radius.

    Each fingerprint goes to a tile by the bit counts of its parts. Two fingerprints within radius
    differ by radius at most in the sum over parts of the differences of those counts, so other tile
    pairs are skipped and none is lost. Tiles are cut into blocks by a hash and blocks into groups, so no
    task holds a whole tile or all pairs of one: the pairs of a tile are dealt by (tile, its group, group of
    the near tile), and every pair of blocks of near tiles is compared in full by exclusive-or and bit count.
    """
    keyed = fps.select("fp", tile_key(F.col("fp")).alias("tile"))
    counts = materialize(keyed.groupBy("tile").agg(F.count("*").alias("n")))  # (64 / PARTS + 1) ** PARTS = 83,521 rows at most, so it is broadcast
    blocks = (
        keyed.join(F.broadcast(counts), "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK)).alias("block"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = materialize(blocks.withColumn("group", F.floor(F.col("block") / GROUP)))
    steps = F.explode(F.array(*[F.lit(x).cast("long") for x in near_tiles(radius)]))
    groups = counts.select("tile", F.ceil(F.ceil(F.col("n") / BLOCK) / GROUP).alias("groups"))
    near = groups.select("groups", "tile", steps.alias("step")).groupBy((F.col("tile") + F.col("step")).alias("other")).agg(F.max("groups").alias("met"))
    there = F.broadcast(materialize(groups.withColumnRenamed("tile", "other").join(near, "other")))  # a row for each tile
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = blocks.select("tile", "block", F.col("group").alias("own_group"), F.col("fps").alias("a"), steps.alias("step")).withColumn("other", F.col("tile") + F.col("step"))
    left = left.join(there.drop("met"), "other").withColumn("group", each("groups"))
    right = blocks.select(F.col("tile").alias("other"), F.col("block").alias("other_block"), "group", F.col("fps").alias("b"))
    right = right.join(there.drop("groups"), "other").withColumn("own_group", each("met"))
    pairs = left.join(right, ["other", "group", "own_group"]).where((F.col("step") != 0) | (F.col("block") <= F.col("other_block"))).select("a", "b")

    def compare(batches):
        for batch in batches:
            xs, ys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            a, b = batch.column(0), batch.column(1)
            va, vb = (c.values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (a, b))
            oa, ob = (c.offsets.to_numpy().tolist() for c in (a, b))
            for k in range(batch.num_rows):
                x, y = _spanning(va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]], radius)
                xs.append(x)
                ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs).view(np.int64)), pa.array(np.concatenate(ys).view(np.int64))], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the same node for a whole component.

    Alternates large and small stars until nothing changes, about log rounds; each round is a table
    in the shared folder, so a lost executor costs no earlier round.
    """
    flip = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    state = materialize(flip(edges))
    before = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(flip(large))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        state = materialize(flip(small))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct, a row for each fp, with the root of its component."""
    roots = components(links(distinct, radius))
    return materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs.

    component_id is the least doc_id of all rows reachable over links of radius bits or fewer,
    copies included; rows of a null doc_id link like others but give no id, and a component of
    such rows alone has a null one. Null and empty texts share fingerprint zero.
    """
    own = materialize(fingerprints(docs))
    linked = _rooted(materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))), radius)
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = linked.join(least, "root").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of its least doc_id, and of several such rows the one of the least digest.

    The digest is SHA-256 of the row as JSON, so rows of one digest are alike in every column and one of
    them stays. Columns may have any names. A null doc_id comes after all others: such rows stay only where no other is near.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]  # by place, so that no column of docs is taken for another
    rows = docs.toDF(*names)
    at, key = (F.col(names[docs.columns.index(c)]) for c in ("text", "doc_id"))
    digest = F.sha2(F.to_json(F.struct(*names)), 256)
    own = materialize(fingerprints(rows.select(F.struct(key.alias("doc_id"), digest.alias("digest")).alias("at"), at.alias("text")), "at"))
    order = F.struct(F.col("at.doc_id").isNull().alias("last"), F.col("at.doc_id").alias("doc_id"), F.col("at.digest").alias("digest"))
    linked = _rooted(materialize(own.groupBy("fp").agg(F.min(order).alias("first"))), radius)
    kept = linked.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.digest").alias("_row_digest"))
    return rows.withColumn("_row_digest", digest).join(kept, "_row_digest", "left_semi").dropDuplicates(["_row_digest"]).select(*names).toDF(*docs.columns)
