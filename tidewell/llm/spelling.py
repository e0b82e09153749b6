"""Spelling variants: words of a corpus grouped by single edits, found by blocked Gram matrices of letter counts."""

from __future__ import annotations

import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bound_batches, materialize

LEAST_LENGTH, LEAST_COUNT, TIMES, DROP = 6, 5, 5, 199
#: Words of a block; counts a task holds before it hands them on; texts above so many bytes are read run by run.
BLOCK, HELD, LONG = 1024, 60_000, 1 << 20
#: A tile's coordinates end here, so there are 64 ** 3 tiles at most.
CLIP = 63

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # A-Z in lower case already; U+00C0 to U+00FF in UTF-8


def runs_of(doc_id, text: bytes) -> dict[bytes, int]:
    """Counts of the words of one text by the rule of word_counts, those of six bytes or more."""
    counts: dict[bytes, int] = {}
    lowered = text.lower()
    found = _RUN.findall(lowered) if len(lowered) <= LONG else (m[0] for m in _RUN.finditer(lowered))
    for run in found:
        if len(run) >= LEAST_LENGTH:
            counts[run] = counts.get(run, 0) + 1
    if doc_id is None:
        return counts
    start = zlib.crc32(f"{doc_id}:".encode())
    for run in [r for r in counts if zlib.crc32(r, start) % DROP == 0]:
        h, word = zlib.crc32(run, start), run.decode()
        at = h % len(word)
        n = counts.pop(run)
        short = (word[:at] + word[at + 1 :]).encode()
        # a word that another run became is counted under a name no run has until all are changed
        counts[b" " + short] = counts.get(b" " + short, 0) + n
    for key in [k for k in counts if k[:1] == b" "]:
        n = counts.pop(key)
        counts[key[1:]] = counts.get(key[1:], 0) + n
    return counts


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of least_length code points (6 or more) and least_count occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; where 199 divides the crc32 of `id:run`, the run
    loses one code point, as scanning errors do. Null texts have no words; in rows of a null id no code point is lost. Counts
    are summed within a task first and handed on after HELD words.
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        held: dict[bytes, int] = {}

        def out():
            words = [w for w in held if len(w) - w.count(b"\xc3") >= least_length]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in runs_of(doc_id, text or b"").items():
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    words = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of letters left-justified, right-justified, lengths); a-z are 1 to 26, U+00C0 to U+00FF 27 to 90, nothing 0."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    flat = np.where(flat >= 0xC0, flat - 0xC0 + 27, flat - 96)
    owner = np.repeat(np.arange(len(words)), size)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    width = int(size.max(initial=1))
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    left[owner, inner] = flat
    right[owner, inner + width - size[owner]] = flat
    return left, right, size


def counts_of(left: np.ndarray) -> np.ndarray:
    """Letter counts of each word, 90 columns."""
    out = np.zeros((len(left), 91), np.float32)
    rows = np.repeat(np.arange(len(left)), left.shape[1])
    np.add.at(out, (rows, left.ravel()), 1)
    return out[:, 1:]


def near_pairs(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in a and b of words that differ by exactly one inserted, deleted or replaced code point.

    The squared distance of letter counts comes from one product of the two blocks; an edit leaves 1 (lengths differ by one) or
    2 (equal lengths), and the few pairs at that distance are compared letter by letter.
    """
    both = letters(a + b)
    left, right, size = both
    x, y = counts_of(left[: len(a)]), counts_of(left[len(a) :])
    gram = x @ y.T
    squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * gram
    i, j = np.nonzero((squared > 0) & (squared <= 2))
    apart = np.abs(size[i] - size[j + len(a)])
    kept = apart <= 1
    i, j, apart = i[kept], j[kept], apart[kept]
    k = j + len(a)
    width = left.shape[1]
    ok = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        same = left[i[s]] == left[k[s]]
        short = np.minimum(size[i[s]], size[k[s]])
        replaced = (~same).sum(axis=1) == 1
        head = np.where(same.all(axis=1), width, same.argmin(axis=1))
        back = right[i[s]][:, ::-1] == right[k[s]][:, ::-1]
        tail = np.where(back.all(axis=1), width, back.argmin(axis=1))
        ok[s] = np.where(apart[s] == 0, replaced, np.minimum(head, short) + np.minimum(tail, short) >= short)
    return i[ok], j[ok]


def tile_of(word):
    """Counts of three classes of letters (code mod 3), clipped; their sum is the length."""
    code = lambda c: F.when(c < "À", F.ascii(c) - 96).otherwise(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xC0 + 27)
    classes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: code(c) % 3)
    return [F.least(F.size(F.filter(classes, lambda k: k == i)), F.lit(CLIP)).cast("long") for i in range(3)]


#: Steps to the tiles of words one edit away, one of each pair of opposite ones: none, a letter more of one class, one class for another.
STEPS = [s for s in product((-1, 0, 1), repeat=3) if (not any(s) or next(v for v in s if v) > 0) and sorted(s) in ([0, 0, 0], [0, 0, 1], [-1, 0, 1])]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best) of each word of vocabulary (word, n) that has near words; best is the one of largest n, first in code-point order on ties.

    Words go to tiles by their counts of three classes of letters, which one edit takes to the same or a neighbouring tile, and
    tiles are cut into blocks by a hash. Every pair of blocks of neighbouring tiles is compared in full by a Gram matrix; a
    task hands on a count and a best word for each word, not pairs.
    """
    keyed = materialize(vocabulary.select("word", "n", *[c.alias(f"c{i}") for i, c in enumerate(tile_of(F.col("word")))]).select("word", "n", (F.col("c0") * 4096 + F.col("c1") * 64 + F.col("c2")).alias("tile")))
    tiles = F.broadcast(materialize(keyed.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))))  # 64 ** 3 rows at most
    blocks = keyed.join(tiles, "tile").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks"))).groupBy("tile", "block").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    blocks = materialize(blocks)
    steps = F.explode(F.array(*[F.lit(a * 4096 + b * 64 + c).cast("long") for a, b, c in STEPS]))
    # a step can leave the cube of coordinates and reach a tile that is no neighbour: it is compared, nothing is near there
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = blocks.select("tile", "block", F.col("words").alias("a"), steps.alias("step")).withColumn("other", F.col("tile") + F.col("step"))
    left = left.join(tiles.withColumnRenamed("tile", "other"), "other").withColumn("other_block", each)
    right = blocks.select(F.col("tile").alias("other"), F.col("block").alias("other_block"), F.col("words").alias("b"), steps.alias("step")).withColumn("tile", F.col("other") - F.col("step"))
    right = right.join(tiles, "tile").withColumn("block", each)
    pairs = left.drop("blocks").join(right.drop("blocks"), ["tile", "step", "other", "block", "other_block"]).where((F.col("step") != 0) | (F.col("block") <= F.col("other_block")))
    pairs = pairs.select("a", "b", ((F.col("step") == 0) & (F.col("block") == F.col("other_block"))).alias("same"))
    schema = "word string, n_near long, best struct<less:long,word:string>"
    arrow = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("word", pa.string())]))])

    def compare(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(c)[row].values for c in (0, 1))
                names, counts = zip(*((x.field("word").to_pylist(), x.field("n").to_numpy()) for x in (a, b)), strict=True)
                i, j = near_pairs(*names)
                found: dict[str, list] = {}
                ways = [(0, 1, i, j)] + ([] if batch.column(2)[row].as_py() else [(1, 0, j, i)])
                for own, other, x, y in ways:
                    for p, q in zip(x.tolist(), y.tolist(), strict=True):
                        best = (-int(counts[other][q]), names[other][q])
                        got = found.setdefault(names[own][p], [0, best])
                        got[0] += 1
                        if best < got[1]:
                            got[1] = best
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([v[0] for v in found.values()]), pa.array([{"less": v[1][0], "word": v[1][1]} for v in found.values()], arrow.field("best").type)], schema=arrow)

    bound_batches(vocabulary.sparkSession)
    return pairs.mapInArrow(compare, schema).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last. A form's n is at least TIMES the word's, so no way has over 27 steps
    and five doublings reach its end."""
    state = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        going = state.join(ahead, "root", "left_semi")
        if going.isEmpty():
            break
        state = materialize(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return state


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of word_counts.

    form is the near word of largest n (ties: first in code-point order) where its n is at least `times` the word's, else null;
    root follows forms to the last, the word itself where there is none. Empty tables and tables of null texts give no rows; other
    columns of docs, whatever their names, are not read.
    """
    words = materialize(word_counts(docs, id_col, text_col))
    near = near_words(words)
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best_word"))
    large = F.col("best_n") >= times * F.col("n")
    named = materialize(named.select("word", F.when(large, F.col("best_word")).alias("form"), "n", "n_near", F.when(large, F.col("best_n")).alias("form_n")))
    roots = follow(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
