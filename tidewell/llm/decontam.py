"""Benchmark passages in documents, found by streaming words through a generalised suffix automaton."""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows, materialize

WINDOW = 13
#: An automaton holds test items of about so many characters; more items make more automata, which read the texts one after the other.
SHARD_CHARS = 2_000_000
#: Longer items are cut into parts of so many words, which overlap so that each window lies in one of them.
PART_WORDS = 10_000

#: A-Z become lower case, all ASCII but letters and digits a space; bytes from 0x80 on are parts of words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """text without the words of the ranges (start, end exclusive; in order), from a range's first character to its last.

    Words begin and end beside ASCII, so cuts of bytes never split a character.
    """
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))]
    out, done = [], 0
    for s, e in ranges:
        out.append(raw[done : at[s][0]])
        done = at[e - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


class Automaton:
    """Generalised suffix automaton of items' words.

    length, link and next are the usual arrays of its states. For each state, trigger is the least
    matched length at which a window ends there; short lists the short items that end there or at a
    suffix, as (length, item); long is the set of items with the state's 13-word suffix.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: dict[int, set[int]] = {}
        short: dict[int, set[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, tokens) in enumerate(items):
            last = 0
            for t in tokens:
                last = self._extend(last, self.vocab.setdefault(t, len(self.vocab)))
                ends.setdefault(last, set()).add(k)
            if 0 < len(tokens) < window:
                short.setdefault(last, set()).add(k)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(by_length):
            if (p := self.link[v]) > 0 and self.length[p] >= window and v in ends:
                ends.setdefault(p, set()).update(ends[v])
        size = len(self.length)
        self.trigger, self.short, self.long = [math.inf] * size, [()] * size, [()] * size
        for v in by_length:
            p = self.link[v]
            own = [(self.length[v], k) for k in sorted(short.get(v, ()))]
            self.short[v] = (*(self.short[p] if p > 0 else ()), *own)
            self.trigger[v] = min([self.trigger[p] if p > 0 else math.inf, *(m for m, _ in own)])
            if self.length[v] >= window:
                self.trigger[v] = min(self.trigger[v], window)
                self.long[v] = self.long[p] if p > 0 and self.length[p] >= window else tuple(sorted(ends[v]))

    def _extend(self, last: int, c: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        if (q := nxt[last].get(c)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._state(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, n: int) -> int:
        self.length.append(n)
        self.link.append(0)
        self.next.append({})
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1)
        self.next[new] = dict(self.next[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges (start, end exclusive), merged and in order, and the ids of the items with occurring windows."""
        length, link, nxt, trigger, window = self.length, self.link, self.next, self.trigger, self.window
        spans: list[tuple[int, int]] = []
        seen, found = set(), set()
        v = n = 0
        for i, c in enumerate(map(self.vocab.get, tokens)):
            if c is None:
                v = n = 0
                continue
            go = nxt[v]
            while c not in go and v:
                v = link[v]
                n = length[v]
                go = nxt[v]
            if c in go:
                v = go[c]
                n += 1
            else:
                n = 0
                continue
            if n >= trigger[v]:
                cover = window if n >= window else 0
                if cover and v not in seen:
                    seen.add(v)
                    found.update(self.long[v])
                for m, k in self.short[v]:
                    if m <= n:
                        found.add(k)
                        cover = max(cover, m)
                start = i + 1 - cover
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, {self.items[k] for k in found}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def automata(benchmark: DataFrame, window: int, shard_chars: int, part_words: int = PART_WORDS) -> tuple[DataFrame, int]:
    """A written table of (shard, automaton), and the number of shards, each of about shard_chars characters of the benchmark.

    Items are cut into parts, dealt by a hash of item and part, and each shard's automaton is built in a task.
    """
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    shards = max(1, math.ceil((bench.agg(F.sum(F.length("text"))).first()[0] or 0) / shard_chars))

    def make():
        def step(ids, texts):
            cut = [(i, n, w[a : a + part_words]) for i, w in zip(ids, map(words, texts), strict=True) for n, a in enumerate(range(0, max(1, len(w) - window + 1), part_words - window + 1)) if w]
            return [i for i, _, _ in cut], [n for _, n, _ in cut], [b" ".join(w) for _, _, w in cut]

        return step

    def build(groups: pa.Table) -> pa.Table:
        rows = sorted(zip(*(groups.column(c).to_pylist() for c in ("item_id", "part", "tokens")), strict=True))
        auto = Automaton([(i, t.split()) for i, _, t in rows], window)
        return pa.table({"shard": groups.column("shard").slice(0, 1), "automaton": pa.array([pickle.dumps(auto)], pa.binary())})

    parts = map_rows(bench, make, "item_id string, part long, tokens binary").withColumn("shard", F.pmod(F.xxhash64("item_id", "part"), F.lit(shards)))
    return materialize(parts.groupBy("shard").applyInArrow(build, "shard long, automaton binary")), shards


def scans(df: DataFrame, autos: tuple[DataFrame, int], text_col: str, then: tuple[Callable, str] | None = None) -> DataFrame:
    """df with n_words, spans (hit word ranges) and items (ids as strings, sorted) of its texts.

    then: make and schema of a map_rows over these columns. With one automaton it runs in the scan's own worker, since
    Spark holds a worker for each map of a stage and keeps them all.

    The driver sends one automaton at a time, so neither it nor a worker ever holds two. One automaton is met in place.
    For several, df is written once with numbers of its rows; each automaton then reads the texts alone and leaves
    (number, spans, items) of the rows it hits, the first one every row's count of words, and these are joined to the rows.
    """
    table, shards = autos
    spark, found = df.sparkSession, "n_words long, spans array<struct<start:long,end:long>>, items array<string>"

    def send(k: int):
        row = table.where(F.col("shard") == k).first()
        return spark.sparkContext.broadcast(pickle.loads(row.automaton) if row else Automaton([]))

    def scan(auto: Automaton, texts) -> list[tuple]:
        return [(len(tokens), [{"start": s, "end": e} for s, e in spans], sorted(ids)) for tokens in map(words, texts) for spans, ids in [auto.scan(tokens)]]

    if shards == 1:
        held, at = send(0), df.columns.index(text_col)

        def beside():
            auto, more = held.value, then[0]() if then else lambda *cols: cols

            def step(*cols):
                got = scan(auto, cols[at])
                return more(*cols, *([g[i] for g in got] for i in range(3)))

            return step

        return map_rows(df, beside, then[1] if then else ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), found]))

    kept = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    parts = []
    for k in range(shards):
        held = send(k)

        def hits(held=held, every=k == 0):
            auto = held.value

            def step(rows, texts):
                got = [(r, *g) for r, g in zip(rows, scan(auto, texts), strict=True) if every or g[1]]
                return [[g[i] for g in got] for i in range(4)]

            return step

        parts.append(materialize(map_rows(kept.select("_row", text_col), hits, f"_row long, {found}")))
        held.destroy()

    def joined():
        def step(rows, n, spans, items):
            return rows, n, [[{"start": s, "end": e} for s, e in merge([(x["start"], x["end"]) for x in own])] for own in spans], [sorted(set(ids)) for ids in items]

        return step

    both = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    whole = kept.join(map_rows(both, joined, f"_row long, {found}"), "_row").drop("_row")
    return map_rows(whole, *then) if then else whole


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, spans (hit word ranges), items (ids as strings, sorted).

    Null and empty texts have no words and no hits; ids may repeat or be null. Benchmark rows of a null id or text
    are left out; rows of one item_id count as one item. Test items of up to shard_chars characters form one
    automaton; for larger benchmarks the rows are written once and read by one automaton after the other.
    """
    return scans(docs.select("doc_id", "text"), automata(benchmark, window, shard_chars), "text").drop("text")


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: int = 20) -> DataFrame:
    """Per document: words, hit words, items met, and whether hit words make up 1 in `coverage` or more."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (
        match_benchmark(docs, benchmark)
        .select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.size("spans").cast("long").alias("n_spans"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: int = 20, window: int = WINDOW) -> DataFrame:
    """docs without the rows whose hit words reach 1 in `coverage`; all other rows stay as they are."""
    return remove_contamination(docs, benchmark, coverage, None, window)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, coverage: int = 20, limit: int | None = WINDOW, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """docs without the rows whose hit words reach 1 in `coverage`, and without the spans of more than `limit` words in the texts of others.

    Where a cut brings words together that make a new span, that is cut too, or the row dropped if it then reaches the
    coverage; n_chars follows. A limit of None cuts nothing. Rows of null and empty texts stay. The test runs beside the
    row, on Arrow batches, so texts aren't shuffled; rows whose text was cut are written and scanned again until none is.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    autos = automata(benchmark, window, shard_chars)

    def make():
        def clean(text, n_words, spans):
            """(whether the row stays, its text)"""
            n = sum(s["end"] - s["start"] for s in spans)
            if n > 0 and coverage * n >= n_words:
                return False, None
            long = [(s["start"], s["end"]) for s in spans if limit is not None and s["end"] - s["start"] > limit]
            return True, cut_words(text, long) if long else text

        def step(*cols):
            *cols, n_words, spans, _ = cols
            got = [clean(*x) for x in zip(cols[at], n_words, spans, strict=True)]
            again = [new != old for old, (_, new) in zip(cols[at], got, strict=True)]
            if size is not None:
                cols[size] = [len(new) if keep and more else c for c, more, (keep, new) in zip(cols[size], again, got, strict=True)]
            cols[at] = [x for _, x in got]
            return [[x for x, (k, _) in zip(c, got, strict=True) if k] for c in [*cols, again]]

        return step

    schema = ", ".join([*(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True)), "_again boolean"])
    todo, done = docs.toDF(*names), None
    while True:
        got = materialize(scans(todo, autos, names[at], (make, schema)))
        rest = got.where("NOT _again").select(*names)
        done = rest if done is None else done.unionByName(rest)
        todo = got.where("_again").select(*names)
        if todo.isEmpty():
            return done.toDF(*docs.columns)
