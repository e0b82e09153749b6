"""Whitening, SetSketch near-duplicates and spelling variants against brute force, on small tables with awkward rows."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import SF  # noqa: E402

from tidewell.llm import queries as q  # noqa: E402
from tidewell.llm import setsketch, spelling, whitening  # noqa: E402
from tidewell.llm.common import table  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, whitened string, n string, _v int"


# whitening


def whitened_brute(rows, components=8):
    kept = [(i, v) for i, v in rows if v is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for _, v in kept]
    n, size = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(size)]
    exact = [[n * r[k] - sums[k] for k in range(size)] for r in x]
    away = np.array(exact, float) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [i for i, _ in kept], n, [sum(c * c for c in r) for r in exact], away @ vectors / np.sqrt(values), values / np.trace(away.T @ away / n)


def assert_whitened(df, rows):
    ids, n, deviation, y, share = whitened_brute(rows)
    got = sorted(df.collect(), key=lambda r: (r.component, str(r.vec_id), r.whitened))
    assert len(got) == len(ids) * len(share)
    for k in range(len(share)):
        own = [r for r in got if r.component == k + 1]
        assert Counter((r.vec_id, r.deviation) for r in own) == Counter(zip(ids, deviation, strict=True))
        assert all(r.n == n and abs(r.explained / share[k] - 1) < 1e-9 and r.identity_error < 1e-9 for r in own)
        either = [np.allclose(sorted((str(r.vec_id), r.whitened) for r in own) and [w for _, w in sorted((str(r.vec_id), r.whitened) for r in own)], [w for _, w in sorted(zip(map(str, ids), s * y[:, k], strict=True))], atol=1e-9) for s in (1, -1)]
        assert any(either)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    assert_whitened(q.op11_whitening(spark, SF), rows)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whitening_of_awkward_rows(spark, parts):
    """Null and broken vectors, null and repeated ids, copies, columns named like the output, and as many tasks as take two rounds to combine."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=10).tolist(), "x", "y", 1) for i in range(300)]
    rows += [(5, [0.25] * 10, "x", "y", 1)] * 60 + [(None, rng.normal(size=10).tolist(), None, None, None), (7, None, "x", "y", 1), (8, [None] + [0.1] * 9, "x", "y", 1), (9, [float("nan")] + [0.1] * 9, "x", "y", 1), (10, [float("inf")] * 10, "x", "y", 1)]
    df = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(parts))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert_whitened(df, [(r[0], r[1]) for r in rows])


def test_whitening_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], "", "", 1)] * 3, VECTORS)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in one)
    line = whitening.whiten(spark.createDataFrame([(i, [i / 8, i / 4, 1.0], "", "", 1) for i in range(9)], VECTORS)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    for rows in ([], [(1, None, "", "", 1)], [(1, [], "", "", 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_whitening_pads_short_and_clips_huge(spark):
    rows = [(1, [0.5], "", "", 1), (2, [0.5, 0.0], "", "", 1), (3, [1e30, 0.25], "", "", 1)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).where("component = 1").collect()}
    assert got[1] == got[2] is None or got[1] == got[2]
    assert got[3] is None  # above a long


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    for size, n in ((1, 5), (4, 3), (9, 200), (24, 60)):
        x = np.floor(rng.normal(size=(n, size)) * rng.uniform(1, 1e4, size)).astype(np.int64)
        x[: n // 3] = x[0]
        x[:, -1] = 3  # a dimension that doesn't vary
        parts = [whitening.Spectrum(size) for _ in range(3)]
        parts[0].add(x[0::3])  # at once
        for k in (1, 2):
            for row in x[k::3]:
                parts[k].add(row[None])
        total = whitening.Spectrum(size)
        for own in parts:
            total.join(own)
        c = x - x.mean(axis=0)
        scale = np.abs(c.T @ c).max()
        assert total.n == n and total.sums == x.sum(axis=0).tolist()
        assert np.abs((total.vectors * total.lam) @ total.vectors.T - c.T @ c).max() <= 1e-11 * scale
        assert np.abs(total.vectors.T @ total.vectors - np.eye(size)).max() < 1e-11


def test_secular_equation():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 12)
        lam, z, rho = np.sort(rng.uniform(0, 10.0 ** rng.integers(-6, 6), n)), rng.normal(size=n) * 10.0 ** rng.integers(-3, 3), rng.uniform(0.1, 4)
        if (np.diff(lam) <= 1e-9 * lam[-1]).any():
            continue
        values, gaps = whitening.secular(lam, z, rho)
        assert np.allclose(values, np.linalg.eigvalsh(np.diag(lam) + rho * np.outer(z, z)), rtol=1e-10, atol=1e-12 * max(lam[-1], rho * z @ z))
        assert np.allclose(gaps, lam[:, None] - values, atol=1e-9 * max(lam[-1], rho * z @ z))


# SetSketch


def sets_of(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def duplicates_brute(rows):
    own = sets_of(rows)
    label = list(range(len(own)))
    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and label[a] != label[b] and 100 * len(x & y) >= 85 * len(x | y):
                low, high = sorted((label[a], label[b]))
                label = [low if v == high else v for v in label]
    least = {}
    for (i, s), v in zip(own, label, strict=True):
        if i is not None:
            least[v] = min(i, least.get(v, i))
    found = [(i, len(s), least.get(v) if s else i) for (i, s), v in zip(own, label, strict=True)]
    return Counter((i, n, c, i == c) for i, n, c in found)


def edited(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def near_docs():
    """A large group of near copies at many distances, small groups, copies, repeated and null ids, short, blank and long texts."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(300)}" for _ in range(130)]
    rows = [(1000 + k, edited(base, rng.choice((0, 1, 1, 2, 2, 3, 4)), rng)) for k in range(150)]
    for k in range(25):
        own = [f"c{rng.randrange(2000)}" for _ in range(rng.randrange(5, 200))]
        rows += [(10 * k + j, edited(own, rng.randrange(0, 3), rng)) for j in range(rng.randrange(1, 5))]
    rows += [(5000 + k, " ".join(base).upper()) for k in range(40)]
    rows += [(3, "a b c"), (4, "A b\tc"), (4, "a b c d"), (6, None), (7, ""), (8, " \n "), (None, "a b c"), (None, "only null ids here at all"), (None, "only null  ids here at all"), (9, "ÄB c d e f"), (9, "äB c d e f")]
    long = [f"l{rng.randrange(10**6)}" for _ in range(60_000)]
    return rows + [(2, " ".join(long)), (900, edited(long, 300, rng)), (901, edited(long, 3000, rng))]


DOCS = "doc_id long, text string, component_id string, set_key int"


@pytest.mark.parametrize("few, block", [(8, 1 << 20), (2, 20_000), (10**6, 1 << 20)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, few, block):
    """Whatever counts as a large bucket and however groups are cut into blocks."""
    monkeypatch.setattr(setsketch, "FEW", few)
    monkeypatch.setattr(setsketch, "BLOCK_BYTES", block)
    rows = near_docs()
    df = setsketch.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS))
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = Counter(map(tuple, df.collect()))
    assert got == duplicates_brute(rows)


def test_near_duplicates_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert Counter(map(tuple, q.op12_setsketch(spark, SF).collect())) == duplicates_brute(rows)


def test_near_duplicates_of_nothing(spark):
    assert setsketch.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    got = setsketch.near_duplicates(spark.createDataFrame([(1, None, "", 1), (1, "", "", 1)], DOCS)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True)] * 2


def random_sets(n, m, common, rng):
    draw = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    both = draw(common)
    return np.unique(np.r_[both, draw(n - common)]), np.unique(np.r_[both, draw(m - common)])


def test_sketches_merge_and_agree_with_similarity():
    rng = np.random.default_rng(7)
    a, b = random_sets(400, 300, 200, rng)
    union = setsketch.registers(np.union1d(a, b))
    assert (setsketch.merged(setsketch.registers(a), setsketch.registers(b)) == union).all()
    same = [(setsketch.registers(x) == setsketch.registers(y)).mean() for x, y in (random_sets(300, 300, 200, rng) for _ in range(60))]
    assert abs(np.mean(same) - 0.5) < 0.02


def test_likelihood_keeps_links_and_drops_far_pairs():
    rng = np.random.default_rng(8)
    for n, m, common, kept in ((200, 200, 184, True), (230, 200, 198, True), (200, 200, 100, False), (200, 100, 100, False), (20, 20, 19, True)):
        pairs = [random_sets(n, m, common, rng) for _ in range(100)]
        one, two = (np.array([setsketch.registers(p[k]) for p in pairs]) for k in (0, 1))
        got = setsketch.likelihood_keeps(one, two, np.full(100, float(n)), np.full(100, float(m)))
        assert got.all() if kept else not got.any()


def test_shared_bands_of_links():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = (setsketch.bands(setsketch.registers(s)) for s in random_sets(185, 185, 170, rng))  # 170 / 200
        assert set(a) & set(b)


# spelling


def spelling_brute(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = [n, len(close)]
    rows = set()
    for w, (n, count) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, count, words.get(form[w])))
    return rows


SPELLED = "doc_id long, text string, word string, n int"


def test_spelling_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in q.op13_spelling(spark, SF).collect()} == spelling_brute(rows)


@pytest.mark.parametrize("block, held", [(1024, 60_000), (3, 5)])
def test_spelling_of_awkward_rows(spark, monkeypatch, block, held):
    """Ties, chains, anagrams, letters beyond ASCII, words of one tile and of the cube's edge, small blocks and tasks that hand on often."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HELD", held)
    chain = ["abcdefg"] * 5 + ["abcdefgh"] * 30 + ["abcdefghi"] * 160 + ["abcdefghij"] * 900
    ties = ["kanten"] * 5 + ["kanter"] * 25 + ["kantes"] * 25 + ["Äkanten"] * 6 + ["ßkanten"] * 7 + ["Ökanten×"] * 6 + ["Ökanten÷"] * 6
    anagrams = ["listen", "silent", "enlist", "listens", "lisetn"] * 6
    long = ["x" * 70] * 9 + ["x" * 71] * 50 + ["x" * 69 + "y"] * 8 + ["y" * 70] * 6
    rng = random.Random(4)
    mixed = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))) for _ in range(1500)]
    words = chain + ties + anagrams + long + mixed
    rows = [(i, " ".join(words[i::9]), "x", 1) for i in range(9)]
    rows += [(None, "abcdef, abcdef abcdef-abcdef ABCDEF", "x", 1), (3, None, "x", 1), (3, "", "x", 1), (3, rows[3][1], "x", 1), (4, "Ünïcode1Ünïcode " * 5 + "日本語テキスト", "x", 1)]
    df = spelling.spelling_groups(spark.createDataFrame(rows, SPELLED).repartition(3))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = df.collect()
    assert {tuple(r) for r in got} == spelling_brute([r[:2] for r in rows]) and len(got) == len({r.word for r in got})


def test_spelling_of_long_texts_and_lost_letters(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 1000)
    words = [f"{'qwertz'[: 1 + k % 6]}{'asdfgh'[k % 5 :]}{'yxcvbn'[: k % 7]}" for k in range(400)]
    rows = [(k, " ".join(words * 30), "x", 1) for k in range(12)]
    got = {tuple(r) for r in spelling.spelling_groups(spark.createDataFrame(rows, SPELLED)).collect()}
    want = spelling_brute([r[:2] for r in rows])
    assert got == want and any(r[1] for r in want)


def test_spelling_of_nothing(spark):
    for rows in ([], [(1, None, "", 1)], [(1, "short words only", "", 1)]):
        assert spelling.spelling_groups(spark.createDataFrame(rows, SPELLED)).collect() == []


def test_steps_reach_every_neighbour(spark):
    """Tiles of words one edit apart differ by a step or its opposite."""
    rng = random.Random(6)
    letters = "abcxyzàÿ÷×Ü"
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        k, c = rng.randrange(len(a)), rng.choice(letters)
        pairs.append((a, rng.choice((a[:k] + a[k + 1 :], a[:k] + c + a[k:], a[:k] + c + a[k + 1 :]))))
    df = spark.createDataFrame(pairs, "a string, b string").select(F.array(*spelling.tile_of(F.col("a"))).alias("a"), F.array(*spelling.tile_of(F.col("b"))).alias("b"))
    steps = {s for s in spelling.STEPS} | {tuple(-v for v in s) for s in spelling.STEPS}
    assert all(tuple(x - y for x, y in zip(r.a, r.b, strict=True)) in steps for r in df.collect())
