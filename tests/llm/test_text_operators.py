"""Text operators against brute force, round trips and held-out labels, on small tables with awkward rows."""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import SF, assert_same, connect  # noqa: E402

from tidewell.llm import avi_media, common, decontam, langid, license_scan, pii, quotes, sentencepiece_nbest, simhash, token_counts, toxicity  # noqa: E402
from tidewell.llm import queries as q  # noqa: E402

AWKWARD = [None, "", " ", "\n\n", "a", "ü", "日本語 \U0001f600", "x" * 5000, "a b " * 3000, "Und.34@mail7.example.com", "10.0.0.1; card 4111 1111 1111 1111; +1 (017) 555-7713", "a▁b  c"]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts, repeated rows, null ids, and a column whose name an operator uses itself."""
    rows = [(i, t, "en", None, None if t is None else len(t), "x") for i, t in enumerate(AWKWARD)]
    rows += [(3, "\n\n", "en", None, 2, "x"), (None, "no id here", None, None, 10, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, connect(), q.QUERIES[name], q.ORACLE_SQL[name])


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def pii_brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_pii_base_spans():
    rng = random.Random(1)
    texts = [t for t in AWKWARD if t] + ["".join(rng.choice("a1.@-+ %5() 0") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for t in texts:
        assert [(a, b, k) for a, b, k, _ in pii.find_spans(t) if k in pii.BASE] == pii_brute(t)


def test_pii_extra_kinds_need_confirmation():
    assert [k for *_, k, _ in pii.find_spans("iban DE89 3704 0044 0532 0130 00 thanks")] == ["iban"]
    assert pii.find_spans("DE88 3704 0044 0532 0130 00") == []
    assert [k for *_, k, _ in pii.find_spans("his SSN is 123-45-6789")] == ["ssn"] or pii.LEAST > pii.PRIOR + pii.NEAR
    assert pii.find_spans("code 123-45-6789") == []


def test_pii_digest_and_redaction(spark, docs):
    got = pii.pii_digest(docs)
    assert got.count() == docs.count()
    assert by_id(got)[9][0].n_email == 1 and by_id(got)[10][0].spans.startswith("ip:0:8,card:15:34,phone:36:")
    out = by_id(pii.redact_pii(docs))
    assert out[9][0].text == "[EMAIL]" and out[9][0].n_chars == 7 and out[0][0].text is None and out[10][0].text == "[IP]; card [CARD]; [PHONE]"
    assert pii.redact_pii(docs).columns == docs.columns


def test_decontamination_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        window = rng.choice([2, 3, 4])
        items = [(str(i), [rng.choice("abc").encode() for _ in range(rng.randint(0, 7))]) for i in range(rng.randint(0, 4))]
        tokens = [rng.choice("abcd").encode() for _ in range(rng.randint(0, 25))]
        grams = [(i, tuple(w[k : k + n])) for i, w in items if w for n in [min(window, len(w))] for k in range(len(w) - n + 1)]
        hit, met = set(), set()
        for i, g in grams:
            for k in range(len(tokens) - len(g) + 1):
                if tuple(tokens[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    met.add(i)
        spans, found = decontam.Automaton(items, window).scan(tokens)
        assert {x for a, b in spans for x in range(a, b)} == hit and found == met
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_decontamination_in_shards(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "tiny one"), (None, "no id here"), (3, None)], "item_id long, text string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100, "x " + " ".join(f"w{i}" for i in range(2, 16)) + " y"), (101, "A Tiny, ONE b")], "doc_id long, text string"))
    whole, parts = (decontam.match_benchmark(more, bench, shard_chars=n) for n in (10**6, 30))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    parts = {r.item_id for r in bench.where("item_id IS NOT NULL AND text IS NOT NULL").collect()}
    assert len(parts) == 2 and decontam.automata(bench, 13, 10**6, 14)[0].count() == 1
    got = by_id(decontam.contamination(more, bench))
    assert (got[100][0].n_hit, got[100][0].n_items) == (14, 1) and (got[101][0].n_hit, got[101][0].contaminated) == (2, True)
    assert {r.doc_id for r in decontam.drop_contaminated(more, bench).collect()} == {r.doc_id for r in more.collect()} - {100, 101}
    none = bench.where("false")
    assert not any(r.contaminated for r in decontam.contamination(docs, none).collect())


def test_many_automata_write_texts_once(spark, monkeypatch):
    """Repeated and null ids, null texts, and items that lie in several automata; each row keeps its own hits."""
    rng = random.Random(11)
    bench = spark.createDataFrame([(k, " ".join(f"b{k}_{i}" for i in range(10 + k % 5))) for k in range(40)], "item_id long, text string")
    assert decontam.automata(bench, 13, 120)[1] >= 20
    rows = [(rng.choice([None, 1, 2, k]), None if k % 9 == 0 else " ".join(["x", *(f"b{j}_{i}" for j in rng.sample(range(40), 3) for i in range(rng.choice([5, 20]))), "y"])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = decontam.match_benchmark(docs, bench).collect()
    written = []
    keep = decontam.materialize
    monkeypatch.setattr(decontam, "materialize", lambda df: written.append(df.columns) or keep(df))
    parts = decontam.match_benchmark(docs, bench, shard_chars=120).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts)) and any(len(r.spans) > 1 for r in parts) and len(parts) == 60
    assert sum("text" in c for c in written) == 1
    assert decontam.match_benchmark(docs.where("false"), bench, shard_chars=120).collect() == []


def test_long_spans_are_cut(spark):
    rng = random.Random(6)
    item = [f"t{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "é ü" * 3 + " " + " ".join(f"s{i}" for i in range(15)))], "item_id long, text string")
    rows = [(i, ", ".join([*(f"é{rng.random()}x" for _ in range(600)), *item[:n], *(f"ü{k}" for k in range(600))])) for i, n in enumerate([0, 12, 13, 14, 40, 60])]
    rows.append((6, " ".join([*(f"f{k}" for k in range(900)), *item[:9], *(f"s{i}" for i in range(15)), *item[9:30], "end"])))  # the cut brings a new span together
    rows.append((7, None))
    docs = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, n_chars long")
    grams = {tuple(w[k : k + 13]) for w in (decontam.words(r.text) for r in bench.collect()) for k in range(len(w) - 12)}

    def brute(text):
        while True:
            w = decontam.words(text)
            hit = sorted({p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for p in range(k, k + 13)})
            runs = [r for r in "".join("x" if k in set(hit) else " " for k in range(len(w))).split() if len(r) > 13]
            if not runs:
                return w
            long = {p for p in hit if any(set(range(s, s + 14)) <= set(hit) and s <= p <= s + 13 for s in range(p - 13, p + 1))}
            text = " ".join(x.decode() for k, x in enumerate(w) if k not in long)

    got = {r.doc_id: r for r in decontam.remove_contamination(docs, bench).collect()}
    assert got == {r.doc_id: r for r in decontam.remove_contamination(docs, bench, shard_chars=90).collect()}
    assert set(got) == set(range(8)) and all(decontam.words(got[i].text) == brute(t or "") for i, t in rows)
    assert [got[i].text == t for i, t in rows] == [True, True, True, False, False, False, False, True]
    assert all(r.n_chars == (-1 if r.text == dict(rows)[i] else len(r.text)) for i, r in got.items())
    assert {r.doc_id: r.text for r in decontam.drop_contaminated(docs, bench).collect()} == dict(rows)


def test_decontamination_takes_one_worker_a_task(spark, monkeypatch):
    """Two maps in one stage would take, and keep, two Python workers for each task."""
    bench = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([*(f"x{i}" for i in range(900)), *(f"t{i}" for i in range(20))]), 5), (2, "y", 1)], "doc_id long, text string, n_chars long")
    plans, keep = [], decontam.materialize
    monkeypatch.setattr(decontam, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    got = {r.doc_id: r.text for r in decontam.remove_contamination(docs, bench).collect()}
    assert {i: t.split() for i, t in got.items()} == {1: [f"x{i}" for i in range(900)], 2: ["y"]}
    assert [p.count("MapInArrow") for p in plans[1:]] == [1, 1]


def test_license_scan(spark, docs):
    notice = license_scan.TEMPLATES["mit-grant"]
    extra = spark.createDataFrame([(50, "foo " * 200 + notice + " bar" * 100), (51, "released UNDER the  mit license"), (52, "mit license released under")], "doc_id long, text string")
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan_licenses(spark, docs.select("doc_id", "text").unionByName(extra)).collect()}
    assert got == {(50, "mit-grant"): 1.0, (51, "mit"): 1.0}


def test_license_bands_meet_their_certainty():
    for n in (1, 5, 40):
        b = license_scan.bands_for(n, 64)
        need = -(-n * 4 // 5)
        assert 1 - (1 - need / (60 + n - need)) ** b >= license_scan.CERTAINTY


def test_media_round_trip(spark, docs):
    rng = random.Random(3)
    hard = ["".join(rng.choice(["\x80", "\x00", "é", "–", "z"]) for _ in range(n)) for n in (1, 63, 64, 700, 9000)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(200 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    want = {}
    for r in more.collect():
        raw = (r.text or "").encode()
        want.setdefault(r.doc_id, set()).add(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)))
    media = avi_media.store_as_avi(more)
    assert {k: {bytes(r.payload) for r in v} for k, v in by_id(avi_media.read_avi(media)).items()} == want
    twice = avi_media.media_digest(more.where("doc_id = 3")).distinct().count()
    assert twice == 1 and avi_media.media_digest(more).count() == more.count()


def test_media_index_and_shots():
    data = np.zeros((64, 64), np.uint8)
    scans = avi_media.encode_scans(data, 32)
    avi = avi_media.write_avi(data.tobytes(), scans)
    micros, noted, index = avi_media.read_index(avi)
    cut = avi.index(b"idx1")
    assert (micros, noted, len(index)) == (40_000, 4096, 2)
    assert avi_media.read_index(avi[:cut])[2] == index  # without an index the chunks are walked
    dark, bright = np.bincount([0], minlength=16) * 100, np.bincount([15], minlength=16) * 100
    assert avi_media.shots([dark, dark, bright, bright, dark]) == [0, 2, 4] and avi_media.shots([]) == []
    with pytest.raises(ValueError):
        avi_media.read_index(b"not a file at all")


def huffman(frame):
    """Tables of a frame by class and number, as (length, code) -> symbol; code after code, as the standard describes it."""
    out, at = {}, 2
    while frame[at + 1] != 0xDA:
        size = int.from_bytes(frame[at + 2 : at + 4], "big")
        if frame[at + 1] == 0xC4:
            body, table, code, k = frame[at + 4 : at + 2 + size], {}, 0, 17
            while body:
                table, code, k = {}, 0, 17
                for n in range(1, 17):
                    for _ in range(body[n]):
                        table[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code *= 2
                out[body[0]] = table
                body = body[k:]
        at += 2 + size
    return out, at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")


def decode_bit_by_bit(frame, blocks):
    """Coefficients of a grey frame that restarts after every block, read one bit after the other."""
    tables, at = huffman(frame)
    out = []
    for part in re.split(rb"\xff[\xd0-\xd7]", frame[at:-2]):
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\0", b"\xff"))
        pos, block = 0, [0] * 64

        def symbol(table):
            nonlocal pos
            for n in range(1, 17):
                if (n, int(bits[pos : pos + n], 2)) in table:
                    pos += n
                    return table[n, int(bits[pos - n : pos], 2)]

        def value(n):
            nonlocal pos
            pos += n
            x = int(bits[pos - n : pos] or "0", 2)
            return x if not n or x >> n - 1 else x - (1 << n) + 1

        block[0] = value(symbol(tables[0]))
        k = 1
        while k < 64 and (s := symbol(tables[16])):
            k += s >> 4
            block[k] = value(s & 15)
            k += 1
        out.append(block)
    assert len(out) == blocks
    return out


def colour_frame(coef, wide, high, restart):
    """A frame of three components, the first with two blocks a unit, written bit by bit; coef: (units, 4, 64)."""
    code = {(c, s): f"{v:0{n}b}" for c, t in huffman(avi_media.HEAD)[0].items() for (n, v), s in t.items()}
    bits, scan, last = "", b"", [0, 0, 0]
    flush = lambda: (lambda x: int(x, 2).to_bytes(len(x) // 8, "big").replace(b"\xff", b"\xff\0") if x else b"")(bits + "1" * (-len(bits) % 8))
    put = lambda c, run, v: code[c, run << 4 | (n := int(abs(v)).bit_length())] + (f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else "")
    for u, unit in enumerate(coef.tolist()):
        if u and restart and u % restart == 0:
            scan += flush() + bytes([255, 0xD0 + (u // restart - 1) % 8])
            bits, last = "", [0, 0, 0]
        for part, block in zip((0, 0, 1, 2), unit, strict=True):
            bits += put(0, 0, block[0] - last[part])
            last[part], run = block[0], 0
            for v in block[1:]:
                if v:
                    while run > 15:
                        bits += code[16, 0xF0]
                        run -= 16
                    bits += put(16, run, v)
                    run = 0
                else:
                    run += 1
            if run:
                bits += code[16, 0]
    head = avi_media.HEAD
    sof, sos = head.index(b"\xff\xc0"), head.index(b"\xff\xda")
    dht = head[head.index(b"\xff\xc4") : head.index(b"\xff\xdd")]
    frame = bytes([255, 0xC0, 0, 17, 8]) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])
    rst = bytes([255, 0xDD, 0, 4]) + restart.to_bytes(2, "big")
    return head[:sof] + frame + dht + rst + bytes([255, 0xDA, 0, 12, 3, 1, 0, 2, 0, 3, 0, 0, 63, 0]) + scan + flush() + b"\xff\xd9", dht, sos


def test_frames_against_a_plain_decoder():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, (64, 64)), np.where(rng.random((64, 64)) < 0.9, 128, rng.integers(0, 256, (64, 64))), np.full((64, 64), 128), np.zeros((64, 64))):
        data = data.astype(np.uint8)
        frames = [avi_media.HEAD + s + b"\xff\xd9" for s in avi_media.encode_scans(data, 32)]
        plain = [b for f in frames for b in decode_bit_by_bit(f, 32)]
        assert (np.array(plain) + 128 == data).all() and (np.concatenate(avi_media.decode_frames(frames)) + 128 == data).all()


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_colour_frames(spark, restart):
    rng = np.random.default_rng(2)
    coef = np.where(rng.random((6, 4, 64)) < 0.8, 0, rng.integers(-60, 61, (6, 4, 64)))
    frame, dht, _ = colour_frame(coef, 41, 15, restart)
    assert (avi_media.decode_frames([frame, frame])[1].reshape(6, 4, 64) == coef).all()
    bare = frame.replace(dht, b"")
    assert (avi_media.decode_frames([bare], dht[4:21 + 12] + dht[dht.index(b"\xff\xc4", 2) + 4 :])[0].reshape(6, 4, 64) == coef).all()
    body = lambda f: avi_media.write_avi(b"", [f]).replace(avi_media.HEAD + f + b"\xff\xd9", f.ljust(len(avi_media.HEAD + f) + 2, b"\0"))
    good = avi_media.write_avi(b"x" * 64, avi_media.encode_scans(np.full((32, 64), 130, np.uint8), 32))
    rows = [(1, body(frame)), (2, body(bare)), (3, b"not a file"), (4, good), (5, good[: len(good) // 2]), (6, None), (7, good.replace(good[700:760], b"\x55" * 60)), (None, good), (4, good)]
    got = by_id(avi_media.read_avi(spark.createDataFrame(rows, "doc_id long, media binary")))
    assert got[4][0].error is None and len(got[4]) == 2 and got[4][0].frames == 1 and got[None][0].payload == got[4][0].payload and got[1][0].frames == 1
    assert all(got[i][0].error and got[i][0].payload is None and got[i][0].clips is None for i in (2, 3, 7)) and got[6][0].payload is None and got[6][0].error is None


def test_media_digest_against_hashlib(spark, docs):
    import hashlib
    import zlib

    media = by_id(avi_media.store_as_avi(docs))
    for i, rows in by_id(avi_media.media_digest(docs)).items():
        for r, text in zip(rows, [AWKWARD[i] if i is not None else "no id here"] * 2, strict=False):
            raw = (text or "").encode()
            payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (r.media_bytes, r.media_sha256) == (len(media[i][0].media), hashlib.sha256(media[i][0].media).hexdigest())
            frames = [avi_media.HEAD + s + b"\xff\xd9" for s in avi_media.encode_scans(np.frombuffer(payload.ljust(-(-len(payload) // 2048) * 2048, b"\x80"), np.uint8).reshape(-1, 64), 32)]
            hists = [avi_media.histogram(np.array(decode_bit_by_bit(f, 32))) for f in frames]
            cut = [*avi_media.shots(hists), len(hists)]
            assert r.feature == f"frames={len(frames)};shots={len(cut) - 1};clips=" + ",".join(f"{a * 0.04:.2f}-{b * 0.04:.2f}" for a, b in zip(cut, cut[1:], strict=False))
    assert avi_media.media_digest(docs.where("false")).count() == 0


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = langid.language(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred != 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_of_awkward_rows(spark, docs):
    got = by_id(langid.language(docs))
    assert [got[i][0].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and len(got[3]) == 2 and got[None][0].held_out is False
    assert all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    nothing = langid.language(docs.where("lang = 'none'"))
    assert nothing.count() == 0
    unlearnt = langid.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unlearnt) == len(got[None]) + sum(len(v) for k, v in got.items() if k is not None) and {r.lang_pred for r in unlearnt} == {"und"}
    signs = spark.createDataFrame([(i, t) for i, t in enumerate(["²½", "Ⅷ①", "12 !", "é", "²a"])], "doc_id long, text string")
    model = langid.learn(spark.createDataFrame([(1, "abc é", "x"), (2, "xyz", "y")], "doc_id long, text string, lang string"))
    assert [r.lang_pred != "und" for r in langid.predict(signs, model).orderBy("doc_id").collect()] == [False, False, False, True, True]


def test_language_against_brute_force(spark, monkeypatch):
    """Naive Bayes over n-grams counted one by one, for all texts, in pieces and batches of any size."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in d.collect() if r.text is not None and r.lang is not None]

    def keys(text):
        c = "".join(x if x.isalpha() else " " for x in text.lower())
        c = "  " + re.sub("^ +", "", re.sub(" +", " ", c))
        for i in range(2, len(c)):
            h = 0
            for n in langid.ORDERS:
                h = (h + ord(c[i + 1 - n]) * ((n * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)) % 2**64
                yield (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - langid.BITS

    langs = sorted({r.lang for r in rows})
    counts, prior = {x: np.full(1 << langid.BITS, 0.5) for x in langs}, {x: 0 for x in langs}
    for r in rows:
        prior[r.lang] += 1
        for k in keys(r.text):
            counts[r.lang][k] += 1
    logs = {x: np.log(c / c.sum()) for x, c in counts.items()}
    model = langid.learn(d)
    few = [r.text for r in rows[:60]] + [" " * 300 + rows[0].text]
    for piece, together in ((langid.PIECE, langid.TOGETHER), (50, 200)):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "TOGETHER", together)
        for t, lang, score in zip(few, *langid.posteriors(few, model[0], model[1].T, model[2]), strict=True):
            at = list(keys(t))
            x = np.array([np.log(prior[k] / len(rows)) + logs[k][at].sum() for k in langs])
            assert not any(map(str.isalpha, t)) or (lang == langs[int(x.argmax())] and abs(score - 1 / np.exp(x - x.max()).sum()) < 1e-3)


def test_toxicity_folds_and_exceptions():
    auto = toxicity.build({"idiot": 3.0, "trash": 2.0}, ("trash can",))
    found = lambda t: [x[2] for x in toxicity.matches(auto, t)[0]]
    assert found("you 1D!0T!!") == ["idiot"] and found("idiot$$$ іdіоt") == ["idiot", "idiot"]
    assert found("idiots trashy") == [] and found("a trash can") == [] and found("trash, can") == ["trash"]
    auto = toxicity.build({"loser": 3.0, "loser*": 1.0, "los*": 0.5, "scum*": 2.0}, ("pond scum",))
    assert found("loser losers lost los") == ["loser", "loser*", "los*"] and found("pond scum scumbag xscumbag") == ["scum*"]
    assert len(toxicity.fold("ÀÉ!!a@b" * 50)) == 350 and toxicity.matches(auto, None)[0] == []


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(d, labels).join(labels, "doc_id").where("held_out")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("hit"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("miss")).first()
    assert r.hit > 0.9 and r.miss < 0.01
    by_lang = got.join(d.select("doc_id", "lang"), "doc_id").where("toxic = 1").groupBy("lang").agg(F.avg("predicted").alias("hit")).collect()
    assert all(x.hit > 0.6 for x in by_lang)


def toxicity_brute(weights, threshold, exceptions, text):
    """The score by looking at every word: whole terms, else the longest stem; words inside an exception don't count."""
    folded = toxicity.fold(text or "")
    inside = [(m.start(), m.end()) for e in exceptions for m in re.finditer(f"(?<![^\\W_]){re.escape(toxicity.fold(e))}(?![^\\W_])", folded)]
    total = 0.0
    for m in re.finditer(r"[^\W_]+", folded):
        word = m[0]
        stems = [k for k in range(len(word) - 1, 0, -1) if f"{word[:k]}*" in weights]
        end = m.end() if word in weights else m.start() + stems[0] if stems else None
        if end and not any(a <= m.start() and end <= b for a, b in inside):
            total += weights[word] if word in weights else weights[f"{word[: stems[0]]}*"]
    d = total / np.log2(2 + len(folded.split()))
    return d / (d + threshold)


def test_toxicity_against_brute_force(spark):
    """The learnt terms, phrases and scores of sf0.01 against counts made one by one."""
    sf = SF.replace("sf0.001", "sf0.01")
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.unionByName(d.where("doc_id < 4").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")).select(labels.columns))
    innocent = spark.createDataFrame([(10**6 + i, f"a calm text {i} on things") for i in range(300)], "doc_id long, text string")
    model = toxicity.learn(d, labels)
    term = max((t for t in model[0] if not t.endswith("*")), key=lambda t: model[0][t])
    tame = spark.createDataFrame([(2 * 10**6 + i, f"the steel {term} of item {i}") for i in range(4)], "doc_id long, text string")
    more = d.select("doc_id", "text").unionByName(innocent).unionByName(tame)
    taught = labels.select("doc_id", "toxic").unionByName(innocent.unionByName(tame).select("doc_id", F.lit(0).cast(labels.schema["toxic"].dataType).alias("toxic")))
    weights, threshold, exceptions = toxicity.learn(more, taught)
    assert {f"steel {term}", f"{term} of"} <= set(exceptions)
    y = {}
    for r in taught.where("toxic IS NOT NULL").collect():
        y[r.doc_id] = max(y.get(r.doc_id, 0), r.toxic)
    rows = [(y[r.doc_id], r.text) for r in more.collect() if r.doc_id in y and r.text is not None]
    words = lambda side: [w for k, t in rows if (k == 1) == side for w in re.findall(r"[^\W_]+", toxicity.fold(t))]
    bad, good = words(True), words(False)
    for t, w in weights.items():
        n = lambda ws: sum(x.startswith(t[:-1]) and len(x) >= len(t) if t.endswith("*") else x == t for x in ws)
        assert abs(w - np.log((n(bad) + 0.5) / len(bad) / ((n(good) + 0.5) / len(good)))) < 1e-5 and w >= toxicity.MIN_WEIGHT
    got = {r.doc_id: r.score for r in toxicity.score(more, (weights, threshold, exceptions)).collect()}
    for r in more.collect():
        assert abs(got[r.doc_id] - toxicity_brute(weights, threshold, exceptions, r.text)) < 1e-9


def test_toxicity_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count() and got.where("predicted = 1").count() == 0
    assert toxicity.drop_toxic(docs, labels).count() == docs.count()


def test_quotes_nest_and_link(spark):
    rows = [
        (1, 0, "user", "Hello there"), (1, 1, "bot", "On x, user wrote:\n> hello   THERE\nHi"), (1, 2, "user", "> > Hello there\n> Hi\n\nBye"),
        (1, 3, "bot", "> nobody said this\nok"), (1, 3, "bot", "> nobody said this\nok"), (2, 0, "user", None), (2, 1, "bot", "> Hi\nagain"), (3, 0, "user", ">"), (None, 1, "user", "x"),
    ]
    got = by_id(quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "conv_id")
    one = {r.turn: r for r in got[1]}
    assert [one[i].body for i in range(4)] == ["Hello there", "Hi", "Bye", "ok"]
    assert [one[i].parent_turn for i in range(4)] == [None, 0, 1, None] and [one[i].depth for i in range(4)] == [0, 1, 2, 0]
    assert one[2].max_level == 2 and [one[i].root_turn for i in range(4)] == [0, 0, 0, 3] and sorted(r.position for r in got[1]) == [1, 2, 3, 4]
    two = {r.turn: r for r in got[2]}
    assert (two[1].parent_conv, two[1].parent_turn) == (1, 1) and two[0].body == "" and None not in got and got[3][0].body == ""


MESSAGE = "conv_id long, turn long, role string, text string"


def test_places_by_buckets(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 1, 2]), rng.choice([-1, -1, 7]), rng.randrange(-40, 400), rng.randrange(-(2**63), 2**63) if i % 3 else 5) for i in range(1500)]
    df = spark.createDataFrame(rows, "row long, conv_id long, above long, turn long, tie long")
    want = {}
    for key in {r[1:3] for r in rows}:
        want |= {r[0]: n for n, r in enumerate(sorted((r for r in rows if r[1:3] == key), key=lambda r: (r[3], r[4], r[0])), 1)}
    for least in (10, 10**6):
        got = quotes._nth(df, least, 7).collect()
        assert len(got) == len(rows) and all(r.nth == want[r.row] for r in got)


@pytest.mark.parametrize("first, step", [(1_700_000_000_000, 1), (-1_700_000_000_000, 3), (2**62, 1), (0, 0), (-(2**40), 2**33)])
def test_places_of_large_turns(spark, first, step):
    """Turns such as epoch milliseconds, beyond what a double tells apart, and a single one."""
    rng = random.Random(10)
    rows = [(i, 1, -1, first + step * rng.randrange(700), rng.randrange(-(2**63), 2**63)) for i in range(2000)]
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[3], r[4], r[0])), 1)}
    got = quotes._nth(spark.createDataFrame(rows, "row long, conv_id long, above long, turn long, tie long"), 500).collect()
    assert {r.row: r.nth for r in got} == want


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_texts_made_to_collide_keep_their_own_segments(spark):
    """Thue-Morse strings and their complements agree under every polynomial hash modulo 2^64."""
    texts = [thue_morse(n, *pair) for n in (32, 64, 256, 1024, 2048, 4096) for pair in ("ab", "ba", "xy", "yx", "äö", "öä")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = by_id(sentencepiece_nbest.segment_texts(rows))
    assert all(got[i][0].decoded == t for i, t in enumerate(texts))


def test_sample_of_one_repeated_id(spark):
    """Whatever the id hashes to, rows of one id are sampled by their texts too, and copies of one row count once."""
    for doc_id in range(8):
        rows = spark.range(0, 40_000, 1, 4).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("ein Satz mit Wort "), "id").alias("text"), F.lit("de").alias("lang"))
        n = common.bounded_sample(rows, "doc_id", 5000, ("text", "lang")).count()
        assert 4000 < n < 6000
        same = rows.select("doc_id", F.lit("immer derselbe Satz").alias("text"), "lang")
        assert common.bounded_sample(same, "doc_id", 5000, ("text", "lang")).count() == 1
    langs, _, _ = langid.learn(rows, 5000)
    assert langs == ["de"]


def test_first_of_near_duplicates_keeps_every_column(spark, docs):
    """Columns named as helpers come back with their own values."""
    clash = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in ("_row_digest", "_0", "at", "fp", "first", "a.b")])
    kept = simhash.keep_first(clash)
    assert kept.columns == clash.columns
    whole = {tuple(r) for r in clash.collect()}
    assert all(tuple(r) in whole for r in kept.collect())
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in simhash.keep_first(docs).collect()}


def test_threads_are_read_depth_first(spark):
    rng = random.Random(9)
    rows, up = [], {}
    for conv in range(4):
        for turn in range([1, 7, 60, 300][conv]):
            row = len(rows)
            above = [r for r in rows if r[1] == conv]
            parent = None if not above or rng.random() < 0.1 else above[-1] if rng.random() < 0.5 else rng.choice(above)
            rows.append((row, conv, turn, rng.randrange(100), None if parent is None else conv if rng.random() < 0.97 else 99, None if parent is None else parent[2], None if parent is None else parent[0]))
            up[row] = parent[0] if parent is not None and rows[-1][4] == conv else None
    rows += [(len(rows), None, 3, 1, None, None, None), (len(rows) + 1, 2, None, 1, None, None, None)]
    got = {r.row: r for r in quotes._ordered(spark.createDataFrame(rows, "row long, conv_id long, turn long, tie long, parent_conv long, parent_turn long, to long")).collect()}
    at = {}

    def visit(row, depth, root):
        conv = rows[row][1]
        at[conv] = at.get(conv, 0) + 1
        assert (got[row].position, got[row].depth, got[row].root_turn) == (at[conv], depth, root)
        for r in sorted((r for r in rows if up.get(r[0]) == row), key=lambda r: (r[2], r[3], r[0])):
            visit(r[0], depth + 1, root)

    for r in sorted((r for r in rows[:-2] if up[r[0]] is None), key=lambda r: (r[1], r[2], r[3], r[0])):
        visit(r[0], 0, r[2])
    assert len(got) == len(rows) and sum(at.values()) == len(rows) - 2 and all(got[r[0]].position is None for r in rows[-2:])


def test_quotes_of_parts_and_of_several_messages(spark):
    rows = [
        (1, 0, "a", "First line\nsecond line\n\nAnother paragraph\nof two"), (1, 1, "b", "Something else"), (1, 2, "a", "> second line\nyes"), (1, 3, "b", "> another paragraph\n> of two\nyes indeed"),
        (1, 4, "a", "> Something else\nand\n> second line\nboth"), (1, 5, "b", "> second line\n> nowhere\npart of it"), (1, 6, "a", "> Later text\nquoted before it was said"), (1, 7, "b", "Later text"), (2, 9, "b", "later text"),
    ]
    got = {r.turn: r for r in quotes.link_rows(spark.createDataFrame(rows, MESSAGE)).where("conv_id = 1").collect()}
    to = {t: [(x.conv_id, x.turn) for x in r.links] for t, r in got.items()}
    assert to == {0: [], 1: [], 2: [(1, 0)], 3: [(1, 0)], 4: [(1, 1), (1, 0)], 5: [(1, 0)], 6: [(2, 9)], 7: []}
    assert [got[i].position for i in range(8)] == [1, 5, 2, 3, 6, 4, 7, 8]
    assert (got[4].parent_turn, got[5].links[0].part, got[6].parent_conv, got[6].depth) == (1, 1, 2, 0)


def test_quotes_keep_every_row(spark):
    rows = [(1, 0, "a", "one"), (1, 0, "b", "two"), (1, 0, "b", "two"), (1, 1, "a", "three"), (1, 1, "a", "four"), (None, 0, "a", "> two\nfive"), (1, None, "a", "six"), (None, None, None, None)]
    df = spark.createDataFrame(rows, MESSAGE)
    got = quotes.link_rows(df.withColumn("text", F.when(F.col("turn") == 1, F.concat(F.lit("> two\n"), "text")).otherwise(F.col("text")))).collect()
    assert sorted(r.body for r in got) == ["", "five", "four", "one", "six", "three", "two", "two"] and len({r.row for r in got}) == 8
    assert all(r.parent_turn == (0 if r.body in ("three", "four") else None) for r in got) and sorted(r.position for r in got if r.position) == [1, 2, 3, 4, 5]
    assert quotes.as_mail(df).count() == len(rows) == quotes.quotation_links(df).count()
    assert {r.text for r in quotes.as_mail(df).where("conv_id = 1 AND turn = 1").collect()} == {"On turn 0, a wrote:\n> one\nthree", "On turn 0, a wrote:\n> one\nfour"}


def test_segmentation_against_brute_force():
    pieces = sentencepiece_nbest.Pieces(open(sentencepiece_nbest.MODEL, "rb").read())
    rng = random.Random(4)

    def all_ways(text):
        t, out = sentencepiece_nbest.SPACE + text.replace(" ", sentencepiece_nbest.SPACE), []

        def go(at, score, ids):
            if at == len(t):
                out.append((score, ids))
                return
            for end, s, own in pieces.edges(t, at):
                go(end, score + s, ids + list(own))

        go(0, 0, [])
        return sorted(out, key=lambda x: -x[0])

    for _ in range(120):
        text = "".join(rng.choice(["the", "in", "g", " ", "a", "ñ", "\n", "日", ". "]) for _ in range(rng.randint(1, 7)))
        n, want = rng.choice([1, 2, 3, 5]), all_ways(text)
        got = pieces.encode(text, n)
        assert [s for s, _ in got] == [s for s, _ in want[:n]] and len({tuple(i) for _, i in got}) == len(got) and all(w in want for w in got)
    for t in AWKWARD[1:]:
        assert not t or pieces.decode(pieces.encode(t)[0][1]) == t


def test_segmentation_rows(spark, docs):
    got = by_id(sentencepiece_nbest.segment_texts(docs))
    assert all(r.decoded == (AWKWARD[i] if i is not None else "no id here") for i, rows in got.items() for r in rows)
    assert got[0][0].ids == [] and got[0][0].ways == [] and len(got[3]) == 2
    best, second = got[9][0].ways[:2]
    assert best.score >= second.score and best.changes == [] and second.changes


def fingerprint_brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64(b" ".join(words[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [*AWKWARD, "A b C d", "É É é x"]:
        assert simhash.fingerprint(t) == fingerprint_brute(t)


def components_brute(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("sizes", [(16, 64), (2, 2)])
def test_links_lose_none(spark, monkeypatch, sizes):
    monkeypatch.setattr(simhash, "BLOCK", sizes[0])
    monkeypatch.setattr(simhash, "GROUP", sizes[1])
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(rng.randint(0, 4)):
            s ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(s)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    want = {signed(k): signed(v) for k, v in components_brute(sorted(fps), 3).items()}
    assert groups({signed(f): root.get(signed(f), signed(f)) for f in fps}) == groups(want)


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43
    assert simhash.components(edges.where("false")).count() == 0


def test_near_duplicates_of_awkward_rows(spark, docs):
    got = by_id(simhash.near_duplicates(docs))
    assert [got[i][0].component_id for i in (0, 1, 2, 3)] == [0, 0, 0, 0] and got[0][0].fingerprint == "0" * 16 and len(got[3]) == 2
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 4, 5, 6, 7, 8, 9, 10, 11, None}
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_one_row_of_each_component_stays(spark):
    text = lambda seed: " ".join(random.Random(seed).choice("abcdefghijklmnop") * 3 for _ in range(60))
    x, y, z, w = map(text, range(4))
    rows = [(3, y, "a"), (5, x, "a"), (5, y, "a"), (5, x, "a"), (5, x, "b"), (None, x, "a"), (None, z, "a"), (None, z, "a"), (7, w, "a"), (7, w, "a"), (7, w, "a")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", y), ("5", x), ("None", z), ("7", w)])


def test_token_counts(spark, docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(300, "one two\n\n\nthree ü日\n  four")], "doc_id long, text string"))
    for r in token_counts.token_counts(more).join(more.where("doc_id is not null").distinct(), "doc_id").collect():
        text = r.text or ""
        ids = enc.encode_ordinary(text)
        ends = token_counts.line_sections(text) if text else []
        counts, at = [0] * len(ends), 0
        for i in ids:
            size = len(enc.decode_single_token_bytes(i))
            a, b = len(text.encode()[:at].decode(errors="ignore")), len(text.encode()[: at + size].decode(errors="ignore"))
            b = max(b, a + 1)
            share = [min(b, e) - max(a, s) for s, e in zip([0, *ends], ends, strict=False)]
            counts[share.index(max(share))] += 1
            at += size
        assert [s.n_tokens for s in r.sections] == counts and r.n_tokens == len(ids)
    assert token_counts.section_rows(token_counts.token_counts(more.where("doc_id = 300"))).count() == 5


def test_long_whitespace_keeps_tokens():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "B", " ", " ", "\n", "\t", "\x1c", "\x85", "\u3000", "1", ".", "'s", "é"]) * rng.randint(1, 4) for _ in range(rng.randint(0, 20)))
        assert token_counts.encode(enc, t, rng.choice([2, 3, 5])) == enc.encode_ordinary(t)
    assert token_counts.encode(enc, " " * 3_000_000) == [ranks[b" "]] * 3_000_000
    assert len(token_counts.encode(enc, "a" + "\n" * 2_000_000 + " b")) < 2_000_000


def test_pipeline(spark):
    """Each stage's rows against a plain version of its rule, on what the stage before has kept."""
    import corpus_pipeline as cp

    sf = SF.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), labels.where(toxicity.crc_mod("doc_id", 5) != 0))
    want = [{i: r.text for i, r in rows.items() if toxicity_brute(model[0], model[1], model[2], r.text) < 0.5}]
    fps = {i: fingerprint_brute(t) for i, t in want[0].items()}
    root, first = components_brute(sorted(set(fps.values())), 3), {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    want.append({i: want[0][i] for i in first.values()})
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for w in items if w for k in range(max(1, len(w) - 12))}
    sizes = sorted({len(g) for g in grams})

    def clean(text):
        while True:
            w = decontam.words(text)
            hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams for p in range(k, k + n)}
            if hit and 20 * len(hit) >= len(w):
                return False
            runs, at = [], 0
            for p in range(len(w) + 1):
                if p not in hit:
                    runs += [(at, p)] if p - at > 13 else []
                    at = p + 1
            if not runs:
                return w
            text = b" ".join(x for p, x in enumerate(w) if not any(a <= p < b for a, b in runs)).decode()

    words = {i: clean(t) for i, t in want[1].items()}
    want.append({i: w for i, w in words.items() if w is not False})
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.count() == len(seen[-1])
    assert seen[0] == want[0] and seen[1] == want[1] and {i: decontam.words(t) for i, t in seen[2].items()} == want[2]
    assert len(rows) > len(seen[0]) > len(seen[1]) > len(seen[2]) == len(seen[4])
    assert seen[3] == {i: t and pii.redact(t, pii.find_spans(t)) for i, t in seen[2].items()} == seen[4] and not any(pii_brute(t) for t in seen[4].values())
    assert {(r.doc_id, r.text) for r in cp.run(spark, sf).collect()} == set(seen[4].items())


LONG = [" " * 400_000, "x" * 300_000, "ab c. " * 200_000, "\n" * 400_000 + "end", "@" * 200_000, "1" * 200_000 + "; 4111111111111111", "> " * 100_000 + "deep", "日本" * 200_000, "a b c d e f g h i j k l m n " * 20_000, "AA00" * 50_000]


def documents_operators(docs, labels, bench, spark):
    return {
        "op1": pii.pii_digest(docs), "op2": decontam.contamination(docs, bench), "op3": license_scan.scan_licenses(spark, docs), "op4": avi_media.media_digest(docs), "op5": langid.language(docs),
        "op6": toxicity.toxicity(docs, labels), "op8": sentencepiece_nbest.segment_digest(docs), "op9": simhash.near_duplicates(docs), "op10": token_counts.token_digest(docs),
    }


def test_empty_and_clashing_tables(spark, docs):
    """No rows, and columns named as the operators' own: a row for each row, but for the license scan, which returns matches."""
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    own = "ids ways decoded fp tile items n_words payload media clips score terms sections row root node a b shard key at text_1 _row_digest".split()
    clash = docs.select("*", *[F.lit(str(i)).alias(c) for i, c in enumerate(own)])
    for name, out in documents_operators(clash, labels, bench, spark).items():
        assert out.count() == docs.count() or name == "op3", name
    for name, out in documents_operators(clash.where("false"), labels.where("false"), bench.where("false"), spark).items():
        assert out.count() == 0, name
    talk = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y")], MESSAGE).select("*", *[F.lit(str(i)).alias(c) for i, c in enumerate(["body", "said", "key", "found", "passages", "depth", "nth", "at", "sibling"])])
    assert quotes.quotation_links(talk).count() == 2 and quotes.link_rows(talk.where("false")).count() == 0 == quotes.quotation_links(talk.where("false")).count()
    assert [r.n_messages for r in quotes.threads(quotes.link_rows(quotes.as_mail(talk))).collect()] == [2]


def test_very_long_texts(spark):
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(LONG)], "doc_id long, text string, lang string").repartition(4, "doc_id")
    got = {name: by_id(out) for name, out in documents_operators(docs, labels, bench, spark).items()}
    assert all(len(out) == len(LONG) for name, out in got.items() if name != "op3")
    for i, t in enumerate(LONG):
        assert (got["op1"][i][0].n_card, got["op2"][i][0].n_words, got["op4"][i][0].n_bytes) == (1 if i == 5 else 0, len(decontam.words(t)), len(t.encode()))
        assert got["op9"][i][0].fingerprint == f"{fingerprint_brute(t):016x}"
    back = by_id(sentencepiece_nbest.segment_texts(docs))
    assert all(back[i][0].decoded == t for i, t in enumerate(LONG))
    parsed = quotes.link_rows(docs.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("a").alias("role"), "text"))
    assert parsed.count() == len(LONG)


def test_stages_on_awkward_rows(spark, docs):
    import corpus_pipeline as cp

    documents = docs.drop("spans")
    for name, stage in cp.STAGES:
        out = stage(spark, documents, SF)
        none = stage(spark, documents.where("false"), SF)
        assert none.count() == 0, name
        if name != cp.STAGES[-1][0]:
            assert out.columns == documents.columns and out.count() > 0
            documents = out
