"""Toxic texts: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bound_batches, bounded_sample, crc_mod, map_rows, materialize

#: Learning reads about so many labelled rows, chosen by a hash of their id.
TRAIN_ROWS = 20_000
#: A term's least log ratio of rates, share and number of toxic texts, and log-likelihood ratio of its presence.
MIN_WEIGHT, MIN_SHARE, MIN_DOCS, MIN_EVIDENCE = 2.5, 0.02, 3, 10.0
#: Terms that a task counts before it hands its counts on; bounds its memory.
HELD = 60_000
#: Beginnings of words that may be terms, as stems: insults are inflected and compounded.
STEMS = range(5, 9)
#: A stem isn't a term where one longer term makes up so much of its toxic occurrences: it would only add that word's innocent kin.
ONE_WORD = 0.9
#: A clean text rejected costs as much as so many toxic ones kept.
FALSE_ALARM = 3

#: Characters that stand for a letter. Digits and signs count only inside a word.
LOOKALIKES = {
    "a": "4@аαɑ", "b": "8Ьвβ", "c": "сϲ", "d": "ԁ", "e": "3еєε", "g": "9ɡ", "h": "һн",
    "i": "1!іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "η", "o": "0оο", "p": "рρ",
    "s": "5$ѕ", "t": "7тτ", "u": "υ", "v": "νѵ", "w": "ѡ", "x": "хχ", "y": "уγ", "z": "2",
}
#: Model: weights of terms, the density that scores 0.5, learnt phrases in which a term is meant otherwise.
Model = tuple[dict[str, float], float, tuple[str, ...]]


def _fold_table() -> dict[int, int]:
    table = {}
    for cp in [*range(0x590), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(cp))[:1].lower()
        if len(base) == 1 and ord(base) != cp:
            table[cp] = ord(base)
    for letter, others in LOOKALIKES.items():
        for c in others:
            for form in {c, c.upper()}:
                if len(form) == 1:
                    table[ord(form)] = ord(letter)
    return table


_FOLD = _fold_table()
_FOLD_ASCII = bytes(_FOLD.get(b, b) for b in range(128)) + bytes(128)
#: Signs at the edge of a word, which are no letters.
_EDGE = re.compile(r"(?<![\w@$!])[@$!]+|(?<=\w)[@$!]++(?!\w)")


def fold(text: str) -> str:
    """Lower case without accents, homoglyphs, digits or signs for letters; as many characters as before."""
    if "@" in text or "$" in text or "!" in text:
        text = _EDGE.sub(lambda m: " " * len(m[0]), text)
    return text.encode().translate(_FOLD_ASCII).decode("ascii") if text.isascii() else text.translate(_FOLD)


_WORD = re.compile(r"[^\W_]+")


def build(weights: dict[str, float], exceptions: tuple[str, ...] = ()):
    """Automaton of folded terms; one that ends in * is a stem. An exception has weight 0 and covers what lies inside it."""
    held: dict[str, list] = {}
    for term, w in [*weights.items(), *((e, 0.0) for e in exceptions)]:
        stem = term.endswith("*")
        if key := fold(term.rstrip("*")).strip():
            held.setdefault(key, [None, None])[stem] = w
    auto = ahocorasick.Automaton()
    for key, (whole, stem) in held.items():
        auto.add_word(key, (len(key), key, whole, stem))
    auto.make_automaton()
    return auto


def matches(auto, text: str | None) -> tuple[list[tuple[int, int, str, float]], int]:
    """Matches outside exceptions, as (start, end, term, weight), and the number of words.

    Terms match whole words, stems the beginning of longer words; of terms that start together the longest counts.
    """
    folded = fold(text or "")
    if not len(auto):
        return [], folded.count(" ") + 1
    found, except_for = {}, []
    for last, (n, key, whole, stem) in auto.iter(folded):
        start, end = last + 1 - n, last + 1
        if start and folded[start - 1].isalnum():
            continue
        if end < len(folded) and folded[end].isalnum():
            if stem is not None:
                found[start] = (start, end, f"{key}*", stem)
        elif whole:
            found[start] = (start, end, key, whole)
        elif whole is not None:
            except_for.append((start, end))
    kept = list(found.values())  # matches of one start come shortest first
    if except_for and kept:
        kept = [x for x in kept if not any(a <= x[0] and x[1] <= b for a, b in except_for)]
    return kept, len(folded.split())


def density(found: list, n_words: int) -> float:
    """Sum of weights over the logarithm of the length: one insult in a long text still counts."""
    return sum(w for *_, w in found) / math.log2(2 + n_words)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model, from labelled rows with text.

    Candidates are words and their first 5 to 8 letters. A term's weight is the log of its rate per
    word in toxic texts over that in others. Terms have MIN_WEIGHT or more, stand in MIN_SHARE of the
    toxic texts and MIN_DOCS of them at least, and their presence tells the labels apart by a
    log-likelihood ratio of MIN_EVIDENCE; there are 5 / MIN_SHARE times the words of a toxic text at
    most. Phrases of a term and a word beside it are exceptions where MIN_DOCS others have them and toxic texts
    have them no more often per word, so they are learnt for any language. Rows of a null id or label teach nothing, one
    of a repeated id with several labels counts as toxic if one of them is, and repeated texts count each. Without
    labelled rows no term is learnt.
    """
    want = bounded_sample(labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", train_rows)
    rows = materialize(docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(want), "doc_id").select("toxic", "text"))  # train_rows bounds the broadcast side
    bound_batches(docs.sparkSession)

    def count(batches):
        held: dict[tuple[int, str], list[int]] = {}
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own: Counter = Counter()
                for w, n in Counter(_WORD.findall(fold(text))).items():
                    own[""] += n
                    own[w] += n
                    for k in STEMS:
                        if k < len(w):
                            own[f"{w[:k]}*"] += n
                own.setdefault("", 0)
                for term, n in own.items():
                    x = held.setdefault((toxic == 1, term), [0, 0])
                    x[0] += 1
                    x[1] += n
                if len(held) > HELD:
                    yield pack(held)
                    held = {}
        yield pack(held)

    def pack(held):
        sides = [[n[i] if bad == side else 0 for (bad, _), n in held.items()] for i in (0, 1) for side in (True, False)]
        return pa.RecordBatch.from_arrays([pa.array([t for _, t in held], pa.string()), *(pa.array(x, pa.int64()) for x in sides)], names=["term", "bad", "good", "bad_n", "good_n"])

    numbers = ("bad", "good", "bad_n", "good_n")
    counted = rows.mapInArrow(count, "term string, bad long, good long, bad_n long, good_n long")
    sums = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in numbers]).where(f"bad >= {MIN_DOCS} OR term = ''")
    total = sums.where("term = ''").first()
    if total is None or not total.bad:
        return {}, 1.0, ()

    def fit(k, n: int):
        """Log-likelihood of k among n at its own smoothed rate."""
        q = (k + 0.5) / (n + 1)
        return k * F.log(q) + (n - k) * F.log(1 - q)

    bad, good = F.col("bad"), F.col("good")
    evidence = fit(bad, total.bad) + fit(good, total.good) - fit(bad + good, total.bad + total.good)
    weight = F.log((F.col("bad_n") + 0.5) / max(1, total.bad_n) / ((F.col("good_n") + 0.5) / max(1, total.good_n)))
    terms = (
        sums.where("term != ''").where((bad >= MIN_SHARE * total.bad) & (bad * total.good >= good * total.bad) & (evidence >= MIN_EVIDENCE))
        .select("term", "bad_n", weight.alias("w")).where(F.col("w") >= MIN_WEIGHT).collect()
    )
    most: dict[str, int] = {}  # toxic occurrences of the commonest longer term that begins so
    for r in terms:
        for k in STEMS:
            if k < len(r.term.rstrip("*")):
                most[r.term[:k]] = max(most.get(r.term[:k], 0), r.bad_n)
    weights = {r.term: round(r.w, 6) for r in sorted(terms, key=lambda r: r.term) if not r.term.endswith("*") or most.get(r.term[:-1], 0) < ONE_WORD * r.bad_n}
    except_for = _exceptions(rows, weights, total.bad_n, total.good_n)
    return weights, _threshold(rows, weights, except_for), except_for


def phrases(auto, text: str) -> set[str]:
    """A matched word with the word before it, and with the word behind it, as folded text has them with a space between."""
    folded = fold(text)
    out = set()
    for start, end, _, _ in matches(auto, text)[0]:
        stop = end
        while stop < len(folded) and folded[stop].isalnum():
            stop += 1
        if m := re.search(r"([^\W_]+) \Z", folded[max(0, start - 40) : start]):
            out.add(f"{m[1]} {folded[start:stop]}")
        if m := re.match(r" ([^\W_]+)", folded[stop : stop + 40]):
            out.add(f"{folded[start:stop]} {m[1]}")
    return out


def _exceptions(rows: DataFrame, weights: dict[str, float], bad_n: int, good_n: int) -> tuple[str, ...]:
    """Phrases with a term that are at least as frequent in texts that aren't toxic; rows are bounded by train_rows."""
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def make():
        auto = build(held.value)

        def step(toxic, texts):
            got = [(y, sorted(phrases(auto, t))) for y, t in zip(toxic, texts, strict=True)]
            return [y for y, p in got for _ in p], [x for _, p in got for x in p]

        return step

    counts = map_rows(rows, make, "toxic int, phrase string").groupBy("phrase").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") != 1).alias("good"))
    kept = counts.where((F.col("good") >= MIN_DOCS) & (F.col("bad") * max(1, good_n) <= F.col("good") * max(1, bad_n)))
    return tuple(sorted(r.phrase for r in kept.select("phrase").collect()))


def _threshold(rows: DataFrame, weights: dict[str, float], except_for: tuple[str, ...]) -> float:
    """Halfway from the density with most hits, less FALSE_ALARM for each false alarm, to the next lower one; rows are bounded by train_rows."""
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def make():
        auto = build(held.value, except_for)
        return lambda toxic, texts: (toxic, [density(*matches(auto, t)) for t in texts])

    seen = map_rows(rows, make, "toxic int, d double").groupBy("toxic", "d").count().collect()
    at_density: Counter = Counter()
    for r in seen:
        at_density[r.d] += r["count"] if r.toxic == 1 else -FALSE_ALARM * r["count"]
    best, at, gain = -math.inf, 1.0, 0
    for d in sorted((d for d in at_density if d > 0), reverse=True):
        gain += at_density[d]
        if gain > best:
            best, at = gain, d
    below = max((r.d for r in seen if r.d < at), default=0.0)
    return (at + below) / 2


def score(docs: DataFrame, model: Model, exceptions: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, terms) of each row: density over density plus threshold, and the matched terms.

    Null and empty texts score 0; rows and ids may repeat, ids may be null, and each row comes back with its id.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        weights, threshold, learnt = held.value
        auto = build(weights, (*exceptions, *learnt))

        def step(ids, texts):
            got = [matches(auto, t) for t in texts]
            d = [density(*g) for g in got]
            return ids, [x / (x + threshold) for x in d], [sorted({t for _, _, t, _ in f}) for f, _ in got]

        return step

    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, score double, terms array<string>")


def toxicity(docs: DataFrame, labels: DataFrame, fold_no: int = 0, folds: int = 5) -> DataFrame:
    """Scores of all rows, learnt from labels outside the held-out fold."""
    model = learn(docs, labels.where(crc_mod("doc_id", folds) != fold_no))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", folds) == fold_no, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("terms").cast("long").alias("n_terms"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, tested beside the row so that texts aren't shuffled; null texts stay."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.where(crc_mod("doc_id", 5) != 0)))
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")

    def make():
        weights, threshold, learnt = held.value
        auto = build(weights, learnt)

        def step(*cols):
            keep = [density(*matches(auto, t)) < threshold for t in cols[at]]
            return [[x for x, k in zip(c, keep, strict=True) if k] for c in cols]

        return step

    return map_rows(docs.toDF(*names), make, ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))).toDF(*docs.columns)
