"""Language of texts: multinomial naive Bayes over hashed character n-grams, scored sparsely in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bound_batches, bounded_sample, crc_mod, map_rows

BITS, ORDERS = 15, (1, 2, 3)
#: Learning reads about so many rows with a language, chosen by a hash of their id, text and language.
TRAIN_ROWS = 20_000
PIECE = 1 << 19
#: n-grams of texts scored together; bounds the memory of a step.
TOGETHER = 1 << 21

_letters = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool)


def grams(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of a text's n-grams, piece by piece; all but letters counts as a space, and spaces as one."""
    before = np.full(2, 32, np.uint32)
    for at in range(0, len(text), PIECE):
        body = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        body = np.where(_letters[body], body, 32)
        body = body[(body != 32) | (np.r_[before[-1], body[:-1]] != 32)]
        c = np.r_[before, body].astype(np.uint64)
        before = c[-2:].astype(np.uint32)
        h, keys = np.zeros(len(c) - 2, np.uint64), []
        for n in ORDERS:
            h = h + c[3 - n : len(c) + 1 - n] * np.uint64((n * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
            keys.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS))
        yield np.concatenate(keys).astype(np.int64)


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, smooth: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (bucket, language) and log-priors, from rows of a non-null lang and text.

    n-grams are counted in each task and summed by Spark; what reaches the driver has at most
    2**15 rows for each language.
    """
    rows = bounded_sample(docs.where("lang IS NOT NULL AND text IS NOT NULL"), "doc_id", train_rows, ("text", "lang")).select("lang", "text")
    bound_batches(docs.sparkSession)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                own[-1] += 1
                for g in grams(text):
                    own[:-1] += np.bincount(g, minlength=1 << BITS)
        for lang, own in held.items():
            at = np.nonzero(own)[0]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at, "n": own[at]})

    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in sums})
    counts = np.zeros(((1 << BITS) + 1, max(1, len(langs))))
    for r in sums:
        counts[r.bucket, langs.index(r.lang)] = r.n
    docs_of = np.maximum(counts[-1], 1)
    p = counts[:-1] + smooth
    return langs, np.log(p / p.sum(axis=0)).astype(np.float32), np.log(docs_of / docs_of.sum())


def posteriors(texts: list[str | None], langs: list[str], by_lang: np.ndarray, prior: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and posterior of each text; by_lang holds a row of log-probabilities for each language."""
    total = np.tile(prior, (len(texts), 1))
    known = np.array([bool(langs and t and any(map(str.isalpha, t))) for t in texts], bool)
    owners: list[int] = []
    parts: list[np.ndarray] = []

    def add():
        """Adds the log-probabilities of the n-grams at hand: the product of the sparse rows of counts and the matrix."""
        flat, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]
        for k, row in enumerate(by_lang):
            np.add.at(total[:, k], owners, np.add.reduceat(row[flat], starts, dtype=np.float64))
        owners.clear()
        parts.clear()

    size = 0
    for i in np.nonzero(known)[0].tolist():
        for g in grams(texts[i]):
            if len(g):
                owners.append(i)
                parts.append(g)
                size += len(g)
            if size >= TOGETHER:
                add()
                size = 0
    if parts:
        add()
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0).tolist()


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), the score being the posterior of the language.

    A text that is null or has no letter (str.isalpha) is `und` with score 0, as are all where nothing could be learnt; ties
    go to the first language by name. Texts of any length are scored whole, rows and ids may repeat, ids may be null.
    """
    langs, table, prior = model
    held = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(table.T), prior))

    def make():
        return lambda ids, texts: (ids, *posteriors(texts, *held.value))

    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, lang_pred string, score double")


def language(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """Predictions for all rows, learnt from those outside the held-out fold."""
    model = learn(docs.where(crc_mod("doc_id", folds) != fold))
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", folds) == fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
