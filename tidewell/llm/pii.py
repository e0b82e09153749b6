"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that make a span of a kind likelier when they stand near it.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
#: Score of a pattern alone, of a passed check, of a context word; the least score of the kinds beyond BASE.
PRIOR, CONFIRMED, NEAR, LEAST = 0.4, 0.4, 0.2, 0.6
REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def mod97(compact: str) -> bool:
    rest = 0
    for c in compact[4:] + compact[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _emails(text: str):
    """Left to right over the @ signs: what precedes one is bounded by the last match, so long runs are read once."""
    end = floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        low = max(end, floor)
        while start > low and text[start - 1] in LOCAL_CHARS:
            start -= 1
        floor = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    for m in IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            yield m.span()


def _cards(text: str):
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in IBAN.finditer(text):
        got = m[0]
        while len(got.replace(" ", "")) >= 15:
            if mod97(got.replace(" ", "")):
                yield m.start(), m.start() + len(got)
                break
            got = got.rpartition(" ")[0]


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind. Null counts as empty. Base kinds stay at any score."""
    text = text or ""
    found = []
    for kind, spans in (
        ("email", _emails(text) if "@" in text else ()),
        ("ip", _ips(text)),
        ("card", _cards(text)),
        ("phone", _phones(text) if "+" in text else ()),
        ("iban", _ibans(text)),
        ("ssn", (m.span() for m in SSN.finditer(text))),
    ):
        for start, end in spans:
            around = text[max(0, start - REACH) : end + REACH].lower()
            score = PRIOR + CONFIRMED * (kind in ("ip", "card", "iban")) + NEAR * any(w in around for w in CONTEXT[kind])
            if kind in BASE or score >= LEAST:
                found.append((start, end, kind, round(score, 3)))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind, _ in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id and spans, array of (start, end, kind, score), in code points.

    A null or empty text has no spans; ids may repeat or be null and are returned as they are.
    """

    def make():
        def step(ids, texts):
            return ids, [[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in find_spans(t)] for t in texts]

        return step

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, spans array<struct<start:long,end:long,kind:string,score:double>>")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as a string, from detect_pii."""
    found = detect_pii(docs)
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with each span of `text` replaced by its kind in brackets; n_chars follows. Null texts stay null."""

    def make():
        return lambda texts: ([None if t is None else redact(t, find_spans(t)) for t in texts],)

    return _with_text(docs, make)


def _with_text(docs: DataFrame, make) -> DataFrame:
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))

    def whole():
        inner = make()

        def step(*cols):
            cols = list(cols)
            (cols[at],) = inner(cols[at])
            return cols

        return step

    out = map_rows(docs.toDF(*names), whole, schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
