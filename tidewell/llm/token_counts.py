"""Token counts of sections: a document is encoded once, and its tokens' character spans are joined to sections."""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The pattern's engine fails on much longer runs of whitespace, so those are cut out first. Fixed value: the characters its \s stands for.
LONGEST_RUN = 100_000
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def encode(enc, text: str, longest: int = LONGEST_RUN) -> list[int]:
    """Token ids of a text of any length.

    The pattern takes a run of whitespace at the end of the text as one piece, and one before other characters without its
    last; nothing before a run belongs to it. So a long run is encoded by itself without changing any token.
    """
    if len(text) < longest:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in re.finditer(f"[{WHITE}]{{{longest},}}", text):
        end = m.end() - (m.end() < len(text))
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


def line_sections(text: str) -> list[int]:
    """Ends of lines, in characters; a line's newline belongs to it, and text behind the last newline is a line."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def token_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens of so many bytes each; a token of a part of a character spans that character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def allot(starts: np.ndarray, stops: np.ndarray, ends: list[int]) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary.

    A crossing token goes to the section that holds most of its characters, the first of those on a tie.
    """
    edge = np.asarray(ends)
    first, last = np.searchsorted(edge, starts, "right"), np.searchsorted(edge, stops - 1, "right")
    crossing = np.nonzero(first != last)[0]
    where = first.copy()
    for i in crossing.tolist():
        a, b, best = int(starts[i]), int(stops[i]), -1
        for s in range(int(first[i]), int(last[i]) + 1):
            held = min(b, ends[s]) - max(a, ends[s - 1] if s else 0)
            if held > best:
                best, where[i] = held, s
    return np.bincount(where, minlength=len(ends)), len(crossing)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, sections=line_sections, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_crossing, sections array of (end, n_tokens)) of each row.

    sections(text) gives the ends of a text's sections in characters, rising to its length. Null and
    empty texts have no tokens and no sections; whitespace counts like other characters. Rows may repeat, ids
    may repeat or be null: each row comes back with its id. The vocabulary file is read by the driver and sent on.
    """
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            width[rank] = len(token)

        def one(text):
            if not text:
                return 0, 0, []
            ids = np.asarray(encode(enc, text))
            ends = sections(text)
            counts, crossing = allot(*token_spans(text, width[ids]), ends)
            return len(ids), crossing, [{"end": e, "n_tokens": n} for e, n in zip(ends, counts.tolist(), strict=True)]

        def step(ids, texts):
            got = [one(t) for t in texts]
            return ids, [a for a, _, _ in got], [b for _, b, _ in got], [c for _, _, c in got]

        return step

    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, n_crossing long, sections array<struct<end:long,n_tokens:long>>")


def section_rows(counted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each section: id, section number from 0, start, end, n_tokens."""
    return counted.select(id_col, F.posexplode("sections").alias("section", "s"), "sections").select(id_col, "section", F.when(F.col("section") > 0, F.expr("sections[section - 1].end")).otherwise(F.lit(0)).alias("start"), "s.end", "s.n_tokens")


def token_digest(docs: DataFrame) -> DataFrame:
    counted = token_counts(docs)
    return counted.select("doc_id", "n_tokens", F.size("sections").cast("long").alias("n_sections"), "n_crossing", F.array_join(F.transform("sections", lambda s: s["n_tokens"]), ",").alias("section_tokens"))
