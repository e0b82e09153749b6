"""N-best SentencePiece segmentation: forward Viterbi scores are the exact heuristic of a backward A-star search."""

from __future__ import annotations

import heapq
import math
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = "▁", "\udfff"
N_BEST = 3
#: Characters cut into segments at once, and of documents searched together (a longer one is searched alone).
SLICE = 1 << 20
#: A worker keeps the results of so many segments; longer segments than SHORT characters are searched one by one.
CACHE, SHORT = 1_500_000, 128
#: Segments of up to PLAIN characters are told apart by a polynomial hash modulo 2^64, longer ones by XXH3: for strings made to
#: collide, such as long Thue-Morse ones, powers of two in the differences would add up. Each process draws its own
#: multiplier, 3 or 5 modulo 8, which keeps those powers least, and seed; results don't depend on them.
PLAIN = 32
_K = int.from_bytes(os.urandom(8)) & ~7 | 5
_SEED = int.from_bytes(os.urandom(8))
_INVERSE = pow(_K, -1, 2**64)
NO_GAP = 1 << 60


def piece_score(rank: int) -> int:
    """Log-probability of the piece of a rank under Zipf's law, in whole millionths, so that sums are exact in any order."""
    return -round(1e6 * math.log(1 + rank))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of count, one after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + count, count)


class Places:
    """Numbers 64-bit hashes in the order in which they come: open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.zeros(0, np.uint64)
        self.bits = 10
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.add(keys)

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ h >> np.uint64(31)) * np.uint64(_K) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, new: np.ndarray) -> None:
        """Adds distinct hashes that aren't held."""
        place = np.arange(len(self.keys), len(self.keys) + len(new), dtype=np.int32)
        self.keys = np.concatenate([self.keys, new])
        if 2 * len(self.keys) > len(self.table):
            self.bits = (4 * len(self.keys)).bit_length()
            self.table = np.full(1 << self.bits, -1, np.int32)
            place, new = np.arange(len(self.keys), dtype=np.int32), self.keys
        slot = self._slots(new)
        while len(place):
            free = self.table[slot] < 0
            self.table[slot[free]] = place[free]
            on = self.table[slot] != place
            place, slot = place[on], (slot[on] + 1) & (len(self.table) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it isn't held."""
        if not len(self.keys):
            return np.full(len(h), -1)
        slot = self._slots(h)
        out = self.table[slot].astype(np.int64)
        todo = np.nonzero((out >= 0) & (self.keys[out] != h))[0]
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.table) - 1)
            at = self.table[slot]
            out[todo] = at
            on = (at >= 0) & (self.keys[at] != h[todo])
            todo, slot = todo[on], slot[on]
        return out


class Pieces:
    """Pieces of a model file with scores by their rank among the merges; a character that is no piece becomes its bytes.

    Texts are cut into segments wherever no piece holds both the character before and the one behind the cut,
    so segments are independent of each other; the results of a segment are kept under a 64-bit hash of it (see PLAIN).
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        first = min(plain)
        self.score = {self.names[i]: (piece_score(i - first + 1), (i,)) for i in plain}
        of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        raw = [of_byte.get(i, self.names[i].replace(SPACE, " ").encode()) for i in range(n)]
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_start, self.raw = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(raw), np.uint8)
        self.byte_score = piece_score(n)
        self.longest = max(map(len, self.score))
        self.sizes: dict[str, list[int]] = {}  # lengths of the pieces that end with a character
        for last, n in sorted({(p[-1], len(p)) for p in self.score}):
            self.sizes.setdefault(last, []).append(n)
        chars = sorted({c for p in self.score if len(p) > 1 for c in p})
        self.char = np.zeros(0x110000, np.uint16)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.meet = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.score:
            k = self.char[[ord(c) for c in p]]
            self.meet[k[:-1], k[1:]] = True
        self._hash_pieces()
        self._clear()

    def edges(self, text: str, at: int):
        """(end, score, ids) of the pieces that start at a place."""
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            if (got := self.score.get(text[at:end])) is not None:
                yield end, *got
        if text[at] not in self.score:
            raw = (SPACE if text[at] == LITERAL else text[at]).encode("utf-8", "surrogatepass")
            yield at + 1, self.byte_score * len(raw), tuple(self.bytes[b] for b in raw)

    def _into(self, text: str, end: int):
        """(start, score, ids) of the pieces that end at a place."""
        last = text[end - 1]
        for start in (end - n for n in self.sizes.get(last, ()) if n <= end):
            if (got := self.score.get(text[start:end])) is not None:
                yield start, *got
        if last not in self.score:
            yield (end - 1, *next(self.edges(text, end - 1))[1:])

    def n_best(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids) of one segment, best first; equal scores in the order the search finds them.

        What waits in the search falls behind by its best completion, and no two share a way, so only as many as
        are still wanted need to wait.
        """
        size = len(text)
        forward = array("q", [0, *[-NO_GAP] * size])
        for end in range(1, size + 1):
            forward[end] = max(forward[start] + s for start, s, _ in self._into(text, end))
        found, order = [], 0
        waiting = [(-forward[size], size, 0, 0, None)]  # of equal ways the one nearest to the start goes on
        while waiting and len(found) < n:
            _, at, _, behind, path = waiting.pop(0)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for start, s, ids in self._into(text, at):
                order += 1
                waiting.append((-(forward[start] + s + behind), start, order, behind + s, (ids, path)))
            waiting = sorted(waiting)[: n - len(found)]
        return found

    def _hash_pieces(self) -> None:
        """64-bit hashes of all beginnings of pieces, with the id and score where a beginning is a piece."""
        found: dict[int, tuple[int, int]] = {}
        edges = {p: (ids[0], s) for p, (s, ids) in self.score.items()}
        edges |= {chr(b): (self.bytes[b], self.byte_score) for b in range(128) if chr(b) not in self.score}
        for piece, (i, s) in edges.items():
            h = 0
            for n, c in enumerate(piece, 1):
                h = (h * _K + ord(c) + 1) % 2**64
                if n == len(piece):
                    found[h] = (i, s)
                else:
                    found.setdefault(h, (-1, 0))
        self.prefix = Places(np.array(list(found), np.uint64))
        self.prefix_id, self.prefix_score = (np.array([x[i] for x in found.values()]) for i in (0, 1))

    def _edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, length, id, score) of all pieces in chars; left: characters from a place to its segment's end."""
        at, h, out = np.arange(len(chars)), np.zeros(len(chars), np.uint64), []
        code = chars.astype(np.uint64) + np.uint64(1)
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, h = at[inside], h[inside] * np.uint64(_K) + code[at[inside] + n - 1]
            where = self.prefix.find(h)
            known = where >= 0
            at, h, where = at[known], h[known], where[known]
            piece = self.prefix_id[where] >= 0
            out.append((at[piece], np.full(int(piece.sum()), n), self.prefix_id[where[piece]], self.prefix_score[where[piece]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def best_of(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, gap to the next best, number of ids, all ids) of the best segmentation of each segment, in step over segments.

        chars holds the code points of all segments, of size each, of SHORT at most. The gap is the least, over pieces off
        the best path, that the best path through such a piece falls behind; forward and backward Viterbi scores give it.
        Every character of the segments must be a piece or ASCII.
        """
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        inner = np.arange(len(chars)) - begin[owner]
        at, n, ids, s = self._edges(chars, size[owner] - inner)
        group = (inner[at] << 5 | n).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        at, n, ids, s, group = at[order], n[order], ids[order], s[order], group[order]
        node = at + owner[at]  # a segment has one node more than characters
        cuts = np.r_[0, np.nonzero(np.diff(group))[0] + 1, len(group)].tolist()
        forward = np.full(len(chars) + len(size), -NO_GAP)
        forward[begin + np.arange(len(size))] = 0
        into = np.zeros(len(forward), np.int64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            to, new = node[a:b] + n[a], forward[node[a:b]] + s[a:b]
            more = new > forward[to]
            forward[to[more]] = new[more]
            into[to[more]] = np.arange(a, b)[more]
        backward = np.full(len(forward), -NO_GAP)
        last = begin + np.arange(len(size)) + size
        backward[last] = 0
        for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            start = node[a:b]
            backward[start] = np.maximum(backward[start], s[a:b] + backward[start + n[a]])
        gap = forward[last][owner[at]] - forward[node] - s - backward[node + n]
        here, parts, steps = last.copy(), [], []
        alive = np.arange(len(size))
        while len(alive):
            e = into[here[alive]]
            gap[e] = NO_GAP
            parts.append(ids[e])
            steps.append(alive)
            here[alive] -= n[e]
            alive = alive[here[alive] > begin[alive] + alive]
        second = np.full(len(size), NO_GAP)
        np.minimum.at(second, owner[at], gap)
        who = np.concatenate(steps)[::-1]
        order = np.argsort(who, kind="stable")
        return forward[last], second, np.bincount(who, minlength=len(size)), np.concatenate(parts)[::-1][order]

    def _clear(self) -> None:
        self.seen = Places(np.zeros(0, np.uint64))
        self.best, self.second = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.start, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.others: dict[tuple[int, int], list] = {}

    def _learn(self, joined: str, chars: np.ndarray, begin: np.ndarray, size: np.ndarray, hashes: np.ndarray, n: int) -> None:
        """Adds the best segmentations of new segments, which begin in chars at begin, to what is kept."""
        lone = (size == 1) & (chars[begin] >= 128) & (self.prefix.find(chars[begin].astype(np.uint64) + np.uint64(1)) < 0)
        plain = (size <= SHORT) & ~lone
        first, rest = np.nonzero(plain)[0], np.nonzero(~plain)[0]
        score, second, count, ids = (np.zeros(0, np.int64),) * 4
        if len(first):
            score, second, count, ids = self.best_of(chars[spread(begin[first], size[first])], size[first])
        slow = [self.n_best(joined[a : a + m], max(2, n)) for a, m in zip(begin[rest].tolist(), size[rest].tolist(), strict=True)]
        self.long |= {len(self.seen) + len(first) + i: g for i, g in enumerate(slow)}
        self.seen.add(hashes[np.concatenate([first, rest])])
        self.best = np.concatenate([self.best, score, np.array([g[0][0] for g in slow], np.int64)])
        self.second = np.concatenate([self.second, second, np.array([g[0][0] - g[1][0] if len(g) > 1 else NO_GAP for g in slow], np.int64)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate([count, np.array([len(g[0][1]) for g in slow], np.int64)]))])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32), np.array([i for g in slow for i in g[0][1]], np.int32)])

    def _slices(self, joined: str) -> Iterator[tuple[int, int]]:
        """Ranges of about SLICE characters that end between segments."""
        at = 0
        while at < len(joined):
            end = joined.find(SPACE, at + SLICE)
            while end > 0 and self.meet[self.char[ord(joined[end - 1])], self.char[ord(SPACE)]]:
                end = joined.find(SPACE, end + 1)
            end = end if end > 0 else len(joined)
            yield at, end
            at = end

    def _segments(self, joined: str, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, place in what is kept) of all segments of texts joined, which begin at begins; new ones are learnt."""
        where, places = [], []
        for a, b in self._slices(joined):
            chars = np.frombuffer(joined[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = self.char[chars]
            cut = np.r_[True, ~self.meet[kind[:-1], kind[1:]]]
            cut[begins[np.searchsorted(begins, a) : np.searchsorted(begins, b)] - a] = True
            begin = np.nonzero(cut)[0]
            end = np.r_[begin[1:], len(chars)]
            power = np.cumprod(np.r_[np.uint64(1), np.full(len(chars), _K, np.uint64)])
            back = np.cumprod(np.r_[np.uint64(1), np.full(len(chars), _INVERSE, np.uint64)])
            total = np.r_[np.uint64(0), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[:-1])]
            hashes = (total[end] - total[begin]) * back[begin]
            for i in np.nonzero(end - begin > PLAIN)[0].tolist():
                hashes[i] = xxhash.xxh3_64_intdigest(chars[begin[i] : end[i]].tobytes(), _SEED)
            k = self.seen.find(hashes)
            fresh = np.nonzero(k < 0)[0]
            if len(fresh):
                new, first = np.unique(hashes[fresh], return_index=True)
                first = fresh[first]
                self._learn(joined[a:b], chars, begin[first], end[first] - begin[first], new, n)
                k[fresh] = self.seen.find(hashes[fresh])
            where.append(begin + a)
            places.append(k)
        return np.concatenate(where), np.concatenate(places)

    def _next_best(self, segment: str, k: int, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """(gap, ids) of the n - 1 segmentations next to the kept best one."""
        if (got := self.others.get((k, n))) is None:
            best = tuple(self.flat[self.start[k] : self.start[k + 1]].tolist())
            ways = self.long.get(k) or self.n_best(segment, n)
            got = [(int(self.best[k]) - score, ids) for score, ids in ways if ids != best][: n - 1]
            if len(segment) <= SHORT:
                self.others[k, n] = got
        return got

    def _near(self, gaps: np.ndarray, first: np.ndarray, n: int) -> list[list[int]]:
        """For each text, whose segments start at first, the places of its n least gaps, of equal ones the first."""
        gaps, out = gaps.copy(), [[] for _ in first]
        count = np.diff(np.r_[first, len(gaps)])
        for _ in range(n):
            least = np.minimum.reduceat(gaps, first)
            at = np.nonzero(gaps == np.repeat(least, count))[0]
            text, nth = np.unique(np.searchsorted(first, at, "right") - 1, return_index=True)
            at = at[nth]
            for t, i, g in zip(text.tolist(), at.tolist(), gaps[at].tolist(), strict=True):
                if g < NO_GAP:
                    out[t].append(i)
            gaps[at] = NO_GAP
        return out

    def ways(self, texts: list[str | None], n: int = N_BEST) -> Iterator[tuple[np.ndarray, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]], str | None]]:
        """Ids of the best segmentation of each text, the n best (score, changes), best first, and what the ids decode to.

        A change is (place in the best ids, ids replaced there, ids instead). Best of all is each segment's best; the next
        differ in the n - 1 segments of the least gaps, and only there backward A-star is run.
        """
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
                size += len(texts[end] or "")
                end += 1
            yield from self._ways(texts[at:end], n)
            at = end

    def _ways(self, texts: list[str | None], n: int):
        if len(self.seen) > CACHE or len(self.others) > CACHE // 8:
            self._clear()
        self.long: dict[int, list] = {}  # ways of these texts' new long segments
        marked = [SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE) for t in texts if t]
        if not marked:
            yield from ((np.zeros(0, np.int32), [], t) for t in texts)
            return
        joined = "".join(marked)
        begins = np.cumsum([0, *map(len, marked)])[:-1]
        where, k = self._segments(joined, begins, n)
        count = self.start[k + 1] - self.start[k]
        ids = self.flat[spread(self.start[k], count)]
        ends = np.cumsum(count)
        first = np.searchsorted(where, begins)
        near = self._near(self.second[k], first, n - 1)
        top = np.add.reduceat(self.best[k], first).tolist()
        cuts = np.r_[(ends - count)[first], len(ids)].tolist()
        t = -1
        for text in texts:
            if not text:
                yield np.zeros(0, np.int32), [], text
                continue
            t += 1
            own = ids[cuts[t] : cuts[t + 1]]
            segment = lambda i: joined[where[i] : where[i + 1] if i + 1 < len(where) else len(joined)]
            gaps = heapq.nsmallest(n - 1, ((g, i, j, other) for i in near[t] for j, (g, other) in enumerate(self._next_best(segment(i), int(k[i]), n))))
            ways: list[tuple[int, tuple]] = [(0, ())]
            for i in sorted({g[1] for g in gaps}):
                changes = [(0, ()), *((g, ((int(ends[i] - count[i]) - cuts[t], int(count[i]), other),)) for g, at, _, other in gaps if at == i)]
                ways = heapq.nsmallest(n, ((a + b, x + y) for a, x in ways for b, y in changes))
            yield own, [(top[t] - gap, list(changes)) for gap, changes in ways], self.decode(own)

    def encode(self, text: str | None, n: int = N_BEST) -> list[tuple[int, list[int]]]:
        """The n best (score, ids) of one text, best first."""
        ((ids, ways, _),) = self.ways([text], n)
        out = []
        for score, changes in ways:
            own = ids.tolist()
            for at, count, other in sorted(changes, reverse=True):
                own[at : at + count] = other
            out.append((score, own))
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: runs of bytes are UTF-8, space marks are spaces, the first of which is dropped."""
        ids = np.asarray(ids, np.int64)
        raw = b"".join(self.raw[spread(self.raw_start[part], self.raw_size[part])].tobytes() for part in (ids[a : a + SLICE] for a in range(0, len(ids), SLICE))).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


_models: dict[int, Pieces] = {}


def segment_texts(docs: DataFrame, model: str = MODEL, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, ways, decoded): the best segmentation's ids, the n_best as array of (score, changes), best first, and the text that ids decode to.

    changes says where a way differs from ids: array of (at, n, ids), n ids from `at` on being replaced.
    Null and empty texts have no ids and no ways and decode to null and empty. A text with fewer ways has
    fewer. Repeated rows and ids come back as often as they are there. Texts of any length are segmented whole.
    The model file is read by the driver and sent on.
    """
    with open(model, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        proto = held.value
        if hash(proto) not in _models:
            _models[hash(proto)] = Pieces(proto)
        pieces = _models[hash(proto)]

        def step(ids, texts):
            found = list(pieces.ways(texts, n_best))
            offsets = np.cumsum([0, *(len(own) for own, _, _ in found)])
            flat = np.concatenate([own for own, _, _ in found])
            ways = [[{"score": s, "changes": [{"at": x, "n": n, "ids": list(o)} for x, n, o in changes]} for s, changes in w] for _, w, _ in found]
            return ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), ways, [d for _, _, d in found]

        return step

    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>, ways array<struct<score:long,changes:array<struct<at:long,n:long,ids:array<int>>>>>, decoded string")


def segment_digest(docs: DataFrame) -> DataFrame:
    """Size and digest of the best segmentation, the scores of all, and the digest of the decoded text."""
    return segment_texts(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.array_join(F.transform("ways", lambda w: w["score"]), ",").alias("scores"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
