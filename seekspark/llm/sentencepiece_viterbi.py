"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A model file's path is a parameter. A unigram file's ids are the segmentation of the greatest total score, earlier cuts winning ties. The
scores of a BPE file are merge ranks and no log-probabilities, so there the Viterbi runs over allowed neighbours instead: two pieces
may follow each other exactly if merging their joined characters gives these two pieces again (`Merges.apart`), and each prefix of a word has
one segmentation of allowed neighbours, the one that merging gives. Its ids are those of the file's own encoder; the tests compare both
on all texts at hand. Characters without a piece fall back to the pieces of their bytes. White space is escaped and a leading space added,
as the model says. No piece of the file joins a word to the next one's leading space, which is checked on loading, so words are segmented
on their own; distinct words of equal length advance together: for each end position the hashes of all substrings that end there probe
a bit map of the piece keys, those it lets through the sorted keys, and one vectorised maximum stores the back pointers. Whether two
pieces may be neighbours is worked out once and held in a table of fixed size, where a pair may take another's place.

Defined results: null and empty texts have no ids. Decoding gives the text back exactly, but for U+2581, which the format itself reads as a
space. Decoding unknown ids raises IndexError. Texts and words of any length work in memory linear in them. Repeated rows get equal results;
empty tables work. Other columns pass through; columns of the added names (ids, decoded) are replaced.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import common

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
PRIME = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN_PENALTY, CACHE, CACHED_LENGTH, GROUP = 10.0, 300_000, 256, 1 << 16
MAP_BITS, PAIR_BITS = 20, 20
_held: dict[str, Pieces] = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffers message: varints as ints, fixed32 and bytes as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def substring_hash(prefix: np.ndarray, powers: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashes of columns a..b from prefix hashes, for all rows."""
    return prefix[:, b] - prefix[:, a] * powers[b - a] + np.uint64(b - a)


class Merges:
    """The order in which a BPE file's pieces are merged, and which pieces can stand side by side when all merging is done."""

    def __init__(self, model: Pieces):
        self.model, n = model, len(model.pieces)
        self.length = np.array([len(p) for p in model.pieces])
        self.raw = np.zeros(n, np.uint64)  # hashes without the length
        self.raw[model.ids] = model.keys - self.length[model.ids].astype(np.uint64)
        usable = np.isin(np.arange(n), model.ids)
        self.time = np.where(usable & (self.length > 1), -model.scores, -1.0)  # single characters are there from the start
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.formed = usable & (self.length == 1)  # pieces that merging their own characters gives
        for size in range(2, model.longest + 1):  # the halves of a piece are shorter, so they are known
            ids = np.flatnonzero(usable & (self.length == size))
            if not len(ids):
                continue
            prefix = model.prefixes(model.points([model.pieces[i] for i in ids]))
            for k in range(1, size):
                a, b = (model.found(substring_hash(prefix, model.powers, *cut)) for cut in ((0, k), (k, size)))
                ok = (a >= 0) & (b >= 0) & ~self.formed[ids]
                ok[ok] = self.formed[a[ok]] & self.formed[b[ok]] & (np.maximum(self.time[a[ok]], self.time[b[ok]]) < self.time[ids[ok]])
                ok[ok] = self.apart(a[ok], b[ok], self.time[ids[ok]])
                self.left[ids[ok]], self.right[ids[ok]], self.formed[ids[ok]] = a[ok], b[ok], True

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | float = np.inf) -> np.ndarray:
        """Whether no merge before `limit` crosses from a to b: as merging is undone, the later of the two pieces at the border first, no
        two that stood there at one time may have a joined piece that merges before either goes into its own."""
        x, y, limit = a.copy(), b.copy(), np.broadcast_to(limit, a.shape).astype(float).copy()
        out, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            p, q = x[open_], y[open_]
            joined = self.model.found(self.raw[p] * self.model.powers[np.minimum(self.length[q], 64)] + self.raw[q] + (self.length[p] + self.length[q]).astype(np.uint64))
            crossed = (joined >= 0) & (self.time[joined] < limit[open_])
            out[open_[crossed]] = False
            tp, tq = self.time[p], self.time[q]
            go = ~crossed & ((tp >= 0) | (tq >= 0))
            first = go & (tp > tq)
            second = go & ~first
            # of equal merges the one further left comes first
            limit[open_[first]], x[open_[first]] = tp[first], self.right[p[first]]
            limit[open_[second]], y[open_[second]] = tq[second] + 1, self.left[q[second]]
            open_ = open_[go]
        return out


@dataclass
class Pieces:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    dummy_prefix: bool = True
    bpe: bool = False

    def __post_init__(self):
        usable = np.flatnonzero(np.isin(self.kinds, (NORMAL, USER)))
        words = [self.pieces[i] for i in usable]
        if bad := [w for w in words if re.search(f"[^{SPACE}]{SPACE}", w)]:
            raise ValueError(f"pieces that span words are not supported: {bad[:3]}")
        self.longest = max(map(len, words), default=1)
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(64, PRIME, np.uint64)], dtype=np.uint64)
        keys = np.zeros(len(words), np.uint64)
        for n in {len(w) for w in words}:
            at = [i for i, w in enumerate(words) if len(w) == n]
            keys[at] = substring_hash(self.prefixes(self.points([words[i] for i in at])), self.powers, 0, n)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], usable[order]
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[keys >> np.uint64(64 - MAP_BITS)] = True
        self.pairs, self.pair_allowed = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)
        self.sizes = np.array([len(p) for p in self.pieces])
        assert len(np.unique(self.keys)) == len(self.keys), "piece hashes collide"
        self.merges = Merges(self) if self.bpe else None
        self.key_scores = self.scores[self.ids] if not self.bpe else np.where(self.merges.formed[self.ids], 0.0, -np.inf)
        self.unknown = float(self.scores[self.kinds == NORMAL].min(initial=0)) - UNKNOWN_PENALTY
        self.bytes = {int(self.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(self.kinds == BYTE)}
        self.unknown_id = int(np.flatnonzero(self.kinds == UNKNOWN)[0]) if (self.kinds == UNKNOWN).any() else 0
        self.cache: dict[str, int] = {}
        self.pool, self.counts = [], []
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.raw, self.cuts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in _held:
            pieces, scores, kinds, dummy, model = [], [], [], True, UNIGRAM
            for number, value in _fields(open(path, "rb").read()):
                if number == 1:
                    piece = dict(_fields(value))
                    pieces.append(piece.get(1, b"").decode())
                    scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                    kinds.append(piece.get(3, NORMAL))
                elif number == 3:
                    spec = dict(_fields(value))
                    if spec.get(2) or spec.get(4, 1):
                        raise ValueError("only models without a normalisation table that keep white space are supported")
                    dummy = bool(spec.get(3, 1))
                elif number == 2:
                    model = dict(_fields(value)).get(3, UNIGRAM)
                    if model not in (UNIGRAM, BPE):
                        raise ValueError(f"model type {model} is not supported")
            _held[path] = cls(pieces, np.array(scores, float), np.array(kinds), dummy, model == BPE)
        return _held[path]

    @staticmethod
    def points(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)

    @staticmethod
    def prefixes(points: np.ndarray) -> np.ndarray:
        out = np.zeros((points.shape[1] + 1, len(points)), np.uint64)
        for j in range(points.shape[1]):
            out[j + 1] = out[j] * PRIME + (points[:, j] + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        return out.T  # so that columns are contiguous

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes, by their place in flat order, are piece keys, and which key each is."""
        flat = hashes.ravel()
        maybe = np.flatnonzero(self.map[flat >> np.uint64(64 - MAP_BITS)])
        at = np.minimum(np.searchsorted(self.keys, flat[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == flat[maybe] if len(self.keys) else np.zeros(0, bool)
        return maybe[hit], at[hit]

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        out = np.full(len(hashes), -1)
        where, at = self.places(hashes)
        out[where] = self.ids[at]
        return out

    def allowed(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it; anything may follow a word's start or a character without a piece."""
        out, ask = np.ones(len(before), bool), np.flatnonzero(before >= 0)
        pairs = before[ask] * len(self.pieces) + after[ask]
        slot = ((pairs.astype(np.uint64) * PRIME) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out[ask] = self.pair_allowed[slot]
        new = np.flatnonzero(self.pairs[slot] != pairs)
        if len(new):
            fresh, first, back = np.unique(pairs[new], return_index=True, return_inverse=True)
            answer = self.merges.apart(fresh // len(self.pieces), fresh % len(self.pieces))
            out[ask[new]] = answer[back]
            taken, one = np.unique(slot[new[first]], return_index=True)  # of new pairs that share a slot one is held
            self.pairs[taken], self.pair_allowed[taken] = fresh[one], answer[one]
        return out

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, one after another, and how many each has."""
        n, length = len(words), len(words[0])
        points = self.points(words)
        prefix, rows = self.prefixes(points), np.arange(n)
        best, back, piece = np.zeros((length + 1, n)), np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int64)
        for e in range(1, length + 1):
            spans = range(min(e, self.longest), 0, -1)  # the earliest start first: it wins ties
            where, at = self.places(np.stack([substring_hash(prefix, self.powers, e - k, e) for k in spans]))
            span, row = np.divmod(where, n)
            start = e - len(spans) + span
            if self.merges:
                ok = self.merges.formed[self.ids[at]]
                ok[ok] = self.allowed(piece[start[ok], row[ok]], self.ids[at[ok]])
                at, span, row, start = at[ok], span[ok], row[ok], start[ok]
            total, taken = np.full((len(spans), n), -np.inf), np.full((len(spans), n), -1, np.int64)
            total[-1] = best[e - 1] + self.unknown
            total[span, row], taken[span, row] = self.key_scores[at] + best[start, row], self.ids[at]
            top = total.argmax(0)
            best[e], back[e], piece[e] = total[top, rows], len(spans) - top, taken[top, rows]
        # all words walk their back pointers together, last piece first
        cuts, taken, e, row = [], [], np.full(n, length), rows
        while len(row):
            taken.append(piece[e, row])
            cuts.append(row)
            e = e - back[e, row]
            row, e = row[e > 0], e[e > 0]
        row, got = np.concatenate(cuts[::-1]), np.concatenate(taken[::-1])
        order = np.argsort(row, kind="stable")
        row, got = row[order], got[order]
        if (got < 0).any():
            row, got = self._fallback(points, row, got)
        return got.astype(np.int32), np.bincount(row, minlength=n)

    def _fallback(self, points: np.ndarray, row: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put byte pieces, or the unknown piece, in place of characters without a piece."""
        bad = got < 0
        last = (np.cumsum(np.where(bad, 1, self.sizes[got])) - 1) % points.shape[1]  # each piece's last character in its word
        codes, which = np.unique(points[row[bad], last[bad]], return_inverse=True)
        new = [[self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown_id] for c in codes.tolist()]
        sizes = np.array([len(x) for x in new])
        begins, flat = np.cumsum(sizes) - sizes, np.concatenate(new)
        count = np.ones(len(got), np.int64)
        count[bad] = sizes[which]
        out = np.repeat(got, count)
        inside = np.arange(sizes[which].sum()) - np.repeat(np.cumsum(sizes[which]) - sizes[which], sizes[which])
        out[np.repeat(bad, count)] = flat[np.repeat(begins[which], sizes[which]) + inside]
        return np.repeat(row, count), out

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text. Words seen are held with their ids, up to CACHE of them."""
        split = [WORD.findall((SPACE if self.dummy_prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        if not self.cache:
            self.pool, self.counts = [], []
        fresh: dict[int, list[str]] = {}
        for w in {w for s in split for w in s}.difference(self.cache):
            fresh.setdefault(len(w), []).append(w)
        for length, words in fresh.items():
            size = max(1, GROUP // length)
            for i in range(0, len(words), size):
                ids, counts = self.viterbi(words[i : i + size])
                self.cache.update(zip(words[i : i + size], range(len(self.cache), len(self.cache) + len(counts))))
                self.pool.append(ids)
                self.counts.append(counts)
        self.pool, self.counts = [np.concatenate([*self.pool, np.zeros(0, np.int32)])], [np.concatenate([*self.counts, np.zeros(0, np.int64)])]
        pool, counts = self.pool[0], self.counts[0]
        starts = np.cumsum(counts) - counts
        out = []
        for s in split:
            at = np.fromiter(map(self.cache.__getitem__, s), np.int64, len(s))
            n = counts[at]
            out.append(pool[np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)])
        if any(n > CACHED_LENGTH for n in fresh):  # rare and possibly huge words are not held
            self.cache.clear()
        return out

    def decode(self, rows: list) -> list[str]:
        """Texts of rows of ids: one gather of piece bytes for the whole batch."""
        ids = [np.asarray(r if r is not None else [], np.int64) for r in rows]
        flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        sizes = (self.cuts[1:] - self.cuts[:-1])[flat]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        where = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.cuts[flat], sizes)
        data, stops = self.raw[where].tobytes(), ends[np.cumsum([0, *map(len, ids)])]
        texts = (data[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1], stops[1:]))
        return [t[1:] if self.dummy_prefix and t.startswith(" ") else t for t in texts]


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Pieces.load(path)
        for b in batches:
            yield pd.Series(model.encode(b.tolist()), dtype=object)

    return docs.withColumn("ids", run(F.col(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with decoded, the text of their ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Pieces.load(path)
        for b in batches:
            yield pd.Series(model.decode(b.tolist()), dtype=object)

    return docs.withColumn("decoded", run(F.col(ids)))


def ids_crc32(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = decoded(encoded(common.table(spark, sf_dir, "documents", "doc_id", "text"), path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
