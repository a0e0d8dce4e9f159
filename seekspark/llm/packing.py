"""Best-fit packing by a configuration linear program over the histogram of lengths.

Token counts come from the byte-level BPE file named by a parameter. A document's ids, ended by id 0, are cut into pieces of
at most `capacity` ids. Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. There the
configuration LP (fewest sequences covering the histogram) is solved by multiplicative weights: the weights price the
lengths, one knapsack dynamic program finds the dearest configuration for each longest piece, and weights of what is covered fall. The
fractional solution is rounded down and the rest is placed best-fit into the planned sequences' free room, then into new ones. The plan is a list of (length, first rank, copies,
first sequence, offset) of a size bounded by the capacity, not by the data; each piece finds its slot by its rank among
pieces of its length, which is counted without moving texts.

Ids are integers. Defined results: null or empty text is the single id 0. A null doc_id passes through; repeated rows are each packed.
Pieces of equal length take places in any order. Texts of any length and an empty table work. Other columns of the input are not
returned, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seekspark.llm import common

CAPACITY, END_ID, ROUNDS, ETA = 2048, 0, 32, 4.0
_encoders: dict = {}


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files, as a rule: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function texts -> lists of ids for a byte-level BPE file, equal to the `tokenizers` library's and faster."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        chars = byte_characters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        slow = []

        def ids(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except Exception:  # the pattern engine gives up on some huge texts
                slow.extend([] if slow else [Tokenizer.from_file(path)])
                return slow[0].encode(text, add_special_tokens=False).ids

        _encoders[path] = ids
    return _encoders[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its place: partition `part` and `nth` of its length there."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = []
            for doc, content in zip(batch[id_col], batch[text]):
                ids = np.array([*encode(content or ""), END_ID], "<u4")
                first = len(ids) % capacity or capacity
                begin = 0
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    n = end - begin
                    out.append((doc, k, begin, n, zlib.crc32(ids[begin:end].tobytes()), part, seen[n]))
                    seen[n] += 1
                    begin = end
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], "Int64")
            yield frame

    return docs.select(id_col, text).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def priced(prices: np.ndarray, sizes: np.ndarray, limits: np.ndarray, rooms: np.ndarray, capacity: int) -> np.ndarray:
    """For each room the dearest multiset of sizes that fits it: counts (rooms x sizes), by one knapsack dynamic program.

    A size is taken at most min(limits[i], capacity // size) times, split into 1, 2, 4, ... and a rest, which takes a logarithm of that in passes.
    """
    value, took = np.zeros(capacity + 1), []
    for i, n in enumerate(sizes):
        most, k = min(int(limits[i]), capacity // int(n)), 1
        while most > 0:
            k = min(k, most)
            most -= k
            w = int(n) * k
            trial = value[: capacity + 1 - w] + prices[i] * k
            better = np.zeros(capacity + 1, bool)
            better[w:] = trial > value[w:] + 1e-12
            value[w:] = np.maximum(value[w:], trial)
            took.append((i, k, w, better))
            k *= 2
    left, chosen = rooms.copy(), np.zeros((len(rooms), len(sizes)), np.int16)
    for i, k, w, better in reversed(took):
        hit = better[left]
        chosen[hit, i] += k
        left[hit] -= w
    return chosen


def best_fit(counts: np.ndarray, capacity: int, plan: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram (index: length): configurations and how often each is used.

    The free room of the sequences of `plan` is filled before new ones are opened. Sequences of equal content are filled
    together, so the work depends on the number of configurations and lengths and not on the number of pieces.
    """
    groups: dict[int, list] = {}
    rooms: list[int] = []

    def add(room: int, config: dict[int, int], times: int) -> None:
        if times > 0:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((config, times))

    for config, times in plan:
        add(capacity - sum(n * k for n, k in config.items()), config, times)
    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                config, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, config, times = capacity, {}, left
            k = min(room // n, left)
            m = min(times, left // k)
            add(room - n * k, config | {n: config.get(n, 0) + k}, m)
            if config:
                add(room, config, times - m)
            left -= m * k
    return [g for room in rooms for g in groups[room]]


def solved(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used, covering the histogram exactly.

    Each sequence holds at most one piece longer than half of it, so configurations are seeded by such a length (or by
    none). A round prices the shorter lengths by their size times a weight, one dynamic program gives every seed its
    dearest filling, and each seed takes 1/rounds of its demand in that configuration. Weights fall exponentially with
    what is covered beyond schedule. The fractional uses are rounded down; what is left is placed best-fit, into the free
    room of the planned sequences first. Where best-fit alone takes fewer sequences, its plan is returned.
    """
    left = counts.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        plan.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    long = np.flatnonzero(left[capacity // 2 + 1 :]) + capacity // 2 + 1
    short = np.flatnonzero(left[: capacity // 2 + 1])
    if len(short):
        spare = max(0.0, ((short * left[short]).sum() - ((capacity - long) * left[long]).sum()) / capacity)
        seeds, demand = np.append(long, 0), np.append(left[long].astype(float), spare)
        covered, used = np.zeros(len(short)), {}
        for t in range(rounds):
            prices = short / capacity * np.exp(-ETA * (covered / left[short] - t / rounds))
            fills = priced(prices, short, left[short], capacity - seeds, capacity)
            covered += fills.T.astype(float) @ (demand / rounds)
            for j, row in enumerate(fills):
                at = np.flatnonzero(row)
                key = (int(seeds[j]), tuple(zip(short[at].tolist(), row[at].tolist())))
                used[key] = used.get(key, 0.0) + demand[j] / rounds
        for (seed, items), x in used.items():
            config = dict(items) | ({seed: 1} if seed else {})
            whole = min([int(x), *(int(left[n] // k) for n, k in config.items())]) if config else 0
            if whole > 0:
                plan.append((config, whole))
                for n, k in config.items():
                    left[n] -= whole * k
    plain = best_fit(counts, capacity)
    plan = best_fit(left, capacity, plan)
    return min(plan, plain, key=lambda p: sum(times for _, times in p))


def slots(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """length, first (rank), copies, sequence, offset: copies run over ranks and sequences alike."""
    out, rank, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for n, k in sorted(config.items(), reverse=True):
            for _ in range(k):
                out.append((n, rank.get(n, 0), times, sequence, offset))
                rank[n] = rank.get(n, 0) + times
                offset += n
        sequence += times
    return pd.DataFrame(out, columns=["length", "first", "copies", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = common.saved(pieces(docs, path, id_col, text, capacity), "pieces")
    groups = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    groups = common.saved(groups.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece_groups")
    counts = np.zeros(capacity + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length up to capacity
        counts[r.length] = r.n
    places = slots(solved(counts, capacity))
    keys = places["length"].to_numpy(np.int64) * (1 << 48) + places["first"].to_numpy(np.int64)
    sequence, offset, first = (places[c].to_numpy(np.int64) for c in ("sequence", "offset", "first"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = (b["nth"] + b["base"]).to_numpy(np.int64)
            at = np.searchsorted(keys, b["length"].to_numpy(np.int64) * (1 << 48) + rank, "right") - 1
            b["sequence_id"], b["offset"] = sequence[at] + rank - first[at], offset[at]
            b["doc_id"] = b["doc_id"].astype("Int64")
            yield b[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    # both sides grow with the data, so neither may be broadcast: the join merges
    return cut.join(groups.select("part", "length", "base").hint("merge"), ["part", "length"]).mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
