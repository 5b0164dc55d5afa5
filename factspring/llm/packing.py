"""Packing of token sequences by linear grouping.

Only how many pieces have each length matters, so the plan is made from that histogram: at most ``capacity`` numbers,
whatever the corpus. Large lengths are grouped by equal numbers of pieces and rounded up to their group's largest; a
linear programme over configurations of these few sizes (columns generated by a knapsack) says how often each is used;
actual pieces take the places of rounded ones; what is left and the small ones go where they fit best. A plan is a list
of runs: the pieces of one length with ranks r, r + 1, ... go to sequences s, s + 1, ... at one offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .arrow_io import batch, tidy, utf8
from .staging import ship, stage

CAPACITY, END_ID = 1024, 2
GROUPS = 128  # rounded sizes at most
SMALL = (1 / 16, 1 / 4, 1 / 2)  # of the capacity: pieces up to this length are placed after the others; the best plan counts

Run = tuple[int, int, int, int, int]  # length, first rank, pieces, first sequence, offset


def _fullest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth: an unbounded knapsack."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    small, value = sizes[order], worth[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(small, c, "right")
        if k:
            gain = best[c - small[:k]] + value[:k]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], pick[c] = gain[i], order[i]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, within ``gap`` of the optimum of the linear programme (by Farley's bound; after ``rounds`` steps any feasible point)."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use = inverse @ demand
        worth, column = _fullest(sizes, np.maximum(inverse.sum(0), 0), capacity)
        if worth <= 1 + gap:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, demand)
    return [(basis[:, i].astype(np.int64), max(0.0, float(use[i]))) for i in range(k)]


class _Pieces:
    """Pieces of each length, handed out by rank."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.next = dict(counts), defaultdict(int)

    def take(self, length: int, n: int) -> int:
        rank = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        return rank


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """The plan with the fewest sequences over the thresholds ``SMALL``; none is better than the bytes' bound."""
    best, least = None, -(-sum(k * n for k, n in counts.items()) // capacity)
    for small in reversed(SMALL):
        made = plan(counts, capacity, small=small)
        best = made if best is None or made[1] < best[1] else best
        if best[1] == least:
            break
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL[0]) -> tuple[list[Run], int]:
    """Runs that place all pieces of a histogram {length: pieces}, and the number of sequences."""
    pieces, runs, bins = _Pieces({k: n for k, n in counts.items() if n}), [], 0
    large = sorted((k for k in pieces.left if k > small * capacity), reverse=True)
    total = sum(pieces.left[k] for k in large)
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs of sequences
    if total:
        each, seen = max(1, -(-total // groups)), 0
        members: dict[int, dict[int, int]] = {}  # rounded size: pieces by actual length
        for k in large:
            left = pieces.left[k]
            while left:
                n = min(left, each - seen % each)
                if seen % each == 0 and k not in members:
                    top = k
                    members[top] = defaultdict(int)
                members[top][k] += n
                seen += n
                left -= n
        sizes = np.array(sorted(members, reverse=True))
        demand = np.array([sum(members[s].values()) for s in sizes], float)
        stock = {s: [[k, n] for k, n in sorted(members[s].items(), reverse=True)] for s in members}
        for config, use in configurations(sizes, demand, capacity):
            n = int(use + 1e-9)
            if not n:
                continue
            spans = [(bins, n, 0)]  # first sequence, sequences, used
            bins += n
            for i in np.flatnonzero(config):
                for _ in range(config[i]):
                    own, filled = stock[sizes[i]], []
                    for first, many, used in spans:
                        while many and own:
                            k, have = own[-1]
                            m = min(many, have)
                            runs.append((k, pieces.take(k, m), m, first, used))
                            filled.append((first, m, used + k))
                            own[-1][1] -= m
                            if not own[-1][1]:
                                own.pop()
                            first, many = first + m, many - m
                        if many:
                            filled.append((first, many, used))
                    spans = filled
            for first, many, used in spans:
                free[capacity - used].append((first, many))
    rooms = sorted(free)
    for k in sorted(pieces.left, reverse=True):
        while left := pieces.left[k]:
            at = bisect_left(rooms, k)
            if at == len(rooms):  # new sequences, each filled with as many as fit
                fit = capacity // k
                full, rest = divmod(left, fit)
                n, fit = (full, fit) if full else (1, rest)
                for i in range(fit):
                    runs.append((k, pieces.take(k, n), n, bins, i * k))
                room, first = capacity - fit * k, bins
                bins += n
            else:
                room = rooms[at]
                first, many = free[room].pop()
                n = min(left, many)
                if many > n:
                    free[room].append((first + n, many - n))
                if not free[room]:
                    rooms.pop(at)
                runs.append((k, pieces.take(k, n), n, first, capacity - room))
                room -= k
            if room not in free or not free[room]:
                rooms.insert(bisect_left(rooms, room), room)
            free[room].append((first, n))
    return runs, bins


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = byte_bpe.shared(path), TaskContext.get().partitionId()
        for given in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(given.column("doc_id").to_pylist(), utf8(given.column("text"))):
                ids = np.array([*encoder.encode(text.decode("utf-8", "replace")), END_ID], "<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(rows, (doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(value)
            yield batch(PIECE_SCHEMA, *rows, [task] * len(rows[0]))

    return run


def _placed(runs: list[Run]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rank = given.column("rank").to_numpy()
            at = np.searchsorted(keys, (given.column("length").to_numpy() << 48) + rank, "right") - 1
            own = table[at] if len(table) else np.zeros((0, 5), np.int64)
            yield batch(PACKED_SCHEMA, *(given.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), own[:, 3] + rank - own[:, 1], own[:, 4])

    return run


PACKED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row's text.

    A null text counts as empty: its one piece is the end id. Repeated rows and rows with a null doc_id are packed each. The ranks that the plan speaks of are a piece's
    place among those of its length: by task of the tokenising job, then by document and piece.
    """
    ship(docs.sparkSession)
    pieces = stage(docs.select("doc_id", "text").mapInArrow(tidy(_cut(path, capacity)), PIECE_SCHEMA), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length up to the capacity
    runs, _ = best_plan(counts, capacity)
    by_task = pieces.groupBy("length", "task").count()
    before = by_task.select("length", "task", (F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")).alias("_before"))
    inside = Window.partitionBy("length", "task").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("_row", F.row_number().over(inside)).join(before, ["length", "task"]).withColumn("rank", F.col("_before") + F.col("_row") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(runs), PACKED_SCHEMA)
