"""Pairing of two readings of one thing, and orderings inside a document."""

from __future__ import annotations

from bisect import bisect_right
from heapq import heapify, heappop, heappush
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import overlap
from .grouped import by_group


def staged_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list[list[str]]) -> DataFrame:
    """``left_id, right_id, pass``: each pass joins what earlier ones left, on its columns, and only where a value names one row on both sides."""
    out = None
    for number, keys in enumerate(passes, 1):
        one_left = left.groupBy(*keys).agg(F.min(left_id).alias(left_id), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        one_right = right.groupBy(*keys).agg(F.min(right_id).alias(right_id), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        found = one_left.join(one_right, keys).select(left_id, right_id, F.lit(number).alias("pass"))
        left, right = left.join(found, left_id, "left_anti"), right.join(found, right_id, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def best_boxes(left: DataFrame, right: DataFrame, page: str, threshold: float = 0.5) -> DataFrame:
    """``page, left, right, iou``: boxes ``(page, id, x0, y0, x1, y1)`` paired greedily by overlap, each used once; of equal overlaps the least left comes first, then the least right.

    Boxes that lie alike are one place with several ids, and places are paired, not boxes; pages are shared out, and one page's places and ids at a time are held whole.
    """
    corners = ["x0", "y0", "x1", "y1"]
    at = lambda boxes, ids, s: boxes.where(F.col(page).isNotNull()).groupBy(page, *[F.col(c).alias(f"{s}{c}") for c in corners]).agg(F.array_sort(F.collect_set("id")).alias(ids))
    place = lambda s: F.array(*[F.col(f"{s}{c}") for c in corners]).alias(s)
    near = (F.col("ax0") < F.col("bx1")) & (F.col("bx0") < F.col("ax1"))
    a, b = at(left, "lefts", "a"), at(right, "rights", "b")
    met = a.drop("lefts").join(b.drop("rights"), page).where(near).withColumn("iou", overlap(*[F.col(f"{s}{c}") for s in "ab" for c in corners])).where((F.col("iou") >= threshold) & ~F.isnan("iou"))
    rows = met.select(page, place("a"), place("b"), "iou").unionByName(a.select(page, place("a"), "lefts"), allowMissingColumns=True).unionByName(b.select(page, place("b"), "rights"), allowMissingColumns=True)
    kind = lambda boxes, c: boxes.schema[c].dataType.simpleString()

    def greedy(rows: list[dict]) -> list[tuple]:
        lefts, rights = ({tuple(r[s]): list(r[ids]) for r in rows if r[ids] is not None} for s, ids in (("a", "lefts"), ("b", "rights")))
        met = [(r["iou"], tuple(r["a"]), tuple(r["b"])) for r in rows if r["lefts"] is None and r["rights"] is None]
        return [(rows[0][page], *found) for found in paired_places(lefts, rights, met)]

    return by_group(rows, [page], [], greedy, f"{page} {kind(left, page)}, left {kind(left, 'id')}, right {kind(right, 'id')}, iou double")


def paired_places(lefts: dict, rights: dict, met: list[tuple]) -> list[tuple]:
    """``left, right, iou``: ``met`` says which places overlap and by how much, ``lefts`` and ``rights`` which ids lie there, sorted. Gives what taking all pairs of ids one by one gives, by overlap from the greatest, left and right."""
    used: tuple[set, set] = (set(), set())
    at: tuple[dict, dict] = ({}, {})

    def least(side: int, place: tuple):
        """The least id of a place that isn't used; an id may lie in several places."""
        listed, i = (lefts, rights)[side][place], at[side].get(place, 0)
        while i < len(listed) and listed[i] in used[side]:
            i += 1
        at[side][place] = i
        return listed[i] if i < len(listed) else None

    out = []
    met = sorted(met, key=lambda m: -m[0])
    for iou, alike in groupby(met, key=lambda m: m[0]):
        beside: dict[tuple, list[tuple]] = {}
        for _, a, b in alike:
            beside.setdefault(a, []).append(b)
        queue = [(one, a) for a in beside if (one := least(0, a)) is not None]
        heapify(queue)
        while queue:
            one, a = heappop(queue)
            now = least(0, a)
            if now != one:  # taken from another place meanwhile
                if now is not None:
                    heappush(queue, (now, a))
                continue
            # an id in two places takes the least of all that either may have
            places = [a]
            while queue and queue[0][0] == one:
                places.append(heappop(queue)[1])
            for p in places:
                beside[p] = [b for b in beside[p] if least(1, b) is not None]
            free = [least(1, b) for p in places for b in beside[p]]
            if free:
                out.append((one, min(free), iou))
                used[0].add(one)
                used[1].add(min(free))
            for p in places:
                # where nothing is left to pair with, the place is done at this overlap; where one of its ids found nothing, the next may not either
                if beside[p] and (now := least(0, p)) is not None:
                    heappush(queue, (now, p))
    return out


def heaviest_run(values: list[float], weights: list[float]) -> list[int]:
    """Indexes of the non-decreasing subsequence of greatest weight: the best prefixes by last value, kept as a falling frontier."""
    keys: list[float] = []  # last values, rising, with rising totals
    best: list[tuple[float, int]] = []
    before = [-1] * len(values)
    for i, (v, w) in enumerate(zip(values, weights)):
        at = bisect_right(keys, v)
        total = w
        if at:
            total, before[i] = w + best[at - 1][0], best[at - 1][1]
        while at < len(keys) and best[at][0] <= total:
            keys.pop(at)
            best.pop(at)
        if not at or best[at - 1][0] < total:
            if at and keys[at - 1] == v:
                keys.pop(at - 1)
                best.pop(at - 1)
                at -= 1
            keys.insert(at, v)
            best.insert(at, (total, i))
    out, i = [], best[-1][1] if best else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def ordered_headings(headings: DataFrame, doc: str, place: str, number: str, weight: str) -> DataFrame:
    """The rows of each document that the heaviest rising run of heading numbers keeps."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in headings.schema)
    keep = lambda rows: [tuple(rows[i].values()) for i in heaviest_run([r[number] for r in rows], [r[weight] for r in rows])]
    return by_group(headings, [doc], [place], keep, schema)
