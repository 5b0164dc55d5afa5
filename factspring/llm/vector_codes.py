"""Product codes of vectors by Yinyang Lloyd rounds in whole numbers.

Vectors become integers and are cut into equal parts, each with a codebook of its own. Entries of a codebook are put
into groups; each part of a vector keeps an upper bound of the distance to its entry and one lower bound for each
group. A round lets bounds drift with the entries and scans only groups whose bound fails; what is scanned is compared
in whole numbers, ties to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_io import batch, tidy
from .staging import discard, ship, stage

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
LIMIT = 1 << 28  # integers from here on could leave 64 bits when squared and summed
SLACK = 1e-9  # of each bound, more than doubles lose in a round


def grouped(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A group for each entry: a few Lloyd rounds over the entries, from seeds far apart."""
    points = entries.astype(np.float64)
    seeds = [0]
    while len(seeds) < min(groups, len(points)):
        seeds.append(int(((points[:, None] - points[seeds]) ** 2).sum(2).min(1).argmax()))
    centres = points[seeds]
    for _ in range(5):
        own = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([points[own == g].mean(0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return own


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each point to each entry."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - entries[None, :, d]) ** 2
    return out


class Bounds:
    """The entry of each point of one part, with what is known of its distances. ``scanned`` counts point-to-entry distances that were computed."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.own, self.upper, self.lower, self.scanned = own, upper, lower, 0

    @classmethod
    def unknown(cls, n: int, groups: int) -> Bounds:
        return cls(np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, groups)))

    def drift(self, old: np.ndarray, new: np.ndarray, group: np.ndarray) -> None:
        """Entries moved from ``old`` to ``new``: bounds give way by as much."""
        moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        self.upper = (self.upper + moved[self.own]) * (1 + SLACK)
        most = np.array([moved[group == g].max(initial=0) for g in range(self.lower.shape[1])])
        self.lower = np.maximum(self.lower - most, 0) * (1 - SLACK)

    def assign(self, points: np.ndarray, entries: np.ndarray, group: np.ndarray) -> None:
        """The nearest entry of each point, of equals the lowest index. Only a bound that is strictly above what it is compared with saves a scan, so equal distances are always seen."""
        at = np.flatnonzero(self.upper >= self.lower.min(1))
        exact = ((points[at] - entries[self.own[at]]) ** 2).sum(1)
        self.upper[at] = np.sqrt(exact) * (1 + SLACK)
        open_ = self.lower[at] <= self.upper[at, None]
        some = open_.any(1)
        at, exact, open_ = at[some], exact[some], open_[some]
        was, best, index = self.own[at], exact.copy(), self.own[at].copy()
        nearest = []
        for g in range(self.lower.shape[1]):
            rows, members = np.flatnonzero(open_[:, g]), np.flatnonzero(group == g)
            distances = squared(points[at[rows]], entries[members])
            self.scanned += distances.size
            nearest.append((rows, members, distances))
            if not len(members) or not len(rows):
                continue
            column = distances.argmin(1)  # members ascend, so the first of equals is the lowest
            found, name = distances[np.arange(len(rows)), column], members[column]
            better = (found < best[rows]) | (found == best[rows]) & (name < index[rows])
            best[rows[better]], index[rows[better]] = found[better], name[better]
        for g, (rows, members, distances) in enumerate(nearest):
            if len(rows) and len(members):
                others = np.where(members[None] == index[rows, None], np.iinfo(np.int64).max, distances).min(1)
                self.lower[at[rows], g] = np.sqrt(others) * (1 - SLACK)
            elif len(rows):
                self.lower[at[rows], g] = np.inf
            left = np.flatnonzero((group[was] == g) & (index != was) & ~open_[:, g])  # an entry given up in a group that wasn't scanned
            self.lower[at[left], g] = np.minimum(self.lower[at[left], g], np.sqrt(exact[left]) * (1 - SLACK))
        self.own[at], self.upper[at] = index, np.sqrt(best) * (1 + SLACK)


#: Rows of vectors have ``sums`` null; each task adds a row of its own with the sums and counts for the next entries.
STATE_SCHEMA = "vec_id long, label string, parts binary, own binary, upper binary, lower binary, error long, sums binary"


def _integers(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The integer vectors of those rows that have one, and which rows these are."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    lengths = np.where(vectors.is_null().to_numpy(zero_copy_only=False), -1, lengths)
    right = np.flatnonzero(lengths == size)
    kept = vectors.take(pa.array(right))
    values = kept.flatten()
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(right), size)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = flat * SCALE
        good = (np.abs(scaled) < LIMIT).all(1)  # false for NaN and infinity too
    return np.floor(scaled[good]).astype(np.int64), right[good]


def _round(codebooks: list[list[np.ndarray]], groups: list[np.ndarray], size: int, first: bool):
    """One assignment of all parts under the last of the codebooks given; ``codebooks[-2]`` are those of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = size // PARTS
        new = codebooks[-1]
        entries = len(new[0])
        totals, counts = np.zeros((PARTS, entries, wide), np.int64), np.zeros((PARTS, entries), np.int64)
        for given in batches:
            if first:
                whole, rows = _integers(given.column("embedding"), size)
                ids, labels = given.column("vec_id").take(pa.array(rows)), given.column("label").take(pa.array(rows))
                states = [Bounds.unknown(len(whole), int(g.max(initial=0)) + 1) for g in groups]
            else:
                ids, labels, n = given.column("vec_id"), given.column("label"), given.num_rows
                read = lambda name, kind, n=n, given=given: np.frombuffer(b"".join(given.column(name).to_pylist()), kind).reshape(n, -1)
                whole = read("parts", np.int32).astype(np.int64)
                own, upper, lower = read("own", np.uint8).astype(np.int64), read("upper", np.float64).copy(), read("lower", np.float64).copy()
                ends = np.cumsum([0, *(int(g.max()) + 1 for g in groups)])
                states = [Bounds(own[:, p].copy(), upper[:, p].copy(), lower[:, a:b].copy()) for p, (a, b) in enumerate(zip(ends, ends[1:]))]
            error = np.zeros(len(whole), np.int64)
            for p, state in enumerate(states):
                points = whole[:, p * wide : (p + 1) * wide]
                if not first:
                    state.drift(codebooks[-2][p], new[p], groups[p])
                state.assign(points, new[p], groups[p])
                error += ((points - new[p][state.own]) ** 2).sum(1)
                counts[p] += np.bincount(state.own, minlength=entries)
                for d in range(wide):
                    np.add.at(totals[p, :, d], state.own, points[:, d])
            if len(whole):
                pieces = lambda rows: [r.tobytes() for r in rows]
                own = np.stack([s.own for s in states], 1).astype(np.uint8)
                yield batch(STATE_SCHEMA, ids, labels, pieces(whole.astype(np.int32)), pieces(own), pieces(np.stack([s.upper for s in states], 1)), pieces(np.concatenate([s.lower for s in states], 1)), error, [None] * len(whole))
        if counts.any():
            yield batch(STATE_SCHEMA, *[[None]] * 7, [np.concatenate([totals.ravel(), counts.ravel()]).tobytes()])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's rows as rows ``place, total``."""
    total = None
    for given in batches:
        for row in given.column("sums").to_pylist():
            own = np.frombuffer(row, np.int64)
            total = own if total is None else total + own
    if total is not None:
        yield batch("place long, total long", np.arange(len(total)), total)


def _moved(state: DataFrame, codebook: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry at the floor of the mean of its parts; entries without any stay. A row for each component reaches the driver, whatever the table's size."""
    entries, wide = codebook[0].shape
    summed = state.where("sums is not null").select("sums").mapInArrow(_summed, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(PARTS * entries * (wide + 1), np.int64)
    for r in summed:
        flat[r["place"]] = r["total"]
    totals, counts = flat[: PARTS * entries * wide].reshape(PARTS, entries, wide), flat[PARTS * entries * wide :].reshape(PARTS, entries, 1)
    return [np.where(n > 0, t // np.maximum(n, 1), c) for t, n, c in zip(totals, counts, codebook)]


RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def encode_vectors(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row of ``vec_id, embedding, label`` that can be coded.

    Rows go whose vector is null, empty, of another length than that of the first vec_id (a length that 8 does not
    divide leaves none), or holds a component that is null, not finite or 2**16 and over, whose squares would leave
    64 bits. Repeated rows are coded each; of equal vec_ids the least vector comes first among the seeds. Fewer than 16 rows make so
    many entries. Null labels are a label of their own; a null vec_id is coded like others but seeds last. The labels' sums are the only join, on a null-safe key.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.expr(f"size(embedding) > 0 and forall(embedding, x -> x is not null and abs(x * {SCALE}) < {LIMIT})")
    usable = rows.where(fine)
    head = usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("n")).limit(1).collect()
    size = head[0]["n"] if head else 0
    if not size or size % PARTS:
        return spark.createDataFrame([], RESULT)
    seeds = usable.where(F.size("embedding") == size).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(ENTRIES).collect()
    start = np.floor(np.array([r["embedding"] for r in seeds], np.float64) * SCALE).astype(np.int64)
    codebooks = [[start[:, p : p + size // PARTS].copy() for p in range(0, size, size // PARTS)]]
    groups = [grouped(c) for c in codebooks[0]]
    given, state = rows.select("vec_id", "embedding", "label"), None
    for n in range(rounds + 1):
        before, state = state, stage(given.mapInArrow(tidy(_round(codebooks[-2:], groups, size, n == 0)), STATE_SCHEMA), "vector-codes")
        if before is not None:
            discard(before)
        given = state.where("sums is null")
        if n < rounds:
            codebooks.append(_moved(state, codebooks[-1]))
    final = state.where("sums is null").select("vec_id", "label", F.lower(F.hex("own")).alias("code"), "error")
    digest = hashlib.sha256(",".join(str(x) for part in codebooks[-1] for x in part.ravel().tolist()).encode()).hexdigest()
    by_label = final.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = final.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, every distance computed, over tables whose vectors have one length."""
    parts = f"""v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, label, k, e[k * len(e) // {PARTS} + 1:(k + 1) * len(e) // {PARTS}] AS x FROM v, (SELECT unnest(range({PARTS})) AS k)),
c0 AS MATERIALIZED (SELECT k, r - 1 AS j, x AS c FROM p WHERE r <= {ENTRIES})"""
    steps = [parts]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, p.k, x, j, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM p JOIN c{n} ON p.k = c{n}.k)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, k, any_value(x) AS x, min((d, j)) AS m FROM d{n} GROUP BY r, k)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT k, m[2] AS j, i, sum(x[i]) AS t, count(*) AS n FROM a{n}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY ALL)")
            steps.append(f"m{n} AS (SELECT k, j, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY k, j)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.k, c{n}.j, coalesce(m{n}.c, c{n}.c)::BIGINT[] AS c FROM c{n} LEFT JOIN m{n} ON c{n}.k = m{n}.k AND c{n}.j = m{n}.j)")
    steps.append(f"o AS (SELECT r, string_agg(lpad(lower(to_hex(m[2])), 2, '0'), '' ORDER BY k) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, j)) AS h FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN o USING (r), h"
