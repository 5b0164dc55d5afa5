"""Near-duplicate vectors: coarse inverted lists, residual product codes, table-lookup distances over sufficient probes, exact cosines.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so the threshold is a distance. A list is probed if a vector within
that distance could lie in it; a code is passed over only if its distance, less what the code leaves out of its vector, exceeds it.
Neither loses a pair: what the index leaves out can't link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_io import batch, lists, release, tidy
from .near_dedup import components
from .staging import ship, stage

COSINE = 0.93
SAMPLE = 16384  # vectors that the index is fitted on, those of least hash
PARTS, CODES = 8, 64
SLACK = 1e-6  # far above what doubles lose in a distance of unit vectors
MEMBERS, QUERIES = 2048, 16384  # a share of a list, and a share of the queries that probe it
SALTS = 64


def lloyd(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centres, from evenly spaced points of ``points``."""
    centres = points[np.unique(np.linspace(0, len(points) - 1, min(k, len(points))).astype(int))].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        totals = np.zeros_like(centres)
        np.add.at(totals, own, points)
        counts = np.bincount(own, minlength=len(centres))
        centres[counts > 0] = totals[counts > 0] / counts[counts > 0, None]
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(points[a : a + 4096], centres).argmin(1) for a in range(0, len(points), 4096)]) if len(points) else np.zeros(0, np.int64)


@dataclass
class Index:
    """Centres of the lists, and a codebook for the residuals of each part of a vector. Shorter vectors are filled up with zeros."""

    centres: np.ndarray
    codebooks: list[np.ndarray]
    reach: float

    @classmethod
    def fitted(cls, unit: np.ndarray, lists: int, cosine: float) -> Index:
        centres = lloyd(unit, lists)
        rest = unit - centres[nearest(unit, centres)]
        return cls(centres, [lloyd(part, CODES) for part in np.array_split(rest, min(PARTS, unit.shape[1]), axis=1)], float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK)

    @cached_property
    def apart(self) -> np.ndarray:
        return np.sqrt(squares(self.centres, self.centres))

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, distance to its centre, code, length of what the code leaves out, and which lists each vector probes.

        A vector within reach of y whose list is c lies on c's side of the plane halfway between c and the centre
        nearest to y, so c is probed only if that plane is within reach of y.
        """
        distances = squares(unit, self.centres)
        own = distances.argmin(1)
        rest = unit - self.centres[own]
        parts = np.array_split(rest, len(self.codebooks), axis=1)
        codes = [nearest(part, book) for part, book in zip(parts, self.codebooks)]
        left = sum(((part - book[code]) ** 2).sum(1) for part, book, code in zip(parts, self.codebooks, codes))
        first = distances[np.arange(len(unit)), own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (distances - first[:, None]) / (2 * self.apart[own])
        probes = ~(plane > self.reach + SLACK)  # equal centres count as near
        return own, np.sqrt(first), np.stack(codes, 1).astype(np.uint8), np.sqrt(left), probes

    def tables(self, unit: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distance of each part of each query's residual to each code, for the list ``at``."""
        parts = np.array_split(unit - self.centres[at], len(self.codebooks), axis=1)
        return [squares(part, book) for part, book in zip(parts, self.codebooks)]


def as_unit(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, filled up to ``size``, and the same at length one."""
    whole = np.zeros((len(vectors), size))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    whole[np.arange(size) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    scaled = whole / np.abs(whole).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return whole, scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


ENCODED = "node long, kind string, weight long, embedding array<double>, list int, core boolean, code binary, rest double, probes array<int>"
_FIELDS = pa.schema([("node", pa.int64()), ("kind", pa.string()), ("weight", pa.int64()), ("embedding", pa.list_(pa.float64())), ("list", pa.int32()), ("core", pa.bool_()), ("code", pa.binary()), ("rest", pa.float64()), ("probes", pa.list_(pa.int32()))])


def _encoded(index: Index, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                given = whole.slice(a, 1024)
                _, unit = as_unit(given.column("embedding"), size)
                own, far, code, rest, probes = index.encode(unit)
                probes &= np.arange(len(index.centres)) >= own[:, None]  # the other way round the pair is found from the other side
                core = 2 * far <= index.reach - 3 * SLACK
                probes[np.arange(len(own)), own] = ~core  # two of a list's core always link; others look their own list through
                rows, columns = np.nonzero(probes)
                arrays = [given.column("node"), given.column("kind"), given.column("weight"), given.column("embedding"), own, core, [c.tobytes() for c in code], rest, lists(columns.astype(np.int32), np.bincount(rows, minlength=len(own)))]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, _FIELDS)], schema=_FIELDS)

    return run


LINKS = "node long, links long, other long"


def _rows(links: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*links)) if links else [[], [], []]
    return batch(LINKS, *map(list, columns))


def _searched(index: Index, size: int, cosine: float):
    """Rows come list share by list share, its members before the queries that probe it: for each vector the weight of what it links with, and as many links ``node, other`` as join all that are linked.

    Members are at most a share; queries stream past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, begun = None, [], False
        members: dict = {}

        def closed():
            return _rows([(int(n), int(c), None) for n, c in zip(members["node"], members["links"]) if c]) if begun and members else None

        def opened():
            rows = pa.Table.from_batches(held).combine_chunks()
            whole, unit = as_unit(rows.column("embedding").combine_chunks(), size)
            members.update(node=rows.column("node").to_numpy(), weight=rows.column("weight").to_numpy(), whole=whole, unit=unit, rest=rows.column("rest").to_numpy(), links=np.zeros(len(rows), np.int64), root=np.arange(len(rows)))
            members["code"] = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
            members["norm"] = np.sqrt((whole**2).sum(1))

        def asked(rows: pa.RecordBatch):
            at, core = rows.column("list")[0].as_py(), rows.column("core_share")[0].as_py()
            whole, unit = as_unit(rows.column("embedding"), size)
            near = np.zeros((len(whole), len(members["node"])))
            for table, code in zip(index.tables(unit, at), members["code"].T):
                near += table[:, code]
            possible = np.sqrt(near) <= index.reach + members["rest"] + SLACK
            nodes = rows.column("node").to_numpy()
            own = rows.column("own").to_numpy() == at
            if not core:  # a pair of outer members of one list is met from the larger node
                possible &= ~own[:, None] | (members["node"][None] < nodes[:, None])
            q, m = np.nonzero(possible)
            linked = np.zeros(len(q), bool)
            norms = np.sqrt((whole**2).sum(1))
            for a in range(0, len(q), 1 << 14):
                x, y = q[a : a + (1 << 14)], m[a : a + (1 << 14)]
                plain = norms[x] * members["norm"][y]
                safe = np.isfinite(plain) & (plain > 1e-200)
                with np.errstate(all="ignore"):
                    found = np.einsum("ij,ij->i", whole[x], members["whole"][y]) / plain
                linked[a : a + (1 << 14)] = np.where(safe, found, np.einsum("ij,ij->i", unit[x], members["unit"][y])) >= cosine
            q, m = q[linked], m[linked]
            weights = rows.column("weight").to_numpy()
            members["links"] += np.bincount(m, weights=weights[q], minlength=len(members["node"])).astype(np.int64)
            totals = np.bincount(q, weights=members["weight"][m], minlength=len(whole)).astype(np.int64)
            out = [(int(nodes[i]), int(totals[i]), None) for i in np.flatnonzero(totals)]
            ends = np.searchsorted(q, np.arange(len(whole) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                mine = m[ends[i] : ends[i + 1]]
                roots, first = np.unique(members["root"][mine], return_index=True)
                out += [(int(nodes[i]), 0, int(members["node"][x])) for x in mine[first]]
                if len(roots) > 1:
                    members["root"][np.isin(members["root"], roots)] = roots[0]
            return _rows(out)

        for given in batches:
            if not given.num_rows:
                continue
            marks = np.array([hash(k) for k in zip(*(given.column(c).to_pylist() for c in ("kind", "list", "core_share", "share", "part")))], np.int64)
            asks = given.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), given.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(given.column(c)[a].as_py() for c in ("kind", "list", "core_share", "share", "part"))
                if now != key:
                    last = closed()
                    if last is not None:
                        yield last
                    key, held, begun, members = now, [], False, {}
                if not asks[a]:
                    held.append(given.slice(a, b - a))
                    continue
                if not begun:
                    begun = True
                    if held:
                        opened()
                        held = []
                if members:
                    step = max(1, (1 << 19) // len(members["node"]))
                    for i in range(a, b, step):
                        yield asked(given.slice(i, min(step, b - i)))
        last = closed()
        if last is not None:
            yield last
        release()

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, kind, embedding`` of rows that can link; ``kind`` holds the label and the vector's length, and only equal kinds are compared."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.expr("vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)")
    return rows.where(fine).select("vec_id", F.concat_ws(":", F.size("embedding"), "label").alias("kind"), "embedding")


def fit(rows: DataFrame, many: int, size: int, cosine: float, sample: int = SAMPLE) -> Index:
    """An index of ``many`` lists at most, fitted on the ``sample`` rows of least hash."""
    chosen = rows.select(F.xxhash64("named").alias("h"), "embedding").orderBy("h", "embedding").limit(sample).select("embedding").toArrow()
    column = chosen.column("embedding").combine_chunks()
    _, unit = as_unit(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, size)
    return Index.fitted(unit, many, cosine)


def link_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``.

    Equal vectors of a kind stand for each other, the least vec_id for all. Each other vector looks through the lists
    it probes; members of a list that are within half the reach of its centre, its core, all link and are counted,
    not compared. A kind's lists have about half a share each, so that a query goes to few shares; there are 4096 at most. Lists and their queries are dealt out in shares, and a share's task gives sums and a spanning set of links, never
    its pairs.

    Vectors that are null, empty, zero, hold a component that is null or not finite, or have a null label link with
    nothing, nor do vectors of unlike length. Rows alike in all three columns are one vector. Rows of one vec_id with unlike vectors
    are vectors of their own. A null vec_id has a null component and is kept.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stage(usable(vectors).distinct(), "vectors")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    equal = salted.groupBy("kind", "embedding", "salt").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    nodes = equal.groupBy("kind", "embedding").agg(F.min("least").alias("named"), F.sum("many").alias("weight"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")  # numbered once, as it is written
    size, n, kinds = nodes.agg(F.max(F.size("embedding")), F.count("*"), F.count_distinct("kind")).first()
    if not n:
        own = F.col("vec_id").cast("long")
        return vectors.select(own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    index = fit(nodes, min(4096, max(8, 2 * n // (kinds * MEMBERS))), size, cosine, sample)
    return _linked(vectors, rows, nodes, index, size, cosine)


def _linked(vectors: DataFrame, rows: DataFrame, nodes: DataFrame, index: Index, size: int, cosine: float) -> DataFrame:
    encoded = stage(nodes.select("node", "kind", "weight", "embedding").mapInArrow(tidy(_encoded(index, size)), ENCODED), "coded-vectors")
    list_key = ["kind", "list", "core_share"]
    members = encoded.select("node", "kind", "weight", "embedding", "code", "rest", "list", F.col("core").alias("core_share"))
    asked = encoded.select("node", "kind", "list", F.explode("probes").alias("probed"))
    shares = members.groupBy(list_key).agg(F.ceil(F.count("*") / MEMBERS).alias("shares"))
    parts = asked.groupBy("kind", F.col("probed").alias("list")).agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    plan = stage(shares.join(parts, ["kind", "list"]), "list-shares")  # lists that are probed at all
    dealt = members.join(plan, list_key).withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("own", F.col("list")).withColumn("asks", F.lit(False))
    queries = encoded.select("node", "kind", "weight", "embedding", F.col("list").alias("own"), F.explode("probes").alias("list")).join(plan, ["kind", "list"])
    queries = queries.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    queries = queries.withColumn("asks", F.lit(True)).withColumn("code", F.lit(None).cast("binary")).withColumn("rest", F.lit(None).cast("double"))
    columns = ["kind", "list", "core_share", "share", "part", "asks", "node", "own", "weight", "embedding", "code", "rest"]
    met = dealt.select(columns).unionByName(queries.select(columns)).repartition("kind", "list", "core_share", "share", "part").sortWithinPartitions("kind", "list", "core_share", "share", "part", "asks")
    found = stage(met.mapInArrow(tidy(_searched(index, size, cosine)), LINKS), "vector-links")

    cores = encoded.where("core").groupBy("kind", "list").agg(F.sum("weight").alias("total"), F.min("node").alias("centre"))
    inside = encoded.where("core").select("node", "kind", "list", "weight").join(cores, ["kind", "list"])
    counted = inside.select("node", (F.col("total") - F.col("weight")).alias("links")).union(found.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).union(inside.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    grouped = components(edges)
    # a component is named by its least vec_id, whatever its nodes' numbers
    labelled = nodes.select("node", "kind", "embedding", "weight", "named").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = labelled.groupBy("component").agg(F.min("named").alias("component_id"))
    known = labelled.join(names, "component").join(counted, "node", "left").select("kind", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # equal vectors may be a third of all rows: each share of them gets its answer apart
    of_rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    held = of_rows.select("kind", "embedding", "salt").distinct().join(known, ["kind", "embedding"])
    answered = of_rows.join(held, ["kind", "embedding", "salt"]).select("vec_id", "kind", "embedding", "n_links", "component_id")
    return _answers(vectors, answered)


def _answers(vectors: DataFrame, answered: DataFrame) -> DataFrame:
    kind = F.concat_ws(":", F.size(F.col("embedding")), F.col("label").cast("string"))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), kind.alias("kind"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = given.join(answered, ["vec_id", "kind", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


LINKS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS MATERIALIZED (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}),
r(node, seen) AS (SELECT DISTINCT a, a FROM l UNION SELECT node, l.b FROM r JOIN l ON r.seen = l.a),
k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.node = e.vec_id"""
