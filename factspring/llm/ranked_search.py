"""Ranked lexical search over a tiered index.

A posting's strength is its document's share of the term's weight. High tiers hold each term's strongest postings, and
a bound of what is left out; the lowest is whole. An item is answered from a tier if that tier proves its best
documents: no document that the tier doesn't hold can reach the k-th score seen, and of those that can their whole rows are read. Other items fall through to the next.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_io import batch, lists, tidy, utf8
from .staging import discard, ship, stage

BEST = 50
QUOTAS = (4, 64)  # postings of a term in the tiers above the lowest, in multiples of the documents asked for
STEPS, TOP = 256, 1_000_000  # strengths lie below TOP; tiers are cut at multiples of TOP / STEPS
VOCABULARY = 16384  # terms of the items that are answered together
CANDIDATES = 80  # whole rows read for an item, in multiples of the documents asked for; an item with more falls through
SMALL = 1_000_000  # candidates that are broadcast
TILE = 1 << 20

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order, a tile at a time: runs of letters and digits of ASCII and of all else beyond it, A-Z in lower case."""
    data, at = data.translate(_TERM), 0
    while at < len(data):
        end = data.find(b" ", at + TILE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for given in batches:
        for item, text in zip(given.column("item_id").to_pylist(), utf8(given.column("text"))):
            words = {w for part in terms_of(text) for w in part}
            yield batch("item_id long, term string", [item] * len(words), [w.decode() for w in words])


ROWS = "doc_id long, n long, terms array<int>, counts array<int>"
_ROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _counted(number: dict[bytes, int]):
    """Of each text with terms the number of all, and how often it has each of those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            docs, totals, terms, counts, sizes = [], [], [], [], []
            for doc, text in zip(given.column("doc_id").to_pylist(), utf8(given.column("text"))):
                n, own = 0, Counter()
                for part in terms_of(text):
                    n += len(part)
                    own.update(filter(number.__contains__, part))
                if n:
                    docs.append(doc)
                    totals.append(n)
                    terms += map(number.__getitem__, own)
                    counts += own.values()
                    sizes.append(len(own))
            columns = [pa.array(docs, pa.int64()), pa.array(totals, pa.int64()), lists(np.array(terms, np.int32), np.array(sizes, np.int64)), lists(np.array(counts, np.int32), np.array(sizes, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=_ROW)

    return run


@dataclass
class Postings:
    """The postings of a batch of documents: place of the document in the batch, term, strength."""

    docs: np.ndarray
    place: np.ndarray
    term: np.ndarray
    strength: np.ndarray

    @classmethod
    def of(cls, rows: pa.RecordBatch, many: int, length: int) -> Postings:
        counts, terms = rows.column("counts"), rows.column("terms")
        place = np.repeat(np.arange(rows.num_rows), counts.value_lengths().to_numpy(zero_copy_only=False))
        tf = counts.flatten().to_numpy().astype(np.int64)
        m = 50 + 50 * rows.column("n").to_numpy() * many // length
        return cls(rows.column("doc_id").to_numpy(zero_copy_only=False), place, terms.flatten().to_numpy(), 1_000_000_000 * tf // (1000 * tf + 20 * m[place]))

    def sorted(self) -> Postings:
        order = np.argsort(self.term, kind="stable")
        return Postings(self.docs, self.place[order], self.term[order], self.strength[order])


def _strengths(many: int, length: int, vocabulary: int):
    """How many postings of each term lie in each step of strength."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary * STEPS, np.int64)
        for given in batches:
            own = Postings.of(given, many, length)
            total += np.bincount(own.term.astype(np.int64) * STEPS + own.strength * STEPS // TOP, minlength=len(total))
        some = np.flatnonzero(total)
        yield batch("step long, many long", some, total[some])

    return run


TIERED = "tier int, docs binary, place binary, term binary, strength binary"


def _tiered(many: int, length: int, cuts: list[np.ndarray]):
    """A row for each batch of documents and each tier: its postings in order of terms. A tier holds those above it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            own = Postings.of(given, many, length).sorted()
            for tier, cut in enumerate(cuts):
                held = own.strength >= cut[own.term]
                if held.any():
                    yield batch(TIERED, [tier], [own.docs.astype(np.int64).tobytes()], [own.place[held].astype(np.int32).tobytes()], [own.term[held].astype(np.int32).tobytes()], [own.strength[held].astype(np.int32).tobytes()])

    return run


def _stored(given: pa.RecordBatch) -> Iterator[Postings]:
    for row in given.to_pylist():
        yield Postings(np.frombuffer(row["docs"], np.int64), np.frombuffer(row["place"], np.int32), np.frombuffer(row["term"], np.int32), np.frombuffer(row["strength"], np.int32).astype(np.int64))


@dataclass
class Asked:
    """Items as the numbers of their terms, with each term's weight and what a posting outside the tier can add at most."""

    items: list[int]
    terms: list[np.ndarray]
    weights: np.ndarray
    rest: np.ndarray

    def unseen(self) -> np.ndarray:
        """What a document outside the tier can score at most, by item."""
        return np.array([int(self.rest[t].sum()) for t in self.terms], np.int64)

    def scores(self, own: Postings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each item the documents of a batch that the tier gives a score: place, score so far, and what may be missing at most."""
        begin, end = np.searchsorted(own.term, np.arange(len(self.weights)), "left"), np.searchsorted(own.term, np.arange(len(self.weights)), "right")
        gain, seen = self.weights[own.term] * own.strength, self.rest[own.term]
        whole = not self.rest.any()
        for i, (terms, unseen) in enumerate(zip(self.terms, self.unseen())):
            score, known = np.zeros(len(own.docs), np.int64), np.zeros(len(own.docs), np.int64)
            for a, b in zip(begin[terms].tolist(), end[terms].tolist()):
                if a < b:
                    score[own.place[a:b]] += gain[a:b]
                    if not whole:
                        known[own.place[a:b]] += seen[a:b]
            at = np.flatnonzero(score)
            if len(at):
                yield i, at, score[at], unseen - known[at]


FOUND = "item_id long, doc_id long, score long"


def _best(asked: Asked, k: int, read):
    """The ``k`` best documents of each item among those a task reads, by what the tier gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for given in batches:
            for own in read(given):
                for i, at, score, _ in asked.scores(own):
                    docs = own.docs[at]
                    if i in best:
                        held, least = best[i], best[i][1][-1] if len(best[i][1]) == k else 0
                        some = score >= least
                        docs, score = np.concatenate([held[0], docs[some]]), np.concatenate([held[1], score[some]])
                    if len(score) > k:
                        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                        docs, score = docs[some], score[some]
                    order = np.lexsort((docs, -score))[:k]
                    best[i] = docs[order], score[order]
        if best:
            yield batch(FOUND, np.repeat([asked.items[i] for i in best], [len(d) for d, _ in best.values()]), np.concatenate([d for d, _ in best.values()]), np.concatenate([s for _, s in best.values()]))

    return run


def _able(asked: Asked, floors: np.ndarray, read):
    """Documents that could reach an item's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for own in read(given):
                for i, at, score, missing in asked.scores(own):
                    docs = own.docs[at[score + missing >= floors[i]]]
                    yield batch("item_id long, doc_id long", np.full(len(docs), asked.items[i]), docs)

    return run


def _rescored(asked: Asked, many: int, length: int):
    """The whole scores of documents for the items that name them."""
    at = {item: i for i, item in enumerate(asked.items)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            own = Postings.of(given, many, length)
            gain = asked.weights[own.term] * own.strength
            ends = np.searchsorted(own.place, np.arange(given.num_rows + 1))
            out = []
            for row, (doc, items) in enumerate(zip(own.docs.tolist(), given.column("items").to_pylist())):
                a, b = ends[row], ends[row + 1]
                for item in items:
                    out.append((item, doc, int(gain[a:b][np.isin(own.term[a:b], asked.terms[at[item]])].sum())))
            yield batch(FOUND, *(map(list, zip(*out)) if out else [[], [], []]))

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of each item, first in shares of its documents."""
    order = [F.col("score").desc(), F.col("doc_id")]
    shared = found.withColumn("_share", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = shared.withColumn("_n", F.row_number().over(Window.partitionBy("item_id", "_share").orderBy(*order))).where(F.col("_n") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


@dataclass
class Tier:
    cut: np.ndarray  # least strength of a posting in the tier, by term
    rest: np.ndarray  # what a posting outside can add at most


def tiers(steps: np.ndarray, weights: np.ndarray, quotas: list[int]) -> list[Tier]:
    """For each quota the steps, from the strongest down, that hold no more postings of a term, and the strongest that holds any at least."""
    above = steps[:, ::-1].cumsum(1)[:, ::-1]  # postings of a step and all stronger ones
    strongest = STEPS - 1 - (steps[:, ::-1] > 0).argmax(1)
    out = []
    for quota in quotas:
        step = np.minimum((above > quota).sum(1), strongest)
        cut = -(-step * TOP // STEPS)
        out.append(Tier(cut, weights * np.maximum(cut - 1, 0)))
    return out


def _answer(docs: DataFrame, asked_terms: DataFrame, k: int) -> DataFrame:
    """The answers to a set of items whose terms fit into memory."""
    terms = asked_terms.toArrow()
    vocabulary = sorted(set(terms.column("term").to_pylist()))
    number = {t: i for i, t in enumerate(vocabulary)}
    by_item: dict[int, list[int]] = {}
    for item, term in zip(terms.column("item_id").to_pylist(), terms.column("term").to_pylist()):
        by_item.setdefault(item, []).append(number[term])
    rows = stage(docs.select("doc_id", "text").mapInArrow(tidy(_counted({t.encode(): i for t, i in number.items()})), ROWS), "term-counts")
    many, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = rows.where("doc_id is not null and size(terms) > 0")
    counted = named if not many else rows.where("size(terms) > 0").mapInArrow(_strengths(many, length, len(vocabulary)), "step long, many long").groupBy("step").agg(F.sum("many").alias("many"))
    if not many or not vocabulary:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")
    found = counted.toArrow()
    steps = np.zeros(len(vocabulary) * STEPS, np.int64)
    steps[found.column("step").to_numpy()] = found.column("many").to_numpy()
    steps = steps.reshape(-1, STEPS)
    weights = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * int(df) + 1))) for df in steps.sum(1)], np.int64)
    levels = tiers(steps, weights, [q * k for q in QUOTAS])
    index = stage(named.mapInArrow(tidy(_tiered(many, length, [t.cut for t in levels])), TIERED), "tiered-index")

    def asked(items: list[int], rest: np.ndarray) -> Asked:
        return Asked(items, [np.array(by_item[i], np.int64) for i in items], weights, rest)

    left, answers = sorted(by_item), []
    for level, tier in enumerate(levels):
        if not left:
            break
        held, own = index.where(F.col("tier") == level), asked(left, tier.rest)
        top = stage(ranked(held.mapInArrow(tidy(_best(own, k, _stored)), FOUND), k), "best-of-tier")
        floor = {r["item_id"]: (r["least"], r["n"]) for r in top.groupBy("item_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).collect()}
        unseen = dict(zip(left, own.unseen().tolist()))
        whole = {i for i in left if unseen[i] == 0}  # the tier has all postings of all its terms
        able = [i for i in left if i not in whole and floor.get(i, (0, 0))[1] == k and unseen[i] < floor[i][0]]
        proven = set(whole)
        if whole:
            answers.append(top.where(F.col("item_id").isin(sorted(whole))).withColumn("tier", F.lit(level)))
        if able:
            some = asked(able, tier.rest)
            reach = stage(held.mapInArrow(tidy(_able(some, np.array([floor[i][0] for i in able], np.int64), _stored)), "item_id long, doc_id long").distinct(), "able")
            sizes = {r["item_id"]: r["count"] for r in reach.groupBy("item_id").count().collect()}
            sure = [i for i in able if sizes[i] <= CANDIDATES * k]
            proven |= set(sure)
            if sure:
                wanted = reach.where(F.col("item_id").isin(sure)).groupBy("doc_id").agg(F.collect_list("item_id").alias("items"))  # a document has each item once
                wanted = F.broadcast(wanted) if sum(sizes[i] for i in sure) <= SMALL else wanted
                exact = named.join(wanted, "doc_id").mapInArrow(tidy(_rescored(asked(sure, tier.rest), many, length)), FOUND)
                answers.append(ranked(exact, k).withColumn("tier", F.lit(level)))
        left = [i for i in left if i not in proven]
    if left:
        own = asked(left, np.zeros(len(vocabulary), np.int64))
        everything = named.mapInArrow(tidy(_best(own, k, lambda given: [Postings.of(given, many, length).sorted()])), FOUND)
        answers.append(ranked(everything, k).withColumn("tier", F.lit(len(levels))))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out.where("score > 0").select("item_id", "rank", "doc_id", "score", "tier")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score, tier``: the ``k`` highest-scoring rows of ``docs`` for each item; ``tier`` is that of the index that gave the answer, the lowest being the whole.

    Rows of one item_id are one item, with the terms of all. Null and empty texts have no terms: such documents aren't counted, such items have
    no rows, nor have those with a null id. Rows with one doc_id are documents each. A document with a null doc_id counts in the statistics but can't be named. Equal scores
    rank by doc_id. Items are answered in sets of about ``VOCABULARY`` terms, each over all documents; a set's terms and items are held by every task.
    """
    ship(docs.sparkSession)
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    terms = stage(texts.mapInArrow(_item_terms, "item_id long, term string").distinct(), "item-terms")
    sets = max(1, -(-terms.select("term").distinct().count() // VOCABULARY))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for n in range(sets):
        answer = _answer(given, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == n), k)
        out = answer if out is None else out.unionByName(answer)
    discard(terms)
    return out


SEARCH_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS many, sum(n)::BIGINT AS length FROM d),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * many + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, many),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, r, sum(w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * many // length))))::BIGINT AS score FROM i JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY item_id, r),
o AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM q JOIN d USING (r) WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50"""
