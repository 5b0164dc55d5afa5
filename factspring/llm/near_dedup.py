"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

A document is its set of distinct 5-word shingles. Two permutations of a 32-bit universe make all signature
coordinates: the first scatters the shingles once, the second is applied after a circular shift by k for coordinate k.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_io import batch, lists, tidy, utf8
from .bytehash import Prefix, U, mix
from .staging import ship, stage

WORDS = 5
ROWS, BANDS = 5, 50  # a pair of similarity 0.75 shares no band with probability (1 - 0.75**5)**50, about 1e-6
SIMILARITY = 75  # per cent
TILE = 1 << 19

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = mix(np.arange(1, 33, dtype=U)) | U(1)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of one run of bytes."""
    codes = np.frombuffer(data.translate(_LOWER), np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_SPACE[codes]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Prefix(codes).hash(start, end), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one text after another, and the number of each text's words."""
    if len(texts) == 1 and len(texts[0]) > TILE:  # in pieces that end at white space
        text, out, at = texts[0], [], 0
        while at < len(text):
            end = min(len(text), at + TILE)
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            out.append(_word_hashes(text[at:end])[0])
            at = end
        hashes = np.concatenate(out)
        return hashes, np.array([len(hashes)])
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, start = _word_hashes(b" ".join(texts))
    return hashes, np.diff(np.searchsorted(start, begin))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their numbers.

    A text of fewer words is one shingle, a text without words none.
    """
    hashes, counts = word_hashes(texts)
    n = max(0, len(hashes) - words + 1)
    full = np.zeros(n, U)
    for j in range(words):
        full += hashes[j : j + n] * _ODD[j]
    full = mix(full)
    out, sizes = [], []
    at = 0
    for c in counts.tolist():
        if c >= words:
            own = np.unique(full[at : at + c - words + 1])
        elif c:
            own = mix(np.array([sum(int(h) * int(o) for h, o in zip(hashes[at : at + c], _ODD[words:])) + c & (1 << 64) - 1], U))
        else:
            own = full[:0]
        out.append(own)
        sizes.append(len(own))
        at += c
    return np.concatenate(out) if out else full[:0], np.array(sizes, np.int64)


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """One row of ``length`` coordinates for each set, none of which may be empty."""
    scattered = _permute((shingles ^ shingles >> U(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    lead = np.cumsum(sizes) - sizes
    out = np.empty((length, len(sizes)), np.uint32)
    for k in range(length):
        out[k] = np.minimum.reduceat(_permute(scattered + np.uint32(k), 0x21F0AAAD, 0xD35A2D97), lead)
    return out.T


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = signature.reshape(len(signature), -1, rows).astype(U)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=U), bands.shape[:2])
    for r in range(rows):
        key = mix(key ^ bands[:, :, r] * _ODD[r])
    return key


SKETCH_SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _portions(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with about ``TILE`` bytes of text."""
    for given in batches:
        texts = utf8(given.column(text))
        a = size = 0
        for b, t in enumerate(texts, 1):
            size += len(t)
            if size >= TILE or b == len(texts):
                yield given.slice(a, b - a), texts[a:b]
                a, size = b, 0


def sketch(rows: int, bands: int, words: int):
    """Of each document the number of its shingles, a 128-bit key of the set, and its band keys; none for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given, texts in _portions(batches, "text"):
            shingles, sizes = shingle_sets(texts, words)
            end = np.cumsum(sizes)
            keys = [hashlib.blake2b(shingles[b - n : b].tobytes(), digest_size=16).digest() for b, n in zip(end, sizes)]
            some = sizes > 0
            own = band_keys(signatures(shingles, sizes[some], rows * bands), rows).view(np.int64) if some.any() else np.zeros((0, bands), np.int64)
            yield batch(SKETCH_SCHEMA, given.column("doc_id"), sizes, keys, lists(own.ravel(), np.where(some, bands, 0)))

    return run


def _shingle_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given, texts in _portions(batches, "text"):
            shingles, sizes = shingle_sets(texts, words)
            docs = np.repeat(given.column("doc_id").to_numpy(), sizes)
            for a in range(0, len(docs), 1 << 17):
                yield batch("doc_id long, shingle long", docs[a : a + (1 << 17)], shingles.view(np.int64)[a : a + (1 << 17)])

    return run


SALTS = 64  # shares that a hot key's rows are dealt to


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS))


PAIR_SCHEMA = "a long, b long, common long, linked boolean"


def common_shingles(x: list[bytes], y: list[bytes], words: int) -> tuple[int, int, int]:
    """Distinct shingles of two lists of words, and those that both have. Words are numbered, so equal numbers mean equal words; no hash decides."""
    number = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
    codes, sizes = [], []
    for own in (x, y):
        codes.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
        sizes.append(len(own))
    if min(sizes) < words:  # a short text is one shingle, equal to nothing but itself
        same = x == y
        return *(1 if 0 < n < words else len(set(zip(*(own[i:] for i in range(words))))) for n, own in zip(sizes, (x, y))), int(same)
    base = len(number)
    code, limit = np.concatenate(codes), base
    inside = np.concatenate([np.arange(n) for n in sizes])
    at = np.flatnonzero(inside <= np.repeat(sizes, sizes) - words)
    full = code[at]
    for j in range(1, words):
        if limit > (1 << 62) // base:  # numbered anew, so that they stay small
            _, full = np.unique(full, return_inverse=True)
            limit = len(full)
        full, limit = full * base + code[at + j], limit * base
    cut = sizes[0] - words + 1
    a, b = np.unique(full[:cut]), np.unique(full[cut:])
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def _compared(words: int, per_cent: int):
    """Size of the intersection of a pair's full sets, and whether they have the similarity; a text that recurs in neighbouring rows is cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            common, linked, known, known_words = [], [], None, []
            for x, y in zip(utf8(given.column("text_hub")), utf8(given.column("text"))):
                if x != known:
                    known, known_words = x, x.translate(_LOWER).split()
                n, m, both = common_shingles(known_words, y.translate(_LOWER).split(), words)
                common.append(both)
                linked.append(100 * both >= per_cent * (n + m - both))
            yield batch(PAIR_SCHEMA, given.column("a"), given.column("b"), common, linked)

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (least node reachable) of all nodes of the edges ``a, b``.

    Each round a node takes the least label among its neighbours', then its label's label; rounds end when nothing
    changes. Every round is written to the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        better = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = stage(better.join(up, "component").select("node", F.least("component", "up").alias("component"), (F.least("component", "up") < F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if not new.where("moved").limit(1).count():
            return labels


def link_documents(docs: DataFrame, per_cent: int = SIMILARITY, words: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Documents of one set stand for each other, the least doc_id for all. Buckets of equal band keys name the
    candidates. Of a candidate's shingles only those that another candidate has can lie in an intersection, which
    bounds its similarity to anything and drops most chance candidates before a pair is made. Of each bucket the
    document with the largest such share is compared with all others; where a bucket then still holds several
    components, so are its pairs across components that the bounds allow. Pairs inside a component never are. Pairs are
    compared word by word; that documents have one set is read from 128 bits of the 64-bit hashes of their shingles,
    made from words hashed modulo a prime.

    A null or empty text has no shingles and is linked with nothing. Rows with one doc_id are one document. A row
    with a null doc_id is linked with nothing, has a null component and is kept.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", "text")
    sketched = stage(texts.mapInArrow(tidy(sketch(rows, bands, words)), SKETCH_SCHEMA), "sketch")
    sets = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m"))
    nodes = sets.select("set_key", F.col("m.doc_id").alias("node"), F.col("m.n_shingles").alias("n"), "m.bands")
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    candidates = stage(banded.join(shared, "band"), "candidates")

    involved = candidates.select(F.col("node").alias("doc_id")).distinct()
    texts = stage(texts.where("doc_id is not null").join(involved, "doc_id", "left_semi").distinct(), "candidate-texts")
    shingles = texts.mapInArrow(tidy(_shingle_rows(words)), "doc_id long, shingle long")
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("c"), F.min("doc_id").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    bounded = candidates.join(alone, "node", "left").withColumn("can", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    # similarity s needs an intersection of s / (1 + s) of both sizes, and sizes in proportion s
    bounded = bounded.where(f"100 * can >= {per_cent} * n")
    least = bounded.groupBy("band").agg(F.min("n").alias("least"), F.count("*").alias("c"))
    bounded = stage(bounded.join(least, "band").where(f"c > 1 and (100 + {per_cent}) * can >= {per_cent} * (n + greatest(least, {per_cent} * n / 100))").drop("least", "c"), "bounded")
    possible = lambda x, y: F.expr(f"100 * least({x}.n, {y}.n) >= {per_cent} * greatest({x}.n, {y}.n) and (100 + {per_cent}) * least({x}.can, {y}.can) >= {per_cent} * ({x}.n + {y}.n)")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` compared by their texts. The text of ``hub``, one of the two, goes once to each share of its pairs."""
        pairs = pairs.withColumn("doc_id", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))).withColumn("salt", _salt("doc_id"))
        hubs = pairs.select("hub", "salt").distinct().join(texts.select(F.col("doc_id").alias("hub"), F.col("text").alias("text_hub")), "hub")
        both = pairs.join(texts, "doc_id").join(hubs, ["hub", "salt"])
        return both.select("a", "b", "text_hub", "text").mapInArrow(tidy(_compared(words, per_cent)), PAIR_SCHEMA)

    # a group's centre shares most buckets with most documents, so it is compared first
    weight = bounded.join(bounded.groupBy("band").agg(F.count("*").alias("c")), "band").groupBy("node").agg(F.sum("c").alias("weight"))
    bounded = stage(bounded.join(weight, "node"), "weighted")
    hub = bounded.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("less"), "n", "can")).alias("h"))
    hub = hub.select("band", (-F.col("h.less")).alias("node"), "h.n", "h.can")
    pairs = bounded.alias("x").join(hub.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.node") != F.col("y.node")) & possible("x", "y"))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.col("y.node").alias("hub"))
    tested = stage(verified(stage(pairs.groupBy("a", "b").agg(F.min("hub").alias("hub")), "hub-pairs")), "hub-verified")
    edges = tested.where("linked").select("a", "b")
    grouped = components(edges)

    # Across components: |x & y| is at most min(|x & h|, |y & h|) for the shingles of the bucket's hub h, plus
    # min of what each shares outside h with any candidate. Rows that no other component's row can meet go first.
    of_hub = tested.select(F.col("a").alias("node"), F.col("b").alias("hub"), "common").union(tested.select("b", "a", "common")).groupBy("node", "hub").agg(F.max("common").alias("common"))
    labelled = bounded.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    span = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    mixed = labelled.join(span, "band").join(hub.select("band", F.col("node").alias("hub")), "band").join(of_hub, ["node", "hub"], "left")
    inside = F.when(F.col("node") == F.col("hub"), F.col("n")).otherwise(F.coalesce("common", "can"))
    outside = F.when(F.col("node") == F.col("hub"), F.lit(0)).otherwise(F.col("can") - F.coalesce("common", F.lit(0)))
    mixed = stage(mixed.select("band", "node", "n", "can", "component", inside.alias("inside"), outside.alias("outside")), "mixed")
    sizes = mixed.groupBy("band", "component").agg(F.count("*").alias("c"), F.max("inside").alias("i"), F.max("outside").alias("o"), F.min("n").alias("n"))
    largest = sizes.groupBy("band").agg(F.max_by("component", F.struct("c", "component")).alias("largest"))
    tops = sizes.join(largest, "band").groupBy("band", "largest").agg(*(f(F.when(F.col("component") != F.col("largest"), F.col(c))).alias(f"{c}_rest") for f, c in ((F.max, "i"), (F.max, "o"), (F.min, "n"))), *(f(c).alias(f"{c}_all") for f, c in ((F.max, "i"), (F.max, "o"), (F.min, "n"))))
    top = lambda c: F.when(F.col("component") == F.col("largest"), F.col(f"{c}_rest")).otherwise(F.col(f"{c}_all"))
    mixed = mixed.join(tops, "band").where((100 + per_cent) * (F.least("inside", top("i")) + F.least("outside", top("o"))) >= per_cent * (F.col("n") + F.greatest(top("n"), per_cent * F.col("n") / 100)))
    mixed = stage(mixed.select("band", "node", "n", "can", "component", "inside", "outside"), "across")
    mixed = mixed.join(mixed.groupBy("node").agg(F.collect_set("band").alias("bands")), "node")  # a node has ``bands`` of them at most
    near = F.expr(f"(100 + {per_cent}) * (least(x.inside, y.inside) + least(x.outside, y.outside)) >= {per_cent} * (x.n + y.n) and array_min(array_intersect(x.bands, y.bands)) = x.band")  # a pair is made in one band
    cross = mixed.alias("x").join(mixed.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.component") < F.col("y.component")) & possible("x", "y") & near)
    cross = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = stage(verified(stage(cross.withColumn("hub", F.col("a")), "cross-pairs")), "cross-verified").where("linked").select("a", "b")
    if more.limit(1).count():
        grouped = components(edges.union(more))

    # a set that many documents have is dealt out by document: each share learns the component apart
    by_set = sketched.where("n_shingles > 0").groupBy("set_key", _salt("doc_id").alias("salt")).agg(F.min("doc_id").alias("least"))
    by_set = by_set.withColumn("node", F.min("least").over(Window.partitionBy("set_key")))  # a row for each share
    of_set = by_set.join(grouped, "node", "left").select("set_key", "salt", F.coalesce("component", "node").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "set_key", _salt("doc_id").alias("salt")).join(of_set, ["set_key", "salt"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
