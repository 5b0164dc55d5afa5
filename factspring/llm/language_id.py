"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in windows, labels every byte of it with a probability for each language, and pools these
over the document. It is trained here, in numpy, by backpropagation through time on windows of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_io import batch, tidy, utf8
from .staging import ship

WINDOW = 128  # bytes that the network sees at once
HIDDEN = 8  # units of each direction
SAMPLE = 400  # documents of each language that are trained on, at most about
WINDOWS = 6  # windows taken from each of them, at places given by a hash
TOTAL, LEAST = 80_000, 20  # documents trained on over all languages, at most about, but for LEAST of each language
AT_ONCE = 200  # languages of a batch; with more, batches take turns and windows are run fewer at once
STEPS, BATCH, RATE = 240, 128, 0.02
CHUNK = 2048  # windows run at once
UNDETERMINED = "und"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), which bounds gates and candidates here: its slope is (1 - |y|)**2, and it costs a sixth of a tanh."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    return (1 - np.abs(y)) ** 2


class BiGru:
    """Parameters by name: for both directions and the three gates (update, reset, candidate) input (2, 3, 256, H) and
    recurrent (2, 3, H, H); out (2H, K) and its bias.

    Update and reset are (1 + squash) / 2 of their inputs, the candidate is a squash; a state is
    update * state + (1 - update) * candidate.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        scale = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"input": scale(2, 3, 256, hidden), "recurrent": scale(2, 3, hidden, hidden), "out": scale(2 * hidden, len(languages)), "bias": np.zeros(len(languages), np.float32)}

    def forward(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
        """x, live: (T, n). Probabilities (T, n, K) and what backpropagation needs."""
        t, n = x.shape
        h = self.hidden
        states, kept = np.zeros((2, t, n, h), np.float32), [[], []]
        for d in (0, 1):
            state, given, weights = np.zeros((n, h), np.float32), self.p["input"][d], self.p["recurrent"][d]
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                update, reset = (_squash(given[k][x[i]] + state @ weights[k]) for k in (0, 1))
                own = state @ weights[2]
                candidate = _squash(given[2][x[i]] + 0.5 * (1 + reset) * own)
                new = (candidate + 0.5 * (1 + update) * (state - candidate)) * live[i][:, None]
                kept[d].append((i, state, update, reset, candidate, own))
                state = states[d, i] = new
        both = np.concatenate(states, -1)
        logits = both @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True), [both, kept]

    def gradients(self, x: np.ndarray, live: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all live positions and its gradients, by backpropagation through time."""
        probabilities, (both, kept) = self.forward(x, live)
        h, total = self.hidden, max(1.0, float(live.sum()))
        picked = np.take_along_axis(probabilities, np.broadcast_to(labels[None, :, None], (*x.shape, 1)), -1)[..., 0]
        loss = float((-np.log(picked + 1e-9) * live).sum() / total)
        error = probabilities
        np.put_along_axis(error, np.broadcast_to(labels[None, :, None], (*x.shape, 1)), picked[..., None] - 1, -1)
        error *= (live / total)[..., None].astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = error.reshape(-1, error.shape[-1])
        g["out"], g["bias"] = both.reshape(-1, 2 * h).T @ flat, flat.sum(0)
        above = error @ self.p["out"].T
        for d in (0, 1):
            weights = self.p["recurrent"][d]
            carried, ins, codes = np.zeros((x.shape[1], h), np.float32), [], []
            for i, state, update, reset, candidate, own in reversed(kept[d]):
                grad = (above[i, :, d * h : (d + 1) * h] + carried) * live[i][:, None]
                keep = 0.5 * (1 + update)
                to_candidate = grad * (1 - keep) * _slope(candidate)
                to_update = 0.5 * grad * (state - candidate) * _slope(update)
                to_reset = 0.5 * to_candidate * own * _slope(reset)
                to_own = (to_update, to_reset, to_candidate * 0.5 * (1 + reset))
                carried = grad * keep
                for k in range(3):
                    g["recurrent"][d, k] += state.T @ to_own[k]
                    carried += to_own[k] @ weights[k].T
                ins.append(np.stack([to_update, to_reset, to_candidate], 1))
                codes.append(x[i])
            codes, ins = np.concatenate(codes), np.concatenate(ins)
            order = np.argsort(codes, kind="stable")
            lead = np.flatnonzero(np.diff(codes[order], prepend=-1))
            g["input"][d][:, codes[order][lead]] = np.add.reduceat(ins[order], lead).transpose(1, 0, 2)
        return loss, g

    def train(self, windows: np.ndarray, live: np.ndarray, labels: np.ndarray, steps: int = STEPS, size: int = BATCH, rate: float = RATE, seed: int = 1) -> list[float]:
        """Adam over random batches with equally many windows of each language where there are any; the losses."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first, second, losses = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, []
        m, s = first
        steps = steps * max(len(by), AT_ONCE) // AT_ONCE
        for step in range(1, steps + 1):
            own = by if len(by) <= AT_ONCE else [by[k] for k in rng.choice(len(by), AT_ONCE, replace=False)]
            rows = np.concatenate([rng.choice(b, -(-size // len(own))) for b in own if len(b)])
            loss, g = self.gradients(windows[rows].T, live[rows].T, labels[rows])
            losses.append(loss)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v**2
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def pooled(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Sums of the positions' probabilities of each window, (n, K), for x, live of (T, n).

        As ``forward``, both directions at once. Every gate has arrays of its own, so that each pass runs over memory
        without gaps; probabilities lie language by language for the same reason.
        """
        t, n = x.shape
        h = self.hidden
        weights = np.ascontiguousarray(self.p["recurrent"].transpose(1, 0, 2, 3))
        weights = np.stack([weights[0], weights[1], 0.5 * weights[2]])
        given = self.p["input"]
        states = np.empty((2, t, n, h), np.float32)
        state, scratch = np.zeros((2, n, h), np.float32), np.empty((2, n, h), np.float32)
        gates, own = np.empty((3, 2, n, h), np.float32), np.empty((3, 2, n, h), np.float32)
        update, reset, candidate = gates
        whole = live.all(1)
        x = x.astype(np.intp)

        def squash(y: np.ndarray) -> None:
            np.abs(y, out=scratch)
            np.add(scratch, 1, out=scratch)
            np.divide(y, scratch, out=y)

        for i in range(t):
            for k in range(3):
                np.take(given[0, k], x[i], axis=0, out=gates[k, 0], mode="clip")
                np.take(given[1, k], x[t - 1 - i], axis=0, out=gates[k, 1], mode="clip")
                np.matmul(state, weights[k], out=own[k])
            reset += own[1]
            squash(reset)
            reset += 1
            reset *= own[2]
            candidate += reset
            squash(candidate)
            update += own[0]
            squash(update)
            update += 1
            update *= 0.5
            state -= candidate
            state *= update
            state += candidate
            if not whole[i]:
                state[0] *= live[i][:, None]
            if not whole[t - 1 - i]:
                state[1] *= live[t - 1 - i][:, None]
            states[0, i], states[1, t - 1 - i] = state
        logits = self.p["out"][:h].T @ states[0].reshape(-1, h).T
        logits += self.p["out"][h:].T @ states[1].reshape(-1, h).T
        logits += self.p["bias"][:, None]
        np.clip(logits, -60, 60, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        logits = logits.reshape(-1, t, n)
        if not whole.all():
            logits *= live
        return logits.sum(1).T


def windowed(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut to windows (rows), which positions are text, and each window's text."""
    sizes = np.array([-(-len(t) // window) for t in texts], np.int64)
    data = b"".join(t.translate(_LOWER).ljust(n * window, b"\0") for t, n in zip(texts, sizes.tolist()))
    x = np.frombuffer(data, np.uint8).reshape(-1, window)
    owner = np.repeat(np.arange(len(texts)), sizes)
    live = np.ones(x.shape, bool)
    ends = np.cumsum(sizes) - 1
    for e, t in zip(ends.tolist(), texts):
        if len(t) % window:
            live[e, len(t) % window :] = False
    return x, live, owner


def _portion(docs: DataFrame, learnt: Column, sample: int, window: int, per_text: int) -> tuple[list[str], list[tuple[bytes, int]]]:
    """Languages and training windows of at most about ``sample`` documents of each and ``TOTAL`` of all.

    Chosen by the least hashes of id and text, so that copies are chosen apart, repeated rows once, and whatever the
    order of tasks the same.
    """
    usable = docs.where(learnt & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return [], []
    sample = min(sample, max(LEAST, TOTAL // len(languages)))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, sample / counts[k])) for k in languages], "lang string, _share double")
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    near = usable.select("lang", "text", hashed.alias("_hash")).join(F.broadcast(shares), "lang").where(F.col("_hash") < F.col("_share") * (1 << 40))  # ``sample`` of a language are expected
    near = near.groupBy("lang", "_hash").agg(F.min("text").alias("text"))
    chosen = near.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))).where(F.col("_place") <= 2 * sample)
    place = lambda k: F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(F.lit(1), F.length("text") - window)).cast("int") + 1
    pieces = chosen.select("lang", F.explode(F.array(*[F.col("text").substr(place(k), F.lit(window)) for k in range(per_text)])).alias("piece"))
    rows = sorted((r["lang"], r["piece"].encode()[:window]) for r in pieces.collect())
    return languages, [(piece, languages.index(lang)) for lang, piece in rows]


def train(docs: DataFrame, learnt: Column, sample: int = SAMPLE) -> BiGru | None:
    """A network trained on the rows where ``learnt`` holds; None if none of them names a language."""
    languages, pieces = _portion(docs, learnt, sample, WINDOW, WINDOWS)
    if not languages:
        return None
    model = BiGru(languages)
    x, live, owner = windowed([p for p, _ in pieces])
    model.train(x, live.astype(np.float32), np.array([k for _, k in pieces])[owner])
    return model


def _predictor(model: BiGru | None, schema):
    names = [f"carried_{i}" for i in range(len(schema.fields) - 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            texts, lettered = utf8(given.column("whole")), given.column("lettered").to_pylist()
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            known = [i for i, ok in enumerate(lettered) if ok and model]
            chunk = max(1, CHUNK * AT_ONCE // max(AT_ONCE, len(model.languages))) if model else CHUNK
            a = size = 0
            for b, i in enumerate(known, 1):
                size += len(texts[i])
                if size >= CHUNK * WINDOW or b == len(known):
                    own = known[a:b]
                    x, live, owner = windowed([texts[j] for j in own])
                    sums = np.zeros((len(own), len(model.languages)))
                    for c in range(0, len(x), chunk):
                        np.add.at(sums, owner[c : c + chunk], model.pooled(np.ascontiguousarray(x[c : c + chunk].T), np.ascontiguousarray(live[c : c + chunk].T)))
                    sums /= sums.sum(1, keepdims=True)
                    for j, p in zip(own, sums):
                        langs[j], scores[j] = model.languages[int(p.argmax())], float(p.max())
                    a, size = b, 0
            yield batch(schema, *(given.column(n) for n in names), langs, scores)

    return run


def predict(docs: DataFrame, model: BiGru | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns more (in place of columns of these ``names``): language and mean probability over all bytes; ``und`` and 0 for a text that is null or has no letters, or without a model.

    Of languages with equal probability the first by name counts. Rows are independent: repeated rows get equal answers.
    """
    ship(docs.sparkSession)
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    carried = [F.col(f"`{f.name}`").alias(f"carried_{i}") for i, f in enumerate(schema.fields[:-2])]
    given = docs.select(*carried, F.coalesce("text", F.lit("")).alias("whole"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return given.mapInArrow(tidy(_predictor(model, schema)), schema)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; trained on the rows not held out whose ``lang`` isn't null."""
    model = train(docs, ~held_out(F.col("doc_id")))
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(slim, model).select("doc_id", "held_out", "lang_pred", "score")
