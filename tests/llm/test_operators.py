"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factspring.llm import bpe, byte_bpe, bytehash, chat, fingerprints, language_id, near_dedup, packing, quality_rules, sharding, suffix_dedup, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Extra columns have names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, band long, kept string, size string, shard string, n string, component string, version string, start string, stratum string, score string, whole string, spans string, `_text` string, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 0, *["x" if i else 7 for i in range(14)]) for d, t, lang in rows], SCHEMA)


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    rows = []
    for i in range(60):
        text = " ".join(rnd.choice(words) + rnd.choice(["", "", ".", "\n"]) for _ in range(rnd.randint(1, 90)))
        if i % 7 == 0:
            text += " " + passage + " tail" * (i % 3)
        rows.append((i, text, rnd.choice(["en", "fr"])))
    base = rows[5][1] + " " + passage
    for i in range(60, 75):
        w = base.split(" ")
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w), "en"))
    rows += [(75, rows[3][1], "en"), (76, rows[3][1].upper(), "fr"), (77, None, None), (78, "", "en"), (79, " \t\n", None), (80, "two words", "en"), (81, "TWO words", "fr")]
    rows += [(82, "a" * 9000 + " " + passage + "ab" * 3000, "en"), (83, "x" + "a" * 300, "en"), (84, "🙂é" * 60, None), (85, "🙂é" * 50, "fr")]
    rows += [rows[0], rows[0]]  # repeated rows
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(rows=ROWS):
    return [(d, t or "") for d, t, _ in rows]


# 1


def repeated_words(words):
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(covered)


def test_measures(spark, docs):
    loop = frame(spark, [(1, "a b c d e f g h " * 9, "en"), (2, "p q\n\n p q\np q\n \n", None), (3, None, "en"), (4, "#*$ %a&|<> b c", "en")])
    out = {r.doc_id: r for r in quality_rules.measures(docs.select("doc_id", "text").union(loop.select(F.col("doc_id") + 1000, "text"))).collect()}
    for d, t in [*texts(), (1001, "a b c d e f g h " * 9), (1002, "p q\n\n p q\np q\n \n"), (1003, ""), (1004, "#*$ %a&|<> b c")]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = out[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated_words(words)), d


def binomial(n, k, p):
    from math import comb

    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    pairs = [(1, 0), (30, 0), (400, 3), (400, 8), (1000, 20), (5000, 60), (5000, 100)]
    df = spark.createDataFrame(pairs, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p"))
    for n, k, p in df.collect():
        assert p == (1.0 if k >= n * 0.02 else pytest.approx(binomial(n, k, 0.02), rel=1e-9))


def test_rules_reject_what_labels_certify_and_no_more(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        w = [rnd.choice(words) for _ in range(40)]
        rows.append((i, " ".join(x + "%%%" if bad and j % 2 else x for j, x in enumerate(w)), "few" if i < 100 else "many"))
        labels.append((i, 0 if bad else 1, None))
    labels += [(1, None, 1), (None, 1, 0), (3, 1, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_rules.apply_rules(frame(spark, rows), given).collect()}
    assert len(out) == 3000
    assert all(r.kept for i, r in out.items() if i < 100 or i % 5)  # few labels certify nothing; good documents stay
    assert not any(out[i].kept for i in range(100, 3000, 5)) and {out[i].rejected_by for i in range(100, 3000, 5)} == {"symbols"}
    left = quality_rules.filter_documents(frame(spark, rows), given)
    assert left.columns == frame(spark, rows).columns and {r.doc_id for r in left.collect()} == {i for i, r in out.items() if r.kept}


def test_small_strata_are_certified_together(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    rows, labels = [], []
    for i in range(2000):
        bad, lang = i % 5 == 0, ("de", "fr", "es", None)[i % 4]
        rows.append((i, " ".join(rnd.choice(words) + "%%%" * (bad and j % 2) for j in range(40)), lang))
        labels.append((i, 0 if bad else 1, None))
    rows += [(2000 + i, " ".join(w + "%%%" * (i % 2) for w in rnd.sample(words, 40)), "xx") for i in range(10)]  # a language without labels
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    alone = quality_rules.apply_rules(frame(spark, rows), given).collect()
    assert all(r.kept for r in alone)  # 400 good labels of a language certify nothing
    gone = {*range(0, 2000, 5), *range(2001, 2010, 2)}
    out = quality_rules.apply_rules(frame(spark, rows), given, pooled=True).collect()
    assert {r.doc_id for r in out if not r.kept} == gone and len(out) == 2010
    left = quality_rules.filter_documents(frame(spark, rows), given, pooled=True)
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - gone


# 2


def test_gradients_are_those_of_the_loss():
    model = language_id.BiGru(["a", "b", "c"], hidden=3, seed=2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, live, _ = language_id.windowed([b"hello wor", b"abc"], 9)
    labels = np.array([0, 2])
    _, g = model.gradients(x.T, live.T.astype(float), labels)
    for name, at in (("input", (0, 0, x[0, 3], 1)), ("input", (1, 2, x[0, 0], 1)), ("input", (1, 1, x[0, 1], 0)), ("recurrent", (0, 0, 1, 2)), ("recurrent", (0, 1, 0, 1)), ("recurrent", (1, 2, 2, 2)), ("out", (5, 1)), ("bias", (2,))):
        old, ends = model.p[name][at], []
        for step in (1e-4, -1e-4):
            model.p[name][at] = old + step
            ends.append(model.gradients(x.T, live.T.astype(float), labels)[0])
        model.p[name][at] = old
        assert g[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-4, abs=1e-5)  # the states are single precision


def test_pooling_is_the_forward_pass():
    model = language_id.BiGru(["a", "b"], seed=3)
    x, live, _ = language_id.windowed([b"some text of a length", b"z", bytes(range(1, 200))], 16)
    probabilities, _ = model.forward(x.T, live.T.astype(np.float32))
    assert np.allclose((probabilities * live.T[..., None]).sum(0), model.pooled(np.ascontiguousarray(x.T), np.ascontiguousarray(live.T)), atol=1e-3)


def test_held_out_accuracy_and_undetermined(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 34 !", "en"), (-3, "", None)], "doc_id long, text string, lang string")
    given = real.select("doc_id", "text", "lang").union(odd)
    out = {r.doc_id: r for r in language_id.identify_languages(given).collect()}
    truth = {r.doc_id: r.lang for r in real.collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (-1, -2, -3))
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    held = [i for i in truth if out[i].held_out]
    assert sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.97


def test_no_languages_and_no_rows(spark, nothing):
    rows = frame(spark, [(1, "hello", None), (2, None, None)])
    assert {r.lang_pred for r in language_id.identify_languages(rows).collect()} == {"und"}
    assert language_id.identify_languages(nothing).count() == 0
    named = language_id.predict(rows, None)
    assert named.columns == [*(c for c in rows.columns if c != "score"), "lang_pred", "score"] and {r["a.b"] for r in named.collect()} == {"x"}


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TOTAL", 230)
    rows = frame(spark, [(2 * i + j, f"text {i} of a language", f"l{i:03}") for i in range(230) for j in range(2)])
    languages, pieces = language_id._portion(rows, F.lit(True), 400, 32, 1)
    assert languages == [f"l{i:03}" for i in range(230)] and {k for _, k in pieces} == set(range(230))
    named = language_id.predict(rows, language_id.BiGru(languages)).collect()
    assert len(named) == 460 and all(r.lang_pred in languages for r in named)


def test_lettered_texts_stay_where_no_language_is_named(spark):
    import corpus_pipeline

    rows = frame(spark, [(1, "hello", None), (2, None, None), (3, "12 3", None)])
    assert [r.doc_id for r in corpus_pipeline.by_language(spark, rows, "").collect()] == [1]


# 3


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, docs, shards):
    rows = sorted(sharding.shard_documents(docs, shards).collect(), key=lambda r: (r.doc_id, r.text_crc32))
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts())
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in {r.shard for r in rows}:
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r["size"] for r in own) - total / shards) <= most
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_shards_of_nothing_and_of_null_ids(spark, nothing):
    assert sharding.shard_documents(nothing).count() == 0
    assert sharding.shard_documents(frame(spark, [(None, "a", "x"), (None, None, "x"), (1, "b", None)])).count() == 3


# 4


def links(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_copies(docs):
    out = near_dedup.link_documents(docs).collect()
    assert len(out) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == links(texts())
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_copies_without_links(spark, nothing):
    assert near_dedup.link_documents(nothing).count() == 0
    out = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.link_documents(frame(spark, [(None, "a b c d e f", "x"), (5, "a b c d e f", "x"), (6, None, "x"), (7, None, "x")])).collect()}
    assert out == {(None, None, True), (5, 5, True), (6, 6, True), (7, 7, True)}


def test_a_crowd_of_near_copies(spark):
    """One group of many different texts, most of them linked with a centre only, some with nothing."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 6])):
            w[rnd.randrange(120)] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w), "en"))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_documents(frame(spark, rows)).collect()}
    assert out == links([(d, t) for d, t, _ in rows])


WORDS_OF = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30)


@settings(max_examples=60, deadline=None)
@given(WORDS_OF, WORDS_OF)
def test_shingles_are_compared_word_by_word(x, y):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in (x, y)]
    if x and y:
        assert near_dedup.common_shingles(x, y, 5) == (len(sets[0]), len(sets[1]), len(sets[0] & sets[1]))
        many = [b"%d" % i for i in range(9000)]
        assert near_dedup.common_shingles(many + x, many + y, 5)[2] == len({tuple((many + x)[i : i + 5]) for i in range(len(x) + 8996)} & {tuple((many + y)[i : i + 5]) for i in range(len(y) + 8996)})


# 5

PIECES = st.sampled_from([*chat.Template().controls(), "\\", "<", "[", "/", "s>", " ", "\n", "a", "é", "🙂", "<<", "]", "INST"])
TEXT = st.lists(PIECES, max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<<ROLE>>", "a\\"]), TEXT), max_size=5))
def test_chat_round_trip(turns):
    segments, _ = chat.format_turns(turns)
    assert list(chat.read_turns(chat.Template(), "".join(s for s, _ in segments))) == turns
    assert [chat.Template.unescape(s) for s, learned in segments if learned] == [t for r, t in turns if r == "assistant"]


def test_chat_order():
    check = lambda *roles: chat.format_turns([(r, "x") for r in roles])[1]
    assert check("system", "user", "assistant") == [] and check("user", "assistant", "user", "assistant") == []
    assert check("assistant") == ["turn 0: assistant after the start"] and check("user") == ["ends after user"]
    assert check("user", "user", "assistant") == ["turn 1: user after user"] and check("", "user", "assistant")[0] == "turn 0: no role after the start"


def test_a_stream_reads_back_turn_by_turn():
    """Turns and the texts under the loss, taken by their places, come out of the joined stream."""
    turns = [("user", "a </s> b"), ("tool", "<<TURN>>"), ("assistant", "[INST]\\ x"), ("user", ""), ("assistant", "y")]
    segments, _ = chat.format_turns(turns)
    whole = chat.Reader(chat.Template())
    out = list(whole.feed(segments))
    assert [(r, t) for r, t, _ in out] == turns and [x for *_, own in out for x in own] == ["[INST]\\ x", "y"] and whole.held == "" and whole.end == sum(len(s) for s, _ in segments)


def test_a_very_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " * (20000 if i == 7 else 3)) for i in range(3000)]
    out = chat.digest_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()[0]
    said = "".join(t for *_, r, t in rows if r == "assistant")
    assert (out.n_turns, out.loss_chars, out.in_order) == (3000, len(said), True) and out.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yo\\[INST]"), (2, 1, "assistant", None), (2, 0, None, "x"), (None, 0, "user", "n"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segment", F.lit(1))
    out = {r.conv_id: r for r in chat.digest_conversations(turns).collect()}
    assert set(out) == {1, 2, 3, None}
    assert out[1].turns_sha256 == hashlib.sha256(b"user\nhi </s>\nassistant\nyo\\[INST]\n").hexdigest()
    assert (out[1].loss_chars, out[1].in_order, out[2].n_turns, out[2].loss_chars, out[2].in_order, out[3].n_turns) == (9, True, 2, 0, False, 2)
    whole = "".join(r.text for r in chat.format_conversations(turns.where("conv_id = 1")).orderBy("turn", "segment").collect())
    assert len(whole) == out[1].formatted_chars
    assert chat.digest_conversations(turns.where("false")).count() == 0


# 6


def passages(rows, n=50):
    first = {}
    for d, t in sorted((d, t.encode()) for d, t in rows):
        for i in range(len(t) - n + 1):
            first.setdefault(t[i : i + n], d)
    out = {}
    for d, t in ((d, t.encode()) for d, t in rows):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d] = (len(t), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [2048, 2])
def test_repeated_passages(docs, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    out = suffix_dedup.dedup_passages(docs).collect()
    assert len(out) == len(ROWS) and {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == passages(texts())


def test_repeated_passages_with_texts_and_without_rows(spark, docs, nothing):
    cut = suffix_dedup.dedup_passages(docs, texts=True)
    assert set(docs.columns) < set(cut.columns) and {(r["a.b"], r["_text"], r.whole) for r in cut.collect()} == {("x", "x", "x")}
    assert all(r.kept_text == (r.text or "") for r in cut.collect() if r.n_removed == 0)
    assert suffix_dedup.dedup_passages(nothing).count() == 0
    same = "".join(chr(97 + i * 7 % 26) for i in range(80))
    rows = suffix_dedup.dedup_passages(frame(spark, [(None, same, "x"), (4, same, "x"), (4, same + "!", "x"), (9, "." + same, "x")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (4, 0), (4, 0), (9, 80)]


def test_blocks_are_told_apart_by_64_bits_and_length():
    own, _ = suffix_dedup.blocks([(1, 0, 0, bytes(range(32, 127)) * 3)], 50, 20)
    assert (own["b"] >> np.uint64(40)).any()
    column = lambda *v: np.array(v, np.int64)
    x = {"m": np.ones(5, np.uint64), "b": np.array([5, 5 + (1 << 40), 7, 7, 7], np.uint64), "doc": column(0, 1, 2, 3, 4), "v": column(0, 1 << 40, 0, 9, 0), "at": column(0, 0, 0, 0, 0), "n": column(3, 3, 3, 4, 3)}
    back = suffix_dedup._unpacked([suffix_dedup._packed(x)])
    assert all((back[k] == x[k]).all() for k in x)
    rows, lead, repeated = suffix_dedup._sorted(back)
    assert rows["doc"][repeated].tolist() == [4] and rows["doc"][lead[repeated]].tolist() == [2]


def test_blocks_with_one_hash_are_compared_by_bytes(spark, docs, monkeypatch):
    """With hashes of two bits nearly all blocks collide; each failed comparison asks for another multiplier, and none is believed."""
    sound, seeds = suffix_dedup.blocks, []

    def weak(pieces, length, gram, seed=0):
        x, data = sound(pieces, length, gram, seed)
        return (x | {"b": x["b"] & np.uint64(3)} if seed < 2 else x), data

    split = suffix_dedup.split_blocks
    monkeypatch.setattr(suffix_dedup, "split_blocks", lambda parts, length, gram, seed=0: seeds.append(seed) or split(parts, length, gram, seed))
    monkeypatch.setattr(suffix_dedup, "blocks", weak)
    folded = spark.createDataFrame([(d, "".join(x if i % 97 else chr(97 + (d + i) % 26) for i, x in enumerate("abcdefghijklmnopqrstuvwxyz" * 12))) for d in range(12)], "doc_id long, text string")
    given = [(r.doc_id, r.text) for r in folded.collect()]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_passages(folded).collect()}
    assert out == passages(given) and seeds == [0, 1, 2]


def test_texts_that_collide_modulo_a_power_of_two(spark):
    word = "a"
    for _ in range(12):
        word += word.translate({97: 98, 98: 97})
    given = [(i, (word[:n].translate({97: 98, 98: 97}) if i % 2 else word[:n]) + tail) for i, (n, tail) in enumerate((n, t) for n in (1024, 2048, 4096) for t in ("", "", " one two three four five six"))]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_passages(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert out == passages(given)
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_documents(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert linked == links(given)


@pytest.mark.parametrize("n, chunks", [(40, 1), (700, 31)])
def test_chunks_are_fetched_by_claims_not_by_tasks(spark, monkeypatch, n, chunks):
    passage = "".join(chr(97 + i * i * 7 % 23) + chr(65 + i % 19) for i in range(60))
    texts = spark.createDataFrame([(d, passage + f" {d * 7919:050d}") for d in range(n)], "doc_id long, text string")
    staged, put = [], suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, name: staged.append(put(df, name)) or staged[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        out = suffix_dedup.dedup_passages(texts.repartition(n)).collect()
        wanted = staged[0].where(f"kind = {suffix_dedup.WANTED}").distinct()
        assert 0 < wanted.count() <= chunks and all(r.n_removed >= len(passage) for r in out if r.doc_id) and {r.version for r in wanted.collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_are_dealt_to_few_parts(spark, docs, monkeypatch):
    made, split = [], suffix_dedup.split_blocks
    monkeypatch.setattr(suffix_dedup, "split_blocks", lambda parts, *rest: made.append(parts) or split(parts, *rest))
    assert suffix_dedup.dedup_passages(docs).count() and made == [2 * suffix_dedup.width(spark)]


def test_products_modulo_the_prime():
    rnd = random.Random(1)
    pairs = [(rnd.randrange(bytehash.PRIME), rnd.randrange(bytehash.PRIME)) for _ in range(3000)] + [(bytehash.PRIME - 1, bytehash.PRIME - 1), (0, 5), (1, bytehash.PRIME - 1)]
    made = bytehash.multiply(*(np.array(x, np.uint64) for x in zip(*pairs)))
    assert made.tolist() == [a * b % bytehash.PRIME for a, b in pairs]


def test_split_blocks_memory():
    """A map task holds its blocks and a few small pieces, not a batch's texts once more, and sends no large batches."""
    draw = np.random.default_rng(5).integers(97, 123, (10_000, 2000), np.uint8)
    texts = suffix_dedup.batch("doc_id long, text string", np.arange(len(draw)), [row.tobytes().decode() for row in draw])
    split = suffix_dedup.split_blocks(64, 50, 20)
    windows, largest = 0, 0
    for out in split(iter([texts])):
        windows, largest = windows + int(suffix_dedup._unpacked([b.as_py() for b in out.column("blob")])["n"].sum()), max(largest, out.nbytes)
    assert windows == len(draw) * (2000 - 49) and largest < 8 << 20
    del draw, out
    tracemalloc.start()
    for _ in split(iter([texts])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20, peak


def test_parts_of_blocks_are_alike_in_size():
    draw = np.random.default_rng(6).integers(97, 123, 1 << 20, np.uint8).tobytes().decode()
    sizes = collections.Counter()
    for out in suffix_dedup.split_blocks(64, 50, 20)(iter([suffix_dedup.batch("doc_id long, text string", [1], [draw])])):
        for part, blob in zip(out.column("part").to_pylist(), out.column("blob")):
            sizes[part] += len(blob.as_py())
    assert len(sizes) == 64 and max(sizes.values()) < 1.5 * sum(sizes.values()) / 64


def test_suffix_order():
    rnd = random.Random(2)
    data = np.frombuffer("".join(rnd.choice("ab") for _ in range(700)).encode() + bytes(8), np.uint8)
    places, group = np.arange(600), np.repeat([0, 1, 2], 200)
    order = suffix_dedup.Suffixes(data, 60).sort(places, group)
    text = data.tobytes()
    assert [text[p : p + 60] for p in places[order]] == [x for g in range(3) for x in sorted(text[p : p + 60] for p in range(g * 200, g * 200 + 200))]


# 7


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_place_every_piece_once(counts):
    runs, bins = packing.best_plan(counts, 64)
    used, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for k, rank, n, first, offset in runs:
        for i in range(n):
            used[first + i].append((offset, k))
            ranks[k].append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert sorted(used) == list(range(bins))
    for own in used.values():
        at = 0
        for offset, k in sorted(own):
            assert offset == at
            at += k
        assert at <= 64


def test_packing(docs, nothing):
    tokenizer = bpe.load(BYTE)
    rows = packing.pack_documents(docs, BYTE, 64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d, t in set(texts()):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        copies = sum(x == d for x, _ in texts())
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by[d]})
        assert len(by[d]) == copies * len(pieces) and sum(p[2] for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c and n <= 64 for _, s, n, c in pieces)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(nothing, BYTE).count() == 0


def test_very_long_runs_are_packed_and_counted(spark):
    tokenizer = bpe.load(BYTE)
    assert not byte_bpe.has_long_blank((" " * (byte_bpe.LONG_BLANK - 1) + "x") * 3) and byte_bpe.has_long_blank("x" + "\u3000" * byte_bpe.LONG_BLANK)
    long = {1: " " * 1_000_000, 2: "x" + "\n" * 1_200_000 + "y", 3: "a" * 1_000_000, 4: "-" * 1_000_000, 5: "a \n\t" * 300_000, 6: " " * 5_000_000, 7: " " * byte_bpe.LONG_BLANK, 8: "z" + " " * (byte_bpe.LONG_BLANK - 1) + "z"}
    docs = spark.createDataFrame(list(long.items()), "doc_id long, text string").repartition(4)
    size = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) for d, t in long.items()}
    packed = packing.pack_documents(docs, BYTE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("last"), F.count("*").alias("pieces")).collect()
    assert {r.doc_id: r.n for r in packed} == {d: n + 1 for d, n in size.items()} and all(r.last == r.pieces - 1 for r in packed)
    counted = token_counts.count_tokens(docs, BYTE).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_chars").alias("chars")).collect()
    assert {r.doc_id: (r.n, r.chars) for r in counted} == {d: (n, len(long[d])) for d, n in size.items()}


@pytest.mark.parametrize("run", [" ", "\n", "e", "-"])
def test_runs_of_five_million_encode_as_the_library_does(run):
    text = "x" + run * 5_000_000 + "y"
    assert byte_bpe.shared(BYTE).encode(text) == bpe.load(BYTE).encode(text, add_special_tokens=False).ids


# 8 and 9


def odd_texts():
    rnd = random.Random(6)
    letters = "abcdefghiêéß'.,1 İΣς́🙂\x1c"
    return ["x<|endoftext|>y it's don't 'll ''s", "\x1c\x1fab \xa0 c", "'''s't", "a" * 9000 + "bbb", *("".join(rnd.choice(letters) for _ in range(n)) for n in (10, 300, 9000)), "".join(rnd.choice("ab'st<|>") for _ in range(9000))]


def test_runs_encode_as_the_library_does():
    library, own = bpe.load(WORD), bpe.RunEncoder(WORD)
    given_texts = [t for _, t in texts()] + odd_texts()
    for text, (n, ids, decoded) in zip(given_texts, own.encode(given_texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(expected), " ".join(map(str, expected)).encode(), library.decode(expected, skip_special_tokens=False).encode())


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("leaf", [40, 500])
def test_tree_concatenation(path, leaf):
    library = bpe.load(path)
    for text in odd_texts():
        assert [t[0] for t in bpe.tree_encode(library, text, leaf)] == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab'sterdmlv <|>1.,!éßか🙂"), max_size=120), st.integers(1, 9))
def test_tree_concatenation_from_the_smallest_leaves(text, leaf):
    library = bpe.load(WORD)
    assert [t[0] for t in bpe.tree_encode(library, text, leaf)] == library.encode(text, add_special_tokens=False).ids


def test_texts_are_encoded_by_joins(spark):
    """Whole documents as the library encodes and decodes them, each of more than a leaf by joining its halves."""
    given = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + odd_texts()
    library, own = bpe.load(WORD), bpe.RunEncoder(WORD)
    for text, (n, ids, decoded) in zip(given, own.encode(given)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(expected), " ".join(map(str, expected)).encode(), library.decode(expected, skip_special_tokens=False).encode())
    assert own.joins == sum(len(bpe.halves(len(t), bpe.LEAF)) - 2 for t in given) > len(given) and own.windows >= own.joins


def test_other_files_go_through_the_library():
    own, library = bpe.RunEncoder(BYTE), bpe.load(BYTE)
    assert not own.splits
    for text, (n, ids, decoded) in zip(odd_texts(), own.encode(odd_texts())):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, expected)).encode() and decoded == library.decode(expected, skip_special_tokens=False).encode()


def test_the_memo_is_bounded_by_bytes(monkeypatch):
    own = bpe.RunEncoder(WORD)
    monkeypatch.setattr(bpe, "MEMO", 4000)
    for i in range(20):
        list(own.encode([f"word{i}{j} " * 3 for j in range(10)]))
        assert own.held <= 4000 + 10 * 2 * (bpe.EACH + 200) and len(own.ids) == len(own.tokens)


def test_encoded_documents(docs, nothing):
    library = bpe.load(WORD)
    out = bpe.encode_documents(docs, WORD).collect()
    expected = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts()}
    assert len(out) == len(ROWS) and all((r.n_tokens, r.ids_sha256) == (len(expected[r.doc_id]), hashlib.sha256(" ".join(map(str, expected[r.doc_id])).encode()).hexdigest()) for r in out)
    assert bpe.encode_documents(nothing, WORD).count() == 0


def test_each_token_is_made_of_its_listed_pair():
    engine = byte_bpe.ByteBpe(BYTE)
    assert engine.fast is not None
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5}
    assert byte_bpe.split_before(b"abc", ranks) == [b"ab", b"c"]


def test_quality_rules_on_empty_tables(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.apply_rules(nothing, none).count() == 0
    rows = frame(spark, [(1, "a " * 30, "en"), (1, "a " * 30, "en"), (2, None, None)])
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in quality_rules.apply_rules(rows, none).collect()) == [(1, True, False), (1, True, False), (2, True, False)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, nothing, rule):
    engine, library = byte_bpe.ByteBpe(BYTE), bpe.load(BYTE)
    out = collections.defaultdict(dict)
    for r in token_counts.count_tokens(docs, BYTE, rule).collect():
        out[r.doc_id][r.section] = (r.n_chars, r.n_tokens, r.n_crossing)
    for d, t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert ids == engine.encode(t)
        lines = re.findall(r"[^\n]*\n|[^\n]+", t) or [""]
        owner = [i for i, line in enumerate(lines) for _ in line.encode()]
        counts, at = collections.Counter(), 0
        for i in ids:
            own = owner[at : at + len(engine.bytes[i])]
            counts[own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)] += 1
            at += len(own)
        assert {i: c[:2] for i, c in out[d].items()} == {i: (len(line), counts[i]) for i, line in enumerate(lines)}, d
    assert token_counts.count_tokens(nothing, BYTE).count() == 0


# 10


def test_fingerprints(spark, nothing):
    rows = [r for r in ROWS[:-2] if r[0] != 50]
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark, rows).repartition(3)).collect()}
    order = sorted(texts(rows), reverse=True)
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert (out[d].n_chars, out[d].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (out[d].fingerprint == out[d].edited_fingerprint) == (t == changed) and 0 <= out[d].near_next <= 1
        assert 0 <= out[d].near_edited <= 1 and (t != changed or out[d].near_edited == 1)
    same = collections.defaultdict(set)
    for d, t in texts(rows):
        same[t].add(out[d].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)
    assert fingerprints.fingerprint_documents(nothing).count() == 0


def test_likeness_is_read_from_the_fingerprints(spark, docs):
    units = lambda printed: set(re.findall("[0-9a-f]{8}", printed[64:]))
    out = fingerprints.fingerprint_documents(docs.dropDuplicates(["doc_id"])).collect()
    following = {r.doc_id: r.fingerprint for r in out}
    order = sorted(following, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    for r in out:
        for other, said in ((r.edited_fingerprint, r.near_edited), (following[after[r.doc_id]], r.near_next)):
            a, b = units(r.fingerprint), units(other)
            assert said == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0)
        assert len(r.fingerprint.split("/")) == 1 + r.n_sections


def test_differing_branches_locate_an_edit(spark):
    df = spark.createDataFrame([("a b.\nc d. e f.\ng", "a b.\nc d. e X.\ng\nh"), ("same", "same"), (None, "")], "a string, b string")
    x, y = (fingerprints.printed(fingerprints.tree(F.col(c))) for c in "ab")
    assert [r[0] for r in df.select(fingerprints.differing_sections(x, y)).collect()] == [[1, 3], [], []]


def test_fingerprints_of_ties_and_null_ids(spark):
    out = fingerprints.fingerprint_documents(frame(spark, [(1, "b", "x"), (1, "a", "x"), (None, "zz", "x"), (2, None, "x")])).collect()
    assert len(out) == 4 and {r.edited_sha256 for r in out if r.doc_id is None} == {hashlib.sha256(b"z").hexdigest()}
