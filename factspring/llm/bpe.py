"""BPE encoding and decoding by tree concatenation, with vocabulary files of public tokenizers.

A text is halved, wherever its middle lies, until no part has more than ``LEAF`` code points. All leaves of some texts
are encoded as one batch; then, level by level, neighbours are joined: a window around the cut is encoded anew and
grows until its first tokens agree with the left side's and its last ones with the right side's. Below the leaves, runs
that white space bounds are encoded once and remembered, since no merge reaches over white space.

Why one agreeing token is enough. A sequence of tokens is the BPE encoding of its letters if and only if each two
neighbours are the encoding of theirs, provided that each token is made by one merge only (checked when a file is
loaded). Neighbours left of an agreeing token stand so in one complete encoding, those right of it in another, so all
stand in the joined one. That the token lies in pre-tokens which end alike on both sides follows from its id: with an
end mark both sides split there, and splitting looks at nothing before its own position; without one both go on, in
classes (letters, a digit, others, a contraction) that the token's letters and the next one decide.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .arrow_io import batch, tidy, utf8
from .staging import ship

LEAF = 256  # code points of a leaf at most
EDGE = 2  # runs, or tokens of a long run, on each side of a cut that the first window holds
MEMO, EACH = 160 << 20, 180  # bytes of runs and their tokens that a worker remembers, and of the objects that hold one run

Token = tuple[int, int, int]  # id, start, end


def load(path: str) -> Tokenizer:
    """A tokenizer without truncation and padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def halves(n: int, leaf: int) -> list[int]:
    """Ends of the leaves of n code points that are halved until none has more than ``leaf``."""
    parts = 1
    while n > parts * leaf:
        parts *= 2
    return [i * n // parts for i in range(parts + 1)]


def _tokens(encoding, shift: int) -> list[Token]:
    return [(i, a + shift, b + shift) for i, (a, b) in zip(encoding.ids, encoding.offsets)]


def _meet(side: list[Token], window: list[Token], last: bool) -> tuple[int, int] | None:
    """Index in both of the first (or last) token of the window that the side has too. Tokens of parts of a character don't count: their spans don't tell them apart."""
    at = {t: i for i, t in enumerate(side) if (i == 0 or side[i - 1][1] < t[1]) and (i + 1 == len(side) or side[i + 1][2] > t[2])}
    for j in range(len(window) - 1, -1, -1) if last else range(len(window)):
        if window[j] in at:
            return at[window[j]], j
    return None


def _join(tokenizer: Tokenizer, text: str, left: list[Token], right: list[Token], low: int, high: int) -> list[Token]:
    """Tokens of text[low:high] from those of its halves: windows around the join grow until both sides agree."""
    w = EDGE
    while True:
        whole_left, whole_right = w >= len(left), w >= len(right)
        start = low if whole_left else left[-w][1]
        end = high if whole_right else right[w - 1][2]
        window = _tokens(tokenizer.encode(text[start:end], add_special_tokens=False), start)
        first = (0, 0) if whole_left else _meet(left[-w:], window, last=False)
        last = (0, len(window) - 1) if whole_right else _meet(right[:w], window, last=True)
        if first and last and first[1] <= last[1] + 1:
            head = [] if whole_left else left[: len(left) - w + first[0]]
            tail = [] if whole_right else right[last[0] + 1 :]
            return head + window[first[1] : last[1] + 1] + tail
        w *= 2


def tree_encode(tokenizer: Tokenizer, text: str, leaf: int = LEAF) -> list[Token]:
    """Tokens of a text with their code point spans, as the whole text's encoding has them. The text must be as the tokenizer normalises it and hold no added token."""
    cuts = halves(len(text), leaf)
    level = [_tokens(e, a) for e, a in zip(tokenizer.encode_batch([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False), cuts)]
    while len(level) > 1:
        level = [_join(tokenizer, text, level[i], level[i + 1], cuts[i], cuts[i + 2]) for i in range(0, len(level), 2)]
        cuts = cuts[::2]
    return level[0]


_RUN = re.compile(r"[^ \t\n\r]+")
#: Texts of Latin letters up to U+017F (no U+0130) that hold no contraction mark and no added token split at each change
#: between letters and others too, in lower case: nothing the tokenizer does reaches over such a place there.
_OTHER = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]|'|<\\|")
_FINE = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u0101-\u017f]+|[^\\sa-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u0101-\u017f]+")

#: What the splitting above relies on; a file with other settings is encoded by the library, text by text.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def folds_and_splits(spec: dict) -> bool:
    """Whether a tokenizer file folds case, drops white space, marks ends of words, has no decoder, and makes each token by one merge."""
    model, pre = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    return (
        [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == _NORMALIZERS
        and (pre[0].get("pattern"), pre[0].get("behavior"), pre[0].get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
        and (pre[1].get("type"), pre[1].get("add_prefix_space"), pre[1].get("use_regex")) == ("ByteLevel", False, False)
        and (spec["decoder"], spec["post_processor"]) == (None, None)
        and (model["type"], model["dropout"], model["end_of_word_suffix"], model["ignore_merges"]) == ("BPE", None, "</w>", False)
        and len(set(merged)) == len(merged)
        and all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    )


class _Tree:
    """A text with the runs of its parts between ``cuts``."""

    def __init__(self, text: str):
        self.pattern = _RUN if _OTHER.search(text) else _FINE
        self.text = text if self.pattern is _RUN else text.lower()
        self.cuts = halves(len(text), LEAF)
        self.nodes: list[list[str]] = [self.pattern.findall(self.text, a, b) for a, b in zip(self.cuts, self.cuts[1:])]

    def window(self, i: int, w: int) -> list[str]:
        """Runs of the text from the w-th run before the cut between parts i and i + 1 to the w-th after it."""
        left, right = self.nodes[i], self.nodes[i + 1]
        start, end = self.cuts[i], self.cuts[i + 2]
        if w < len(left):
            start = self.cuts[i + 1]
            for run in left[: -w - 1 : -1]:  # nothing but white space lies behind a run that is sought from behind
                start = self.text.rfind(run, 0, start)
        if w < len(right):
            end = self.cuts[i + 1]
            for run in right[:w]:
                end = self.text.find(run, end) + len(run)
        return self.pattern.findall(self.text, start, end)

    def joined(self, i: int, w: int, window: list[str]) -> list[str] | None:
        """Runs of parts i and i + 1 together; None if the window doesn't agree with both: runs that are equal and begin (end) at one place have the same tokens at the same places."""
        left, right = self.nodes[i], self.nodes[i + 1]
        whole_left, whole_right = w >= len(left), w >= len(right)
        if not (whole_left or window[0] == left[-w]) or not (whole_right or window[-1] == right[w - 1]):
            return None
        return [*([] if whole_left else left[:-w]), *window, *([] if whole_right else right[w:])]


class RunEncoder:
    """Encodes and decodes texts as the library does with the file at ``path``; ``joins`` and ``windows`` count what was joined and encoded for it."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer, self.splits = load(path), folds_and_splits(spec)
        self.added = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")") if spec["added_tokens"] else None
        self.ids: dict[str, bytes] = {}  # a run's ids in decimal, each after a space
        self.tokens: dict[str, bytes] = {}  # its tokens, likewise
        self.held = self.joins = self.windows = 0
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [b" " + (self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.numbers = [b" %d" % i for i in range(size)]

    def _long(self, run: str) -> list[int]:
        """Ids of one unsplit run of more than a leaf, by tree concatenation of its tokens."""
        ids: list[int] = []
        for part in self.added.split(run) if self.added else [run]:
            whole = self.tokenizer.normalizer.normalize_str(part)
            if not part or self.added and self.added.search(whole) or self.tokenizer.normalizer.normalize_str(whole) != whole:
                ids += self.tokenizer.encode(part, add_special_tokens=False).ids  # an added token, or letters that fold twice
            else:
                ids += [t[0] for t in tree_encode(self.tokenizer, whole)]
        return ids

    def _learn(self, runs: set[str]) -> None:
        new = list(runs.difference(self.ids))
        short = [r for r in new if len(r) <= LEAF]
        found = [(r, e.ids) for r, e in zip(short, self.tokenizer.encode_batch_fast(short, add_special_tokens=False))]
        for run, ids in [*found, *((r, self._long(r)) for r in new if len(r) > LEAF)]:
            self.ids[run] = b"".join([self.numbers[i] for i in ids])
            self.tokens[run] = b"".join([self.names[i] for i in ids])
            self.held += EACH + len(run) + len(self.ids[run]) + len(self.tokens[run])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text: number of ids, ids in decimal, decoded text."""
        if not self.splits:
            for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
                yield len(e.ids), " ".join(map(str, e.ids)).encode(), self.tokenizer.decode(e.ids, skip_special_tokens=False).encode()
            return
        if self.held > MEMO:
            self.ids.clear()
            self.tokens.clear()
            self.held = 0
        trees = [_Tree(t) for t in texts]
        self._learn(set().union(*(runs for t in trees for runs in t.nodes)))
        while any(len(t.nodes) > 1 for t in trees):
            made: dict[tuple[int, int], list[str]] = {}
            todo, w = [(k, i) for k, t in enumerate(trees) for i in range(0, len(t.nodes) - 1, 2)], EDGE
            self.joins += len(todo)
            while todo:
                windows = [trees[k].window(i, w) for k, i in todo]
                self.windows += len(windows)
                self._learn(set().union(*windows))
                for (k, i), window in zip(todo, windows):
                    runs = trees[k].joined(i, w, window)
                    if runs is not None:
                        made[k, i] = runs
                todo, w = [x for x in todo if x not in made], 2 * w
            for k, t in enumerate(trees):
                if len(t.nodes) > 1:
                    t.nodes, t.cuts = [made[k, i] for i in range(0, len(t.nodes), 2)], t.cuts[::2]
        for t in trees:
            ids = b"".join(map(self.ids.__getitem__, t.nodes[0]))[1:]
            yield ids.count(b" ") + 1 if ids else 0, ids, b"".join(map(self.tokens.__getitem__, t.nodes[0]))[1:]


_encoders: dict[str, RunEncoder] = {}
ENCODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TILE = 1 << 19


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its one core; batches are spread over cores elsewhere
        encoder = _encoders.get(path) or _encoders.setdefault(path, RunEncoder(path))
        for given in batches:
            texts = utf8(given.column("text"))
            rows: list[tuple[int, str, str]] = []
            a = size = 0
            for b, t in enumerate(texts, 1):
                size += len(t)
                if size >= TILE or b == len(texts):
                    for n, ids, decoded in encoder.encode([x.decode("utf-8", "replace") for x in texts[a:b]]):
                        rows.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                    a, size = b, 0
            yield batch(ENCODED_SCHEMA, given.column("doc_id"), *(zip(*rows) if rows else ([], [], [])))

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, whole texts, as the library's encode and decode give them.

    A null text counts as empty: no tokens, and the hashes of nothing. Rows are independent: repeated rows and rows
    with a null doc_id come out as they are; other columns are left out. A text of any length is held by one task.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(_encode_batches(path)), ENCODED_SCHEMA)
