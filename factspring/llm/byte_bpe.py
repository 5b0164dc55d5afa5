"""Ids of a byte-level BPE and the bytes that each id stands for."""

from __future__ import annotations

import json

import numpy as np
import tiktoken

from .bpe import load

#: White space that the second engine isn't given in one run: it backs up through such a run one character at a time and ends the process at about a million.
LONG_BLANK = 10_000
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])  # no higher character is white space


def has_long_blank(text: str) -> bool:
    """Whether ``LONG_BLANK`` characters of white space stand on end, in time linear in the text."""
    if len(text) < LONG_BLANK:
        return False
    other = np.flatnonzero(~_BLANK[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), len(_BLANK) - 1)])
    return int(np.diff(other, prepend=-1, append=len(text)).max()) > LONG_BLANK


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_before(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that merges of lower rank than the token's make of its bytes: they must be the pair that the file lists for it, as the engine merges any two parts that make a token."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= own:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteBpe:
    """Encodes as the tokenizers library does with the file at ``path``, without special tokens added.

    The file's vocabulary runs in a second, faster engine where that must give the same ids: the file's ids follow
    its merges' order, each token is made of the pair listed for it, and no added token and no ``LONG_BLANK`` characters of white space on end stand in the text. Other texts go through tokenizers itself.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = load(path)
        self.added = [t["content"] for t in spec["added_tokens"]]
        letters = _byte_of()
        ranks, self.bytes = {}, [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in spec["model"]["vocab"].items():
            if token not in self.added:
                ranks[bytes(letters[c] for c in token)] = i
                self.bytes[i] = bytes(letters[c] for c in token)
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        pairs = [tuple(bytes(letters[c] for c in part) for part in (m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        if plain and merged == sorted(merged) and all(split_before(a + b, ranks) == [a, b] for a, b in pairs):
            import public_tokenizers

            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added) or has_long_blank(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_loaded: dict[str, ByteBpe] = {}


def shared(path: str) -> ByteBpe:
    """One for each worker process."""
    return _loaded.get(path) or _loaded.setdefault(path, ByteBpe(path))
