"""Tokens of the sections of a text: the whole text is encoded once, its tokens' spans are joined to the sections' spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import byte_bpe
from .arrow_io import batch, tidy, utf8
from .staging import ship

COUNT_SCHEMA = "doc_id long, section int, n_chars long, n_tokens long, n_crossing long"
RULES = ("first", "last", "longest")


def attribute(starts: np.ndarray, lengths: np.ndarray, begins: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """For each section (begins, the first at 0, none empty) its tokens, and those of its tokens that reach into a later one.

    A token that crosses a boundary goes whole to one section: that of its first byte, of its last, or the one
    with most of its bytes (of equals the earliest).
    """
    first = np.searchsorted(begins, starts, "right") - 1
    last = np.searchsorted(begins, starts + np.maximum(lengths, 1) - 1, "right") - 1
    own = last if rule == "last" else first.copy()
    if rule == "longest":
        for t in np.flatnonzero(first != last):
            edges = np.clip(np.append(begins[first[t] : last[t] + 1], starts[t] + lengths[t]), starts[t], None)
            own[t] = first[t] + int(np.diff(edges).argmax())
    return np.bincount(own, minlength=len(begins)), np.bincount(own[first != last], minlength=len(begins))


def _count(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.shared(path)
        for given in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc, data in zip(given.column("doc_id").to_pylist(), utf8(given.column("text"))):
                codes = np.frombuffer(data, np.uint8)
                begins = np.append(0, np.flatnonzero(codes[:-1] == 10) + 1)
                lengths = encoder.lengths[encoder.encode(data.decode("utf-8", "replace"))] if data else np.zeros(0, np.int64)
                tokens, crossing = attribute(np.cumsum(lengths) - lengths, lengths, begins, rule)
                chars = np.add.reduceat((codes & 0xC0) != 0x80, begins, dtype=np.int64) if data else np.zeros(1, np.int64)
                for column, values in zip(columns, (np.full(len(begins), -1 if doc is None else doc), np.arange(len(begins)), chars, tokens, crossing)):
                    column.append(values)
                if doc is None:
                    columns[0][-1] = np.full(len(begins), None, object)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            yield batch(COUNT_SCHEMA, *flat)

    return run


def count_tokens(docs: DataFrame, path: str, rule: str = "first") -> DataFrame:
    """``doc_id, section, n_chars, n_tokens, n_crossing``: a row for each line (its newline included) of every row's text.

    A null or empty text has one section without tokens. Rows are independent: repeated rows and null ids come out as they are. The sections' tokens sum to the whole text's.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(_count(path, rule)), COUNT_SCHEMA)
