"""Order-dependent algorithms over many small groups, without a call of pandas for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship


def by_group(df: DataFrame, keys: list[str], order: list[str], make: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``make`` of each group's rows (dicts, in ``order``): groups lie side by side in sorted partitions and are streamed; one group at a time is held whole."""
    ship(df.sparkSession)
    columns, names = df.columns, [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for frame in frames:
            out: list[tuple] = []
            for values in zip(*(frame[c].tolist() for c in columns)):
                row = dict(zip(columns, values))
                if held and not all(row[k] == held[0][k] or row[k] != row[k] and held[0][k] != held[0][k] for k in keys):  # missing numbers are NaN
                    out += make(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(make(held), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
