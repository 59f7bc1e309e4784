"""Sequential work per key without holding a key's rows: partitions sorted by key and time, streamed through a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def stream_by_key(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[Any], Callable[[Any], list[tuple]]]) -> DataFrame:
    """For each key, `start(key)` gives a function that takes the key's rows (named tuples) in `order` and returns output
    rows. Rows pass in Arrow batches; only the state of the current key is held, so a key of any size is bounded work per
    batch. A key is one sequence by nature and stays in one task."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = object(), None
        for p in parts:
            out: list[tuple] = []
            for row in p.itertuples(index=False):
                k = getattr(row, key)
                if step is None or k != current:
                    current, step = k, start(k)
                out += step(row)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
