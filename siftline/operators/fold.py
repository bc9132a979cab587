"""State machines over a key's events in order, as one pass over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold_sorted(events: DataFrame, key: str, values: list[Column], step: Callable[..., tuple[Any, tuple]], out: str) -> DataFrame:
    """key and what step returns, for each event.

    step(state, *values) -> (state, row); the state is None at a key's first event. Events come in the order of the values, nulls
    first. A task holds a state and a batch of rows, however many events a key has.
    """
    names = [f"v{i}" for i in range(len(values))]
    schema = StructType([events.schema[key], *_parse_datatype_string(out).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = object(), None
        for batch in batches:
            rows = []
            for k, *x in zip(*(c.to_pylist() for c in batch.columns)):
                if own != k:
                    own, state = k, None
                state, row = step(state, *x)
                rows.append((k, *row))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    flat = events.select(F.col(key).alias("k"), *[v.alias(n) for v, n in zip(values, names)])
    return flat.repartition("k").sortWithinPartitions("k", *names).mapInArrow(run, schema)
