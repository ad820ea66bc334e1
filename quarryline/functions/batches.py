"""Python functions of one row's values as columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Rows whose values a worker has as Python objects at once.
HELD = 32


def each(f: Callable, kind: pa.DataType, *columns: Column | str) -> Column:
    """`f` of each row's values.

    Spark sends batches of up to 10,000 rows or 64 MB. A batch stays in Arrow's
    memory, and only `HELD` rows at a time become Python objects, so that a
    worker needs little more than the batch and its results.
    """

    def run(*batch: pa.Array) -> pa.Array:
        starts = range(0, max(1, len(batch[0])), HELD)
        return pa.concat_arrays([pa.array(map(f, *(x.slice(i, HELD).to_pylist() for x in batch)), kind) for i in starts])

    return F.arrow_udf(run, from_arrow_type(kind))(*columns)
