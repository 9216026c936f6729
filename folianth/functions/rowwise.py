"""Plain Python functions of a row as Arrow functions whose memory doesn't grow with the batch or with the texts that pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a batch that are Python objects at once; the others stay Arrow columns, a small part of their size.
SLICE = 256
#: Characters of what a cache keeps, at most. Longer texts hardly come again, and 65,536 of them would be gigabytes.
REMEMBERED_CHARS = 200


def rowwise(kind: T.DataType) -> Callable:
    """Makes an Arrow function of one that takes a row's values and gives its result; for structs a dict or None."""

    def wrap(f: Callable):
        def run(*columns: pa.Array) -> pa.Array:
            out = to_arrow_type(kind)
            parts = [pa.array([f(*row) for row in zip(*(c.slice(i, SLICE).to_pylist() for c in columns))], out) for i in range(0, len(columns[0]), SLICE)]
            return pa.concat_arrays(parts) if parts else pa.array([], out)

        return F.arrow_udf(run, kind, ArrowUDFType.SCALAR)

    return wrap


def remembered(size: int) -> Callable:
    """A cache of ``size`` results of a function of strings; calls with long ones are worked anew."""

    def wrap(f: Callable):
        cached = lru_cache(size)(f)

        @wraps(f)
        def run(*texts: str | None):
            for t in texts:
                if t is not None and len(t) > REMEMBERED_CHARS:
                    return f(*texts)
            return cached(*texts)

        run.cache_info, run.cache_clear = cached.cache_info, cached.cache_clear
        return run

    return wrap
