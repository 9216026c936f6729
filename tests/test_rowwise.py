"""What Python holds at once on an executor: caches and batches are bounded whatever passes."""

import tracemalloc

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type

from folianth.functions import text
from folianth.operators import voting as V


def test_caches_keep_no_long_texts():
    for f in (text.fold, text.tidy_name, text.is_name, text.name):
        f("Ana Lee")
        before = f.cache_info().currsize
        for i in range(20):
            f(f"{i} " + "Žena piše " * 100)
        assert f.cache_info().currsize == before
    assert text.fold("Žena " * 1000) == "zena " * 1000


def test_votes_are_python_objects_a_slice_at_a_time():
    rows, votes = 3000, [{"source": s, "name": n} for s in ("tags", "folder") for n in ("Vuk Mimica", "Tea Zubak")] * 12
    column = lambda value, kind: pa.array([value], kind).take(pa.array([0] * rows))
    none = pa.list_(pa.string())
    columns = [column(votes, to_arrow_type(V.CANDIDATES)), column(None, pa.string()), column("", pa.string()), column([], pa.list_(none)), column([], none), column([], none)]
    tracemalloc.start()
    out = V._decide.func(*columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all rows at once are over 30 MB
    assert len(out) == rows and out[rows - 1].as_py()["author"] == "Vuk Mimica" and len(out[0].as_py()["candidates"]) == 2
