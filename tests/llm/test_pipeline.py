"""The pipeline: each stage on what the one before kept, and its rows against a plain version."""

from collections import Counter

import pytest

from .common import HAVE, LONG, SF, documents
from .test_lines_and_windows import key, plain_windows
from .test_packing import check
from .test_similarity import plain

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_run_equals_plain_stages(spark):
    from folianth.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in queries.op3_quality_classifier(spark, SF).where("predicted = 1").collect()}
    left = {i: t for i, t in docs.items() if i in good}
    held = {}
    for i in sorted(left):
        for x in (left[i] or "").split("\n"):
            held.setdefault(key(x), i)
    rest = {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or held[key(x)] == i) for i, t in left.items()}
    left = {i: t for i, t in rest.items() if t == (left[i] or "") or t.strip(" \t\n\x0b\x0c\r")}
    classes = plain(list(left.items()))
    left = {i: left[i] for (i, c, *_), _ in classes.items() if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = {i: t for i, t in left.items() if not next(iter(plain_windows([(i, t)], items)))[-1]}
    assert check(pipeline.run(spark, SF).collect(), list(left.items()), 4096) == 0


def test_emptied_documents_make_no_pieces(spark):
    """A document that loses all lines to an earlier one is gone before it is packed; awkward and no rows pass through."""
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(pipeline.STAGES)
    copies = docs.union(spark.createDataFrame([(900, LONG + "\n" + LONG, "en", "s", 9)], docs.schema))
    kept = stages["line dedup"](spark, copies, SF)
    assert kept.where("doc_id = 900 or (text = '' and doc_id in (8, 9))").count() == 0 and kept.where("doc_id in (0, 1, 2)").count() == 3
    assert {r.doc_id for r in stages["packing"](spark, kept, SF).collect()} == {r.doc_id for r in kept.collect()}


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_stages_of_awkward_and_no_rows(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() > 0


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and Counter(out.dtypes) == Counter(docs.dtypes)
        docs = out
