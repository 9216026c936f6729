"""Titles of records, beside their decided author."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folianth.functions import titling
from folianth.functions.rowwise import rowwise


@rowwise(T.StringType())
def decide_title_udf(path, archive, tag, authors):
    return titling.decide_title(path, archive, tag, [x for x in authors if x])


def title(path: Column, archive: Column, tag: Column, *authors: Column) -> Column:
    return decide_title_udf(path, archive, tag, F.filter(F.flatten(F.array(*authors)), lambda a: a.isNotNull()))
