"""Apply decisions on narrow rows to whole documents, moving as few texts as possible.

Decisions are keyed by id and a hash of the text, so rows that share an id stay apart, and rows alike in both get
the same decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bloom import Bloom, from_keys
from ._util import durable

ID, HASH = "__rid", "__rhash"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn(ID, F.col(id_col)).withColumn(HASH, F.xxhash64(F.lit(1), F.col(text_col)))


def _filter(keys: DataFrame, tag: str) -> Bloom:
    return from_keys(keys, F.xxhash64(ID, HASH), keys.count(), tag)


def _same(a: DataFrame, b: DataFrame):
    return a[ID].eqNullSafe(b[ID]) & (a[HASH] == b[HASH])


def without(docs: DataFrame, dropped: DataFrame, tag: str) -> DataFrame:
    """Rows of docs (keyed) whose key is not in dropped.  Only rows that may be in it shuffle; all others pass straight through."""
    dropped = durable(dropped.select(ID, HASH).distinct(), tag)
    tested = _filter(dropped, tag + "-filter").maybe(docs, F.xxhash64(ID, HASH), "__maybe")
    maybe = tested.where("__maybe").drop("__maybe")
    return tested.where("not __maybe").drop("__maybe").unionByName(maybe.join(dropped, _same(maybe, dropped), "left_anti"))


def once(docs: DataFrame, repeated: DataFrame, tag: str) -> DataFrame:
    """docs (keyed) with one row for each key of repeated; rows of other keys are not touched."""
    repeated = durable(repeated.select(ID, HASH).distinct(), tag)
    if repeated.isEmpty():
        return docs
    tested = _filter(repeated, tag + "-filter").maybe(docs, F.xxhash64(ID, HASH), "__maybe")
    maybe = tested.where("__maybe").drop("__maybe")
    met = maybe.join(repeated, _same(maybe, repeated), "left_semi").dropDuplicates([ID, HASH])
    return tested.where("not __maybe").drop("__maybe").unionByName(maybe.join(repeated, _same(maybe, repeated), "left_anti")).unionByName(met)
