"""The library from SQL: functions over texts, and findings of a table as a view.

    from glyphgate.functions import sql
    sql.register(spark)
    sql.view(spark, "findings", "corpus")
    spark.sql("SELECT skeleton(name), sanitize_text(name) FROM names")
    spark.sql("SELECT rule, count(*) FROM findings GROUP BY rule")
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgate.functions.shipping import ship
from glyphgate.functions.unicode_data import shared_tables


def register(spark: SparkSession, folder: str | None = None) -> None:
    """skeleton(word), nfd(text), scripts(word), sanitize_text(text) and normalize_text(text) for this session's SQL; null gives null."""
    from glyphgate.operators.repair import repairer

    ship(spark)
    known = shared_tables(folder)

    def each(one, kind, arrow):
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else one(t) for t in texts.to_pylist()], arrow)

        return F.arrow_udf(run, kind)

    def scripts(word: str) -> list[str]:
        return sorted({s for c in word for s in known.value.scripts_of(c)})

    spark.udf.register("skeleton", each(lambda t: known.value.skeleton(t), T.StringType(), pa.string()))
    spark.udf.register("nfd", each(lambda t: unicodedata.normalize("NFD", t), T.StringType(), pa.string()))
    spark.udf.register("scripts", each(scripts, T.ArrayType(T.StringType()), pa.list_(pa.string())))
    spark.udf.register("repaired", repairer(folder=folder))
    spark.udf.register("normalized", repairer("normalize", folder=folder))
    for name, inner in (("sanitize_text", "repaired"), ("normalize_text", "normalized")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {inner}(t).text")


def view(spark: SparkSession, name: str, table: str, keep: tuple[str, ...] = ("doc_id",), **options) -> None:
    """A view with one row for each finding in the texts of a table or view; ``options`` are those of ``scan``."""
    from glyphgate.plans.scan import scan

    scan(spark.table(table), keep=keep, **options).createOrReplaceTempView(name)
