"""Rows looked up in the table of their classes, where one class, or no class, may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A class with more rows than this is hot: it is copied once for each salt, which its rows are dealt over.
HOT_ROWS, SALTS = 256, 64


def of_class(rows: DataFrame, classes: DataFrame, on: list[str], many: str, salt: list[str]) -> DataFrame:
    """rows with the further columns of their class, null without one.

    classes has one row for each value of on, and in many how many rows it has. salt names columns of rows that differ among
    the rows of a class. Rows with a null in on have no class.
    """
    values = [c for c in classes.columns if c not in (*on, many)]
    own = F.struct(*values)
    hot = classes.filter(F.col(many) > HOT_ROWS).select(*on, own.alias("_hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    cold = classes.filter(F.col(many) <= HOT_ROWS).select(*on, own.alias("_cold"), F.least(F.col(many), F.lit(0)).cast("int").alias("_spot"))
    has = F.col("_hot").isNull()
    for c in on:
        has = has & F.col(c).isNotNull()
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int")).join(hot, [*on, "_salt"], "left")
    # _spot is 0 in the cold table, but not as a literal, which would make it a filter instead of a key;
    # rows that are done or have no class stay dealt over the salts, all others meet their class at 0
    found = dealt.withColumn("_spot", F.when(has, 0).otherwise(F.col("_salt"))).join(cold, [*on, "_spot"], "left").withColumn("_of", F.coalesce("_hot", "_cold"))
    return found.select(*rows.columns, *[F.col("_of")[v].alias(v) for v in values])
