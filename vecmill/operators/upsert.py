"""Writing rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecmill.session import cut_lineage

# Largest set of updated keys, in bytes, that is broadcast to the base rows.
BROADCAST_BYTES = 32 << 20


def upsert(base: DataFrame, updates: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """``base`` without the rows whose ``key`` is updated, and the update of each key.

    Of several updates of a key the one with the highest ``seq`` is taken; without ``seq``, or with
    equal ones, there is no such row and the call fails, as it does for an update without a key.
    Base rows that no update touches stay as they are, also repeated keys and null keys.

    Updates are cut to one row per key in each task before they are shuffled and then written, so
    that their keys can be measured. Base rows are not moved while the keys are small enough to be
    broadcast; beyond that, both sides are joined by key.
    """
    newest = updates
    if seq is not None:
        order = Window.partitionBy(key).orderBy(F.col(seq).desc_nulls_last())
        newest = updates.withColumn("_rank", F.rank().over(order)).filter("_rank = 1").drop("_rank")
    row = F.struct(*[F.col(f"`{c}`") for c in updates.columns])
    single = newest.groupBy(key).agg(F.first(row).alias("_row"), F.count("*").alias("_n"))
    bad = F.when(F.col(key).isNull(), "update without a key").when(F.col("_n") > 1, "several updates of a key, none the newest")
    checked = single.select(F.when(bad.isNotNull(), F.raise_error(bad).cast(single.schema["_row"].dataType)).otherwise(F.col("_row")).alias("_row"))
    written = cut_lineage(checked.select("_row.*"), "updates")
    keys = written.select(key)
    size = keys.agg(F.sum(8 + F.length(F.col(key).cast("string")))).first()[0] or 0
    untouched = base.join(F.broadcast(keys) if size <= BROADCAST_BYTES else keys.hint("merge"), key, "left_anti")
    return untouched.select(*base.columns).unionByName(written)
