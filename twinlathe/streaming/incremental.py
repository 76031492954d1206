"""An extension: listings that arrive as files are folded into the cache table.

Each micro-batch of listing rows (rel, size, mtime_ns) is compared with the cache as a
scan would compare it; new and changed files are upserted. A batch that is run again
after a failure finds its rows cached and changes nothing.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinlathe.operators.scan import with_cache
from twinlathe.schema import CACHE_DDL
from twinlathe.sources import state
from twinlathe.storage import materialized

LISTING_DDL = "rel string, size long, mtime_ns long"


def fold(batch: DataFrame, root: str, folder: str | Path) -> DataFrame:
    """The batch's rows with their state; the cache takes in the new and changed ones."""
    spark = batch.sparkSession
    newest = F.row_number().over(Window.partitionBy("rel").orderBy(F.col("mtime_ns").desc(), F.col("size").desc()))
    rows = batch.withColumn("_n", newest).where("_n = 1").drop("_n")
    judged = materialized(with_cache(rows, materialized(state.load_cache(spark, folder, root), "cache")), "judged")
    changed = judged.where("state <> 'cached'").withColumn("root", F.lit(root))
    if not changed.isEmpty():
        state.put(changed.select(*[c.split()[0] for c in CACHE_DDL.split(", ")]), folder, "cache")
    return judged


def follow(spark: SparkSession, source: str, root: str, folder: str | Path, checkpoint: str) -> StreamingQuery:
    """Processes all listing files (JSON lines) that are there, then stops; run again for more."""
    stream = spark.readStream.schema(LISTING_DDL).json(source)
    return stream.writeStream.foreachBatch(lambda batch, _: fold(batch, root, folder) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
