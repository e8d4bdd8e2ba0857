"""A stream over a landing folder of turn rows: documents are rebuilt batch by batch.

The engine's own increment is a batch over file state (operators.tables), since a stream of files doesn't see changed ones.
This front end is for logs that are landed as new files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions import privacy

TURN_ROWS = "source string, conv_id string, project string, idx int, role string, ts timestamp, text string"


def read_turns(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(TURN_ROWS).option("maxFilesPerTrigger", files_per_batch).json(path)


def activity(turns: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Turns, user characters and confidential turns per source and window; later rows than ``late`` are left out."""
    level = privacy.Policy().classify(F.col("project"), F.col("text"))
    return turns.withWatermark("ts", late).groupBy(F.window("ts", width), "source").agg(
        F.count("*").alias("turns"), F.sum(F.when(F.col("role") == "user", F.length("text")).otherwise(0)).alias("user_chars"), F.count_if(level == privacy.NDA).alias("nda_turns")
    )


def write_documents(turns: DataFrame, path: str, checkpoint: str, policy: privacy.Policy | None = None):
    """Classified and redacted turns of each batch go to ``path``/batch=N; writing a batch again replaces it."""
    policy = policy or privacy.Policy()

    def one(batch: DataFrame, n: int) -> None:
        level = policy.classify(F.col("project"), F.col("text"))
        batch.withColumn("sensitivity", level).withColumn("text", privacy.redact_secrets(F.col("text"))).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return turns.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()
