"""An answer ledger: what a model was asked and what it said, so that nothing answered is asked again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tickerloom.session import durable_path, durable_table
from tickerloom.sources import store

ANSWERS = "key string, reply string, error string, asked_at timestamp, task string"
#: About so many prompts are asked between two writes: what a run that breaks off loses at most.
BATCH_ROWS = 100_000


def key_of(prompt: Column) -> Column:
    """One key per prompt text; a null prompt has one, too."""
    return F.coalesce(F.sha2(prompt, 256), F.lit("null"))


@dataclass(frozen=True)
class Ledger:
    """Answers in a folder. ``task`` names the model and whatever else an answer
    depends on besides the prompt; tasks don't see each other's answers."""

    path: str
    task: str
    batch_rows: int = BATCH_ROWS

    def entries(self, spark: SparkSession) -> DataFrame:
        return store.read(spark, self.path, T.StructType.fromDDL(ANSWERS)).where(F.col("task") == self.task)

    def answers(self, spark: SparkSession) -> DataFrame:
        """key, reply, error: of each key the answer, or the last error if there is none."""
        best = Window.partitionBy("key").orderBy(F.col("error").isNull().desc(), F.col("asked_at").desc())
        return self.entries(spark).withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select("key", "reply", "error")

    def open(self, prompts: DataFrame) -> DataFrame:
        """``key, prompt`` of the prompts without an answer, each once."""
        answered = self.entries(prompts.sparkSession).where("error IS NULL").select("key").distinct()
        return prompts.select(key_of(F.col("prompt")).alias("key"), "prompt").join(answered, "key", "left_anti").dropDuplicates(["key"])

    def ask(self, prompts: DataFrame, score: Callable[[DataFrame], DataFrame]) -> None:
        """Ask what is open, batch by batch; each batch's answers are written before the next is asked.

        ``score`` adds ``reply`` and ``error`` to rows of ``key, prompt``. A batch
        is written whole or not at all, so a run that breaks off loses one batch
        of answers, and the next run asks only what has none. Failed prompts are
        written with their error and are open again in the next run.
        """
        spark = prompts.sparkSession
        todo, path = durable_table(self.open(prompts)), durable_path(spark)
        batches = -(-todo.count() // self.batch_rows)
        if not batches:
            return
        store.write(todo.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches))), path, ["batch"])
        whole = spark.read.schema("key string, prompt string, batch long").parquet(path)
        for (batch,) in whole.select("batch").distinct().orderBy("batch").collect():
            answered = score(whole.where(F.col("batch") == batch).drop("batch"))
            self._append(answered.select("key", "reply", "error", F.current_timestamp().alias("asked_at"), F.lit(self.task).alias("task")))

    def _append(self, answered: DataFrame) -> None:
        answered.write.mode("append").partitionBy("task").parquet(self.path)

    def answered(self, rows: DataFrame, prompt: Column, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``rows`` with ``reply`` and ``error`` of their prompts, of which only open ones are asked."""
        self.ask(rows.select(prompt.alias("prompt")), score)
        known = self.answers(rows.sparkSession).withColumnRenamed("key", "_key")
        return rows.withColumn("_prompt", key_of(prompt)).join(known, F.col("_prompt") == F.col("_key"), "left").drop("_prompt", "_key")
