"""Deltas of a stream in levels: as many folders as the number of batches has digits, and a list of those that count.

Each micro-batch adds a folder on level 0. Whenever a level holds ``fan`` folders, they become one of the next level with the
last row per key. So batch n has n + 1 = sum of d(k) * fan^k rows of batches in d(k) folders per level k: which folders count
follows from the number of the batch alone. Batches write under their own number, so a batch that is replayed after a
failure replaces what it had written, and reads what earlier batches had left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscape.operators.latest import latest
from trialscape.session import drop_scratch


@dataclass(frozen=True)
class Levels:
    """The last row per key by ``seq`` of all batches added, below ``path``."""

    path: str
    keys: list[str]
    seq: str
    fan: int = 4

    def live(self, number: int) -> list[str]:
        """The folders that hold batches 0 to ``number``."""
        found, end, size, digits = [], number + 1, 1, []
        while end // size:
            digits.append(end // size % self.fan)
            size *= self.fan
        first = 0
        for level in reversed(range(len(digits))):
            for _ in range(digits[level]):
                first += self.fan**level
                found.append(f"level={level}/upto={first - 1}")
        return found

    def _merged(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return latest(spark.read.parquet(*[f"{self.path}/{f}" for f in folders]), self.keys, self.seq)

    def add(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch, self.keys, self.seq).write.mode("overwrite").parquet(f"{self.path}/level=0/upto={number}")
        level, size = 0, 1
        while (number + 1) % (size * self.fan) == 0:
            parts = [f"level={level}/upto={number - i * size}" for i in range(self.fan)]
            self._merged(spark, parts).write.mode("overwrite").parquet(f"{self.path}/level={level + 1}/upto={number}")
            level, size = level + 1, size * self.fan
        listed = spark.createDataFrame([(f,) for f in self.live(number)], "folder STRING")
        listed.write.mode("overwrite").parquet(f"{self.path}/live/batch={number}")
        # the batch before is committed, so what it merged can't be asked for again
        old = {*self._made(number - 1), *(self.live(number - 2) if number > 1 else [])}
        for folder in old - {*self.live(number), *self.live(number - 1)}:
            drop_scratch(spark, f"{self.path}/{folder}")
        if number > 1:
            drop_scratch(spark, f"{self.path}/live/batch={number - 2}")

    def _made(self, number: int) -> list[str]:
        """The folders that batch ``number`` wrote."""
        levels = (n for n in range(number.bit_length() + 2) if number >= 0 and (number + 1) % self.fan**n == 0)
        return [f"level={n}/upto={number}" for n in levels]

    def last(self, spark: SparkSession) -> int | None:
        """The last batch whose folders are complete."""
        try:
            return spark.read.parquet(f"{self.path}/live").agg(F.max("batch")).first()[0]
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
                return None
            raise

    def read(self, spark: SparkSession, number: int | None = None) -> DataFrame | None:
        """The rows as of a batch (the last one unless given); None before the first."""
        number = self.last(spark) if number is None else number
        return None if number is None or number < 0 else self._merged(spark, self.live(number))
