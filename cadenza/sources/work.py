"""Lists of chunks as work that can be stopped at any time, taken up again, and rewound.

The manifest deals the chunks over batches once. A batch's results are a folder of their own, which counts from the moment Spark marks
its write as complete: what was stopped before that is written anew, what is complete isn't run again. Rewinding begins a new
generation and leaves the results of the old ones. One driver at a time works on a folder; executors may come and go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DONE = "_SUCCESS"


class ChunkWork:
    """Work on the chunks of ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        if not self._found("manifest/" + _DONE):
            raise ValueError(f"{folder} holds no complete list of chunks")

    @staticmethod
    def create(chunks: DataFrame, folder: str, batches: int, key: str = "chunk") -> ChunkWork:
        """Writes the manifest: the columns of ``chunks`` and batch, by the hash of ``key``. A key that is null or comes twice raises.

        ``batches`` is how often work can stop without loss; the driver lists as many folders.
        """
        if batches < 1:
            raise ValueError("at least one batch is needed")
        if "batch" in (c.lower() for c in chunks.columns):
            raise ValueError("the column batch is the manifest's own")
        twice = chunks.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
        if twice:
            raise ValueError(f"{key} {twice[0][0]!r} is null or comes more than once")
        dealt = chunks.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
        dealt.repartition("batch").write.partitionBy("batch").parquet(folder.rstrip("/") + "/manifest")
        return ChunkWork(chunks.sparkSession, folder)

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _found(self, pattern: str) -> list[str]:
        fs, at = self._fs(pattern)
        return [s.getPath().toString() for s in fs.globStatus(at) or []]

    @staticmethod
    def _numbers(paths: list[str], name: str) -> list[int]:
        return sorted(int(part.split("=")[1]) for p in paths for part in p.split("/") if part.startswith(f"{name}="))

    def chunks(self) -> DataFrame:
        """The manifest. An empty list has no chunk and no batch."""
        return self.spark.read.parquet(f"{self.folder}/manifest")

    @property
    def generation(self) -> int:
        return max(self._numbers(self._found("results/generation=*"), "generation"), default=0)

    def committed(self) -> list[int]:
        """Batches of this generation whose results are complete."""
        return self._numbers(self._found(f"results/generation={self.generation}/batch=*/{_DONE}"), "batch")

    def pending(self) -> list[int]:
        done = set(self.committed())
        return [b for b in self._numbers(self._found("manifest/batch=*"), "batch") if b not in done]

    def run(self, work: Callable[[DataFrame], DataFrame], most: int | None = None) -> int:
        """Applies ``work`` to the chunks of up to ``most`` pending batches, one after the other; returns how many it did."""
        todo, generation = self.pending()[:most], self.generation
        for batch in todo:
            target = f"{self.folder}/results/generation={generation}/batch={batch}"
            work(self.chunks().filter(F.col("batch") == batch).drop("batch")).write.mode("overwrite").parquet(target)
            if not self._found(f"results/generation={generation}/batch={batch}/{_DONE}"):
                raise ValueError("complete writes aren't marked: set mapreduce.fileoutputcommitter.marksuccessfuljobs")
        return len(todo)

    def rewind(self) -> int:
        """Begins again from the first chunk; returns the new generation."""
        new = self.generation + 1
        for g in (new - 1, new):  # work that has not begun is generation 0
            fs, at = self._fs(f"results/generation={g}")
            fs.mkdirs(at)
        return new

    def results(self) -> DataFrame:
        """What the committed batches of this generation gave; without any, raises."""
        done = self.committed()
        if not done:
            raise ValueError("no batch is committed")
        return self.spark.read.parquet(*[f"{self.folder}/results/generation={self.generation}/batch={b}" for b in done])
