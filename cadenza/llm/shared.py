"""What the operators of this subpackage share: the shared folder, written intermediate tables, joins and id-ordered chunks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join is broadcast after it was measured; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 16 << 20
#: Parts into which the rows of a hot key are dealt where a join can't be a broadcast.
SALTS = 32
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, a local session (tests) gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="cadenza-"))
        found = _local[0]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here and lost executors lose nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one run of an operator; those whose last reader has been written are deleted by :meth:`drop`."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = [*self.paths.get(name, []), path]
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, or all."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names or list(self.paths):
            for path in self.paths.pop(name, []):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it in any case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bounds the Arrow batches sent to Python by bytes, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """Returns what a Python worker has freed to the system, so that the tasks it runs later start small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def is_small(side: DataFrame) -> bool:
    """Whether ``side`` is within :data:`BROADCAST_BYTES`: its rows are counted and its texts, binaries and arrays measured."""
    fixed, wide = 16, []
    for field in side.schema:
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            wide.append(F.octet_length(F.col(f"`{field.name}`")))
        elif isinstance(field.dataType, T.ArrayType):
            wide.append(16 * F.size(F.col(f"`{field.name}`")))
        else:
            fixed += 16
    more = F.lit(0)
    for size in wide:
        more = more + F.coalesce(size, F.lit(0)) + 16
    rows, held = side.agg(F.count("*"), F.coalesce(F.sum(more), F.lit(0))).first()
    return rows * fixed + held <= BROADCAST_BYTES


def bounded(side: DataFrame) -> DataFrame:
    """``side`` with a broadcast hint if it :func:`is_small`, else as it is."""
    return F.broadcast(side) if is_small(side) else side


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, a row per ``key``, where ``left`` may hold most of its rows under one key.

    A small ``right`` is broadcast. Else the rows of a key are dealt by ``spread`` to :data:`SALTS` parts, for each of which
    ``right`` has a copy of its row.
    """
    if is_small(right):
        return left.join(F.broadcast(right), key, how)
    salted = left.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    return salted.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "salt"], how).drop("salt")


def parts_of(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """``rows`` with "part": 0 for keys of up to ``most`` rows, else the stretch of ``order`` (a number) a row lies in.

    The stretches of a key have one width and about ``most`` rows each if its numbers are spread evenly; null numbers have part -1.
    Large keys are fewer than rows / ``most``.
    """
    large = rows.groupBy(key).agg(F.count("*").alias("part_n"), F.min(order).alias("part_low"), F.max(order).alias("part_high")).filter(F.col("part_n") > most)
    share = (F.col(order) - F.col("part_low")) * F.col("part_n") / ((F.col("part_high") - F.col("part_low") + 1) * most)
    part = F.when(F.col("part_n").isNull(), 0).otherwise(F.coalesce(F.floor(share), F.lit(-1))).cast("long")
    return rows.join(bounded(large), key, "left").withColumn("part", part).drop("part_n", "part_low", "part_high")


def id_bounds(df: DataFrame, key: str, rows: int, most: int = 65_536) -> tuple[list, int]:
    """(ascending upper bounds that cut ``key`` into chunks of about ``rows`` rows, chunks for null keys).

    A key with the rows of several chunks is a bound as often. The literals of a plan hold the bounds, hence ``most``: beyond
    ``most * rows`` rows, chunks get more rows. Their readers sort them with spilling, so that costs no memory.
    """
    n, total = df.select(F.count(key), F.count("*")).first()
    nulls = max(1, min(most, (total - n) // rows))
    parts = min(most, n // rows)
    if parts < 2:
        return [], nulls
    return list(df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 4 * parts)).first()[0]), nulls


def chunk_of(key: Column, tie: Column, cuts: tuple[list, int]) -> Column:
    """The chunk of a row: ascending with ``key`` and, for equal keys, descending with ``tie`` (0 to 2**63 - 1); below 0 for null keys.

    Two steps, so that a row looks at about 2 * sqrt(len(bounds)) bounds. Rows of a key that is a bound several times are dealt by
    their ties.
    """
    bounds, nulls = cuts
    share = F.shiftrightunsigned(tie, 23) / F.lit(float(1 << 40))
    null_chunk = -1 - F.floor(share * nulls).cast("int")
    if not bounds:
        return F.when(key.isNull(), null_chunk).otherwise(0)
    once = sorted(set(bounds))
    step = max(1, int(len(once) ** 0.5))
    blocks = [once[i : i + step] for i in range(0, len(once), step)]
    block = F.greatest(F.size(F.filter(F.lit([b[0] for b in blocks]), lambda b: b < key)) - 1, F.lit(0))
    inner = F.size(F.filter(F.element_at(F.array(*[F.lit(b) for b in blocks]), block + 1), lambda b: b < key))
    below = block * step + inner
    often = {b: bounds.count(b) for b in {x for x, y in zip(bounds, bounds[1:], strict=False) if x == y}}
    if often:
        # Bounds that repeat shift the chunks above them.
        pairs = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(often[b] - 1).alias("n")) for b in sorted(often)])
        shift = F.aggregate(pairs, F.lit(0), lambda s, x: s + F.when(x["b"] < key, x["n"]).otherwise(0))
        own = F.aggregate(pairs, F.lit(1), lambda s, x: s + F.when(x["b"] == key, x["n"]).otherwise(0))
        below = below + shift + (own - 1 - F.floor(share * own).cast("int"))
    return F.when(key.isNull(), null_chunk).otherwise(below)
