"""What the operators of this package share: text patterns, scratch tables in the shared folder, and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the operators cut texts at, and a word: a longest run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A written table is broadcast only if its measured size in memory stays below this.
BROADCAST_BYTES = 24 << 20

#: Spark's setting that removes a query's shuffle files when the query ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written once and read again: they cut lineage, survive lost executors, and keep loops from recomputing.

    Tables that a lazy result still reads go when the JVM ends; ``drop`` removes one sooner.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        """``df``, written and read again. The shuffle files of the write go when it ends: nothing else reads them, and Spark
        alone keeps them until the driver's memory is collected."""
        path = f"{self.root}/{tag}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(FILE_CLEANUP, None)
        self.spark.conf.set(FILE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(FILE_CLEANUP)
            else:
                self.spark.conf.set(FILE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Removes all its tables; what still reads one fails."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key that a task of a shuffled join gets.
SALTED = 1000


def table_bytes(df: DataFrame) -> int:
    """A written table's size in a hash table: 8 bytes a value and 16 a row, half as much again for its slots, and the bytes
    of strings, binaries and arrays of numbers."""
    long = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    long += [F.sum(8 * F.greatest(F.size(c), F.lit(0)).cast("long")) for c, kind in df.dtypes if kind in ("array<bigint>", "array<double>")]
    got = df.agg(F.count("*") * (12 * len(df.columns) + 24), *long).first()
    return sum(v or 0 for v in got)


def sized_broadcast(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its measured size is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


def hot_keys(counts: DataFrame, on: list[str]) -> DataFrame:
    """(on, _salts) of the keys with the most rows, from a written table (on, size), broadcast.

    Keys with more than ``SALTED`` rows are salted, or so many times more that their list stays below the broadcast bound: that
    halves with each doubling, as keys of more than T rows are at most all rows by T, so a key that isn't salted has few rows
    however many keys there are. Only a bound below the list of a single key leaves the list unbroadcast."""
    salts = F.ceil(F.col("size") / SALTED).cast("int").alias("_salts")
    least, most = SALTED, counts.agg(F.max("size")).first()[0] or 0
    while True:
        hot = counts.where(F.col("size") > least).select(*on, salts)
        size = table_bytes(hot)
        if size <= BROADCAST_BYTES:
            return F.broadcast(hot)
        if 2 * least >= most:
            fit = hot.count() * max(BROADCAST_BYTES, 0) // size if size else 0
            if not fit:
                return counts.where(F.col("size") > SALTED).select(*on, salts)
            first = counts.orderBy(F.desc("size"), *on).limit(fit).select(*on, salts)
            return F.broadcast(first) if table_bytes(first) <= BROADCAST_BYTES else first
        least *= 2


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """``rows`` left-joined to ``groups``, a written table with one row a key and the key's count of rows in ``size``.

    Groups of a small measured size are broadcast. Else large groups are salted: their rows are spread by a hash of the columns
    ``spread``, and their group's row is repeated for each salt."""
    if table_bytes(groups) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), on, "left")
    hot = hot_keys(groups, on)
    salts = F.coalesce("_salts", F.lit(1))
    rows = rows.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    groups = groups.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return rows.join(groups, [*on, "_salt"], "left").drop("_salt")


def spread_join(rows: DataFrame, table: DataFrame, key: str, spread: str, scratch: Scratch) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key. The rows of keys with more than ``SALTED`` of them are spread
    by a hash of the column ``spread``, and only those keys' rows of ``table`` are repeated for each salt."""
    counts = rows.groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") > SALTED)
    if counts.isEmpty():
        return rows.join(table, key)
    hot = hot_keys(scratch.save(counts, "hot"), [key])
    salts = F.coalesce("_salts", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    table = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return rows.join(table, [key, "_salt"]).drop("_salt")


#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: fewer rows and bytes in an Arrow batch keep a Python worker's memory bounded. Spark has only the
    session's settings for that, so they are lowered there, and stay so."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D.*", "", spark.conf.get(name)) or 0)
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


#: The inner key of a row: rows that repeat an id are decided, joined and dropped by it.
ROW = "_glow_row"
#: Files whose rows are numbered where they lie, and the most rows of one of them.
MOST_FILES, FILE_ROWS = 10_000, 1 << 40


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with an inner key for each row. Only a table that is written with it has the same keys each time it is read."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def with_stable_keys(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` with an inner key for each row that is the same each time it is read, and the key's name, which no column of
    ``docs`` has.

    The rows of Parquet files, read as they are, are numbered by their file and their place in it. All else, and what comes
    from very many files, is written with its keys and read from there."""
    key, path, index, number = (fresh_name(docs, n) for n in (ROW, "_glow_path", "_glow_index", "_glow_file"))
    copy = lambda: (scratch.save(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key)
    if fresh_name(docs, "_metadata") != "_metadata":
        return copy()
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    except AnalysisException:
        return copy()
    at = F.col(index).cast("decimal(38,0)")
    files = placed.groupBy(F.col(path).alias("_path")).agg(F.count("*").alias("n"), F.max(index).alias("last"), F.sum(at).alias("one"), F.sum(at * at).alias("two")).limit(MOST_FILES + 1).collect()
    # Each place of each file once: nothing was dropped, repeated or made up after the files were read.
    whole = all(f.n == f.last + 1 and f.one == f.n * (f.n - 1) // 2 and f.two == (f.n - 1) * f.n * (2 * f.n - 1) // 6 for f in files if f._path is not None)
    if not whole or len(files) > MOST_FILES or any(f._path is None or f.n > FILE_ROWS for f in files):
        return copy()
    numbers = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(sorted(f._path for f in files))], f"{path} string, {number} long")
    keyed = placed.join(F.broadcast(numbers), path)  # at most MOST_FILES rows
    return keyed.select(*columns_of(docs), (F.col(number) * FILE_ROWS + F.col(index)).alias(key)), key


def without_rows_of(docs: DataFrame, dropped: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped`` (one column). A drop list of a small measured size is broadcast."""
    dropped = scratch.save(dropped.select(F.col(key)).distinct(), "dropped")
    return docs.join(sized_broadcast(dropped), key, "left_anti").select(columns_of(docs))
