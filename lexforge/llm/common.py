"""Small helpers shared by the training-data operators.

Nothing here is specific to one operator: where intermediate tables go, how a
hot key is split in a lookup join, and the fixed word pattern of the contracts.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_own_dir: list[str] = []
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder is made if everything runs in one JVM, as in tests; else it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-lexforge-"))
    return _own_dir[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(keep_until_release(path))
    return spark.read.schema(df.schema).parquet(path)


def keep_until_release(path: str) -> str:
    """The path of files that an operator stores, noted for ``release``."""
    _stored.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables that this session's operators stored; call it when their results are written."""
    jvm = spark.sparkContext._jvm
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def power_at_least(base: int, n: int) -> int:
    return max(1, math.ceil(math.log(max(n, 2)) / math.log(base) - 1e-9))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], salts: int | None = None) -> DataFrame:
    """Left join to a table that has at most one row for each key, safe for hot keys.

    Rows of ``left`` are dealt into ``salts`` parts (by default twice the shuffle
    width) by a hash of the ``spread`` columns. Only distinct (key, part) pairs meet
    ``right``, so a key that holds a third of all rows sends ``salts`` rows to that
    join, and its own rows are then joined over ``salts`` separate keys. Both joins are
    merges whatever Spark's estimate: it sizes exploded rows as those they come from, and a
    broadcast chosen by that would pass whole through the driver.
    """
    (part,) = fresh(left, "part")
    dealt = left.withColumn(part, F.pmod(F.xxhash64(*spread), F.lit(salts or 2 * shuffle_width(left.sparkSession))))
    found = dealt.select(*keys, part).distinct().join(right.hint("merge"), keys)
    return dealt.join(found.hint("merge"), [*keys, part], "left").drop(part)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"__{name}" in taken:
            name += "_"
        out.append(f"__{name}")
        taken.add(out[-1])
    return out


def pieces(batch, rows: int = 512):
    """An Arrow batch in runs of rows, so that what Python makes of them is bounded by these and not by Spark's batches."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def row_hash(df: DataFrame) -> Column:
    """A number that orders rows by all of their columns (maps, which have no order, as text)."""
    return F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields])


def text_of(column: str) -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a text as an array; empty for a text without one."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
