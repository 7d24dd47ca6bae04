"""A keyed table that is changed bucket by bucket under versioned manifests.

``path``/data holds rows in folders by bucket of the key's hash; ``path``/manifests
holds one small JSON file for each version, which names the folder of every bucket. A
reader takes the last whole manifest and sees exactly that version. A change writes
new folders for the buckets that it touches and then creates the next manifest under a
name that no other writer can create too, so a change is seen whole or not at all; a
change that fails leaves folders that no manifest names, which ``vacuum`` removes.

Changes are numbered by their source. A number that was applied is not applied again,
so a batch may be run again after a failure.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stage import stored


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _manifest(spark: SparkSession, path: str, name: str) -> dict | None:
    """A manifest, or None while it is being written."""
    try:
        return json.loads(spark.read.text(f"{path}/manifests/{name}", wholetext=True).first()[0])
    except (ValueError, TypeError):
        return None


def current(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the last version, or None where there is no table yet."""
    for name in reversed(_children(spark, f"{path}/manifests")):
        if (found := _manifest(spark, path, name)) is not None:
            return found
    return None


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    fs, at = _fs(spark, f"{path}/manifests/{manifest['version']:012d}.json")
    out = fs.create(at, False)  # an error if another writer has made this version
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: list[int]) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = [f"{path}/data/{manifest['where'][str(b)]}/bucket={b}" for b in buckets if str(b) in manifest["where"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the last version."""
    manifest = current(spark, path)
    if manifest is None:
        raise FileNotFoundError(path)
    return _rows(spark, path, manifest, list(range(manifest["buckets"])))


def apply_points(incoming: DataFrame, path: str, key: str = "row_id", version: str | None = None, source: str = "batch", number: int | None = None, buckets: int = 64) -> bool:
    """Write rows by key over the table, making it where there is none; False if this number of the source was applied before.

    Of incoming rows with one key, that with the largest version stays (any, where no
    version is named). ``buckets`` counts only for a new table. Only the folders of
    buckets with an incoming row are read and written; large ones are split into files.
    """
    spark = incoming.sparkSession
    was = current(spark, path)
    if was and number is not None and number <= was["applied"].get(source, -1):
        return False
    columns = incoming.columns
    manifest = was or {"version": 0, "key": key, "buckets": buckets, "schema": incoming.schema.jsonValue(), "where": {}, "applied": {}}
    if manifest["key"] != key or StructType.fromJson(manifest["schema"]).names != columns:
        raise ValueError(f"the table at {path} has the key {manifest['key']} and other columns")
    # One row of a key, however many come: combined before the shuffle.
    order = F.col(version) if version else F.lit(0)
    last = incoming.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), order).alias("row")).select("row.*")
    new = stored(last.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(manifest["buckets"]))), "incoming")
    # As many as the table has buckets, at most.
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    folder = uuid.uuid4().hex
    if touched:
        old = _rows(spark, path, manifest, touched).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])))
        kept = old.join(new.select(key), key, "left_anti").select(*columns, "bucket")
        kept.unionByName(new).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    applied = manifest["applied"] | ({source: number} if number is not None else {})
    _publish(spark, path, manifest | {"version": manifest["version"] + 1, "where": manifest["where"] | {str(b): folder for b in touched}, "applied": applied})
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete manifests before the last ``keep`` and folders that none of these names; how many folders went. No writer may be at work."""
    names = _children(spark, f"{path}/manifests")
    used = {folder for name in names[-keep:] for folder in (_manifest(spark, path, name) or {"where": {}})["where"].values()}
    gone = [f"{path}/data/{f}" for f in _children(spark, f"{path}/data") if f not in used]
    for at in [f"{path}/manifests/{n}" for n in names[:-keep]] + gone:
        fs, p = _fs(spark, at)
        fs.delete(p, True)
    return len(gone)
