"""Tables that micro-batches change: copy-on-write in hash buckets, with a manifest that is swapped last.

A store holds several tables. A manifest names, for each table and bucket, the folder that has its rows; the readers' version is the
manifest of the greatest number. A batch reads and writes only the buckets that its keys fall into, each once, and then publishes the
next manifest by a rename: until then nothing that readers see has changed, and a batch that was stopped leaves folders
that its next run replaces. A batch that a manifest already holds is not run again. Folders that no kept manifest names are
dropped afterwards.

Nulls and edge cases: a null key has a bucket like any other; an empty batch publishes a manifest of the same folders; an empty store's tables have no row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "bucket_"


@dataclass
class Manifest:
    """What readers see: the last batch that went in, and for each table the folder of each bucket that has rows."""

    batch: int = -1
    tables: dict[str, dict[int, str]] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {folder for buckets in self.tables.values() for folder in buckets.values()}


class BucketStore:
    """Tables (name: schema) under a folder that all executors share, dealt by a hash of their key column."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], key: str, buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path.rstrip("/"), key, buckets, keep
        self.schemas = {name: StructType.fromDDL(schema) for name, schema in tables.items()}

    # Files: small ones and names only, by Hadoop's own interface.

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def manifest(self, number: int | None = None) -> Manifest:
        """The manifest of a batch, the last one's by default; an empty one if there is none."""
        numbers = self._numbers()
        if not numbers:
            return Manifest()
        fs, at = self._fs(f"{self.path}/manifests/{numbers[-1] if number is None else number}")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        raw = json.loads(text)
        return Manifest(raw["batch"], {name: {int(b): folder for b, folder in own.items()} for name, own in raw["tables"].items()})

    def _publish(self, manifest: Manifest) -> None:
        fs, made = self._fs(f"{self.path}/manifests/.{manifest.batch}")
        stream = fs.create(made, True)
        stream.write(bytearray(json.dumps({"batch": manifest.batch, "tables": manifest.tables}, sort_keys=True).encode()))
        stream.close()
        if not fs.rename(made, self._fs(f"{self.path}/manifests/{manifest.batch}")[1]):
            raise RuntimeError(f"batch {manifest.batch} was published by another writer")

    def _drop_unnamed(self) -> None:
        numbers = self._numbers()
        kept = set().union(*[self.manifest(n).folders() for n in numbers[-self.keep :]])
        for n in numbers[: -self.keep]:
            fs, at = self._fs(f"{self.path}/manifests/{n}")
            fs.delete(at, False)
        for batch in self._names("data"):
            if not any(folder.split("/")[0] == batch for folder in kept):
                fs, at = self._fs(f"{self.path}/data/{batch}")
                fs.delete(at, True)
                continue
            for name in self._names(f"data/{batch}"):
                for bucket in self._names(f"data/{batch}/{name}"):
                    if bucket.startswith(BUCKET) and f"{batch}/{name}/{bucket}" not in kept:
                        fs, at = self._fs(f"{self.path}/data/{batch}/{name}/{bucket}")
                        fs.delete(at, True)

    # Rows

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, name: str, manifest: Manifest | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a table; of some buckets only, if they are given."""
        own = (manifest or self.manifest()).tables.get(name, {})
        folders = [f"{self.path}/data/{folder}" for b, folder in sorted(own.items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*folders)

    def merge(self, batch: DataFrame, number: int, change: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]]) -> list[int]:
        """Publishes what ``change`` makes of the touched buckets' rows (by table) and the batch; the touched buckets.

        ``batch`` needs the key column, and all that ``change`` adds must have keys of the batch.
        """
        before = self.manifest()
        if number <= before.batch:
            return []
        touched = sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())  # as many as there are buckets at most
        after = Manifest(number, {name: dict(before.tables.get(name, {})) for name in self.schemas})
        if touched:
            rows = change({name: self.read(name, before, touched) for name in self.schemas}, batch)
            for name, schema in self.schemas.items():
                folder = f"batch-{number}/{name}"
                columns = [F.col(f.name).cast(f.dataType) for f in schema.fields]
                out = rows[name].select(*columns, self._bucket().alias(BUCKET))
                # A bucket is one file and one task, so a table needs as many buckets as its size divided by what a task can sort.
                out.repartition(F.col(BUCKET)).sortWithinPartitions(BUCKET, self.key).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
                written = {int(n.partition("=")[2]): f"{folder}/{n}" for n in self._names(f"data/{folder}") if n.startswith(BUCKET)}
                if stray := set(written) - set(touched):
                    raise ValueError(f"{name}: rows of keys that the batch has not, in buckets {sorted(stray)}")
                for b in touched:
                    after.tables[name].pop(b, None)
                after.tables[name].update(written)
        self._publish(after)
        self._drop_unnamed()
        return touched
