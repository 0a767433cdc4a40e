"""Stored collections: tables of Parquet folders that are changed by merging rows in. Rows lie in buckets by a hash of a column;
a change reads and writes the buckets it touches and then makes a new version, a small file that says which folder holds
each bucket. Readers see whole versions only; a change that dies leaves folders that no version names."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.operators.predicates import last_of, where

_BUCKET = "bucket_of_row"


class Conflict(RuntimeError):
    """Another change made the version that this one was to make."""


class _Folder:
    """Small files in a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
        self.root = folder.rstrip("/")
        conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
        self.fs = self.path(self.root).getFileSystem(conf)
        self.context = hadoop.FileContext.getFileContext(self.fs.getUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)

    def names(self, inside: str) -> list[str]:
        at = self.path(f"{self.root}/{inside}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Whether the file is there now and wasn't before. It gets its name when it is whole; of two that give the same name
        at once, one does."""
        draft, final = self.path(f"{self.root}/.{uuid.uuid4().hex}"), self.path(f"{self.root}/{name}")
        out = self.fs.create(draft)
        out.write(text.encode())
        out.close()
        self.fs.mkdirs(final.getParent())
        try:
            self.context.rename(draft, final, self.no_options)
        except Exception:
            if not self.fs.exists(final):
                raise
            return False
        finally:
            self.fs.delete(draft, False)
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


@dataclass
class Version:
    """number; the table's key, the column that says the bucket, how many there are, the metric of its vectors, the schema;
    folders of buckets; the last batch that each source of changes has merged."""

    number: int
    key: str
    by: str
    buckets: int
    metric: str
    schema: str
    folders: dict[str, str]
    merged: dict[str, int]


class Collection:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._files = spark, folder.rstrip("/"), _Folder(spark, folder)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: StructType, key: str, by: str | None = None, buckets: int = 64, metric: str = "cosine") -> Collection:
        """An empty collection. by: a column that says the bucket, by default the key; rows of one key must agree in it."""
        made = cls(spark, folder)
        if not made._files.write_new("versions/0000000000.json", json.dumps(Version(0, key, by or key, buckets, metric, schema.json(), {}, {}).__dict__)):
            raise ValueError(f"{folder} holds a collection")
        return made

    def version(self) -> Version:
        """The last whole version."""
        found = sorted(n for n in self._files.names("versions") if re.fullmatch(r"\d{10}\.json", n))
        if not found:
            raise ValueError(f"{self.folder} holds no collection")
        return Version(**json.loads(self._files.read(f"versions/{found[-1]}")))

    def _read(self, version: Version, buckets: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in version.folders.items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(json.loads(version.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in sorted(folders)])

    def rows(self, spec: dict | None = None) -> DataFrame:
        """All rows, or those that a filter (see predicates.where) lets through."""
        rows = self._read(self.version())
        return rows.where(where(spec)) if spec else rows

    def get(self, keys: list) -> DataFrame:
        """The rows of these keys, from the buckets that can hold them where the key says the bucket."""
        v = self.version()
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([StructType.fromJson(json.loads(v.schema))[v.key]]))
        touched = [r.b for r in wanted.select(_of(v.key, v.buckets).alias("b")).distinct().collect()] if v.by == v.key else None
        return self._read(v, touched).join(F.broadcast(wanted), v.key, "left_semi")

    def count(self) -> int:
        return self.rows().count()

    def _change(self, touched: DataFrame, change, source: str | None, batch: int | None) -> int | None:
        """touched(bucket); change(old rows of these buckets) gives their new rows. The number of the version made, or None if
        this source has merged this batch or a later one."""
        v = self.version()
        if source is not None and v.merged.get(source, -1) >= batch:
            return None
        buckets = sorted(r[0] for r in touched.distinct().collect())  # at most as many as the collection has
        data = f"data/{uuid.uuid4().hex}"
        new = change(self._read(v, buckets)).select(*StructType.fromJson(json.loads(v.schema)).fieldNames())
        new.withColumn(_BUCKET, _of(v.by, v.buckets)).repartition(F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{data}")
        folders = {b: f for b, f in v.folders.items() if int(b) not in buckets}
        folders |= {n.partition("=")[2]: f"{data}/{n}" for n in self._files.names(data) if n.startswith(f"{_BUCKET}=")}
        merged = v.merged | ({source: batch} if source is not None else {})
        after = Version(v.number + 1, v.key, v.by, v.buckets, v.metric, v.schema, folders, merged)
        if not self._files.write_new(f"versions/{after.number:010d}.json", json.dumps(after.__dict__)):
            raise Conflict(f"version {after.number} of {self.folder}")
        return after.number

    def _own(self, rows: DataFrame, v: Version) -> DataFrame:
        kinds = StructType.fromJson(json.loads(v.schema))
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in kinds])

    def upsert(self, rows: DataFrame, order: str | None = None, source: str | None = None, batch: int | None = None) -> int | None:
        """Rows replace those of the same key; of rows that share a key, the last by `order` (or by all columns). With a source
        and a batch number, a batch that was merged before changes nothing."""
        v = self.version()
        new = last_of(self._own(rows, v), v.key, order)
        return self._change(_touched(rows, v), lambda old: old.join(new, v.key, "left_anti").unionByName(new), source, batch)

    def append(self, rows: DataFrame, order: str | None = None, source: str | None = None, batch: int | None = None) -> int | None:
        """Rows are added where their key isn't held yet."""
        v = self.version()
        new = last_of(self._own(rows, v), v.key, order)
        return self._change(_touched(rows, v), lambda old: old.unionByName(new.join(old, v.key, "left_anti")), source, batch)

    def replace(self, rows: DataFrame, named: DataFrame | None = None, source: str | None = None, batch: int | None = None) -> int | None:
        """All rows of the values of `by` that rows (or named) hold go, and rows take their place: a file's old chunks make
        way for its new ones, however many there are."""
        v = self.version()
        new = last_of(self._own(rows, v), v.key)
        gone = (rows if named is None else named).select(v.by).distinct()
        return self._change(_touched(gone, v), lambda old: old.join(gone, v.by, "left_anti").unionByName(new), source, batch)

    def delete(self, keys: DataFrame | None = None, spec: dict | None = None) -> int | None:
        """The rows of these keys, or those that a filter lets through, go."""
        v = self.version()
        held = self._read(v)
        gone = held.join(keys.select(v.key).distinct(), v.key, "left_semi") if keys is not None else held.where(F.coalesce(where(spec or {}), F.lit(False)))
        stay = (lambda old: old.join(keys.select(v.key).distinct(), v.key, "left_anti")) if keys is not None else (lambda old: old.where(~F.coalesce(where(spec or {}), F.lit(False))))
        return self._change(_touched(gone, v), stay, None, None)

    def reset(self) -> int | None:
        """An empty version; what sources have merged is forgotten."""
        v = self.version()
        after = Version(v.number + 1, v.key, v.by, v.buckets, v.metric, v.schema, {}, {})
        if not self._files.write_new(f"versions/{after.number:010d}.json", json.dumps(after.__dict__)):
            raise Conflict(f"version {after.number} of {self.folder}")
        return after.number

    def cleaned(self, keep: int = 1) -> None:
        """Versions before the last `keep`, and folders that none of those names, go. Not while others change the collection."""
        names = sorted(n for n in self._files.names("versions") if n.endswith(".json"))
        held = [Version(**json.loads(self._files.read(f"versions/{n}"))) for n in names[-keep:]]
        used = {f.split("/")[1] for v in held for f in v.folders.values()}
        for n in names[:-keep]:
            self._files.delete(f"versions/{n}")
        for n in self._files.names("data"):
            if n not in used:
                self._files.delete(f"data/{n}")


def _of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{column}`").cast("string")), F.lit(buckets)).cast("int")


def _touched(rows: DataFrame, v: Version) -> DataFrame:
    return rows.select(_of(v.by, v.buckets).alias(_BUCKET))
