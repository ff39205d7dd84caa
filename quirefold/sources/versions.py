"""A table in buckets of a key, with versions.

    path/data/<name>/bucket=<b>/...   the rows of the buckets that one commit wrote, as Parquet
    path/versions/<number>            a manifest: where each bucket lies, and what the writers have done

A commit reads and writes the buckets of its keys only, and then publishes a manifest, by a rename that fails if another writer
was faster. Readers take the last manifest, so they see all of a commit or nothing of it: what a run leaves behind that dies
before is never named by one, and goes with the next vacuum. Files go through Hadoop's file system, as Spark's own do.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: The column that buckets are folders of.
FOLDER = "bucket"


class Conflict(RuntimeError):
    """Another writer has published this version first: the commit has to be done again."""


@dataclass
class Version:
    number: int = 0
    buckets: dict[str, list[str]] = field(default_factory=dict)  # of each bucket, the names of the commits whose rows it has
    done: dict[str, int] = field(default_factory=dict)  # of each writer, the last of its numbered commits
    n_buckets: int = BUCKETS


class Versions:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "work_id", n_buckets: int = BUCKETS):
        """n_buckets counts for a new table; one that is there keeps its own."""
        if FOLDER in (n.lower() for n in schema.names):
            raise ValueError(f"a column is named {FOLDER}")
        self.spark, self.path, self.schema, self.key, self.n_buckets = spark, path.rstrip("/"), schema, key, n_buckets

    # -- files -------------------------------------------------------------------------------------------------------

    def _fs(self, name: str = ""):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        """A published version, the last one if no number is given; an empty one where there is none."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return Version(n_buckets=self.n_buckets)
        fs, path = self._fs(f"versions/{number}")
        stream = fs.open(path)
        try:
            return Version(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def _publish(self, version: Version) -> None:
        fs, target = self._fs(f"versions/{version.number}")
        _, fresh = self._fs(f"versions/_{uuid4().hex}")
        out = fs.create(fresh)
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(fresh, target):
            fs.delete(fresh, False)
            raise Conflict(f"version {version.number} of {self.path} is there already")

    # -- rows --------------------------------------------------------------------------------------------------------

    def _bucket(self, version: Version) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(version.n_buckets)).cast("int")

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, of some buckets if they are given."""
        version = self.version(number)
        wanted = version.buckets if buckets is None else {str(b): version.buckets.get(str(b), []) for b in buckets}
        paths = [f"{self.path}/data/{name}/{FOLDER}={b}" for b, names in wanted.items() for name in names]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of some rows: n_buckets at most."""
        return [r[0] for r in rows.select(self._bucket(self.version())).distinct().collect()]

    def done(self, writer: str, number: int) -> bool:
        return self.version().done.get(writer, -1) >= number

    def _commit(self, before: Version, rows: DataFrame, whole: bool, writer: str | None, commit: int | None) -> int:
        """Writes rows and publishes them: instead of the buckets that they lie in, or beside what these hold."""
        name = f"{before.number + 1:06d}-{uuid4().hex}"
        dealt = rows.select(*self.schema.names, self._bucket(before).alias(FOLDER)).hint("rebalance", FOLDER)
        dealt.write.partitionBy(FOLDER).parquet(f"{self.path}/data/{name}")
        written = [n.removeprefix(f"{FOLDER}=") for n in self._names(f"data/{name}") if n.startswith(f"{FOLDER}=")]
        buckets = {**before.buckets, **{b: [name] if whole else [*before.buckets.get(b, []), name] for b in written}}
        done = before.done if writer is None else {**before.done, writer: commit}
        self._publish(Version(before.number + 1, buckets, done, before.n_buckets))
        return before.number + 1

    def upsert(self, rows: DataFrame, on: list[str] | None = None, writer: str | None = None, commit: int | None = None) -> int:
        """rows take the place of those that agree with them in `on` (the key, if None; nulls agree); the number of the new version. Of
        a numbered commit of a writer that is done already nothing is done again."""
        on = on or [self.key]
        before = self.version()
        if writer is not None and before.done.get(writer, -1) >= commit:
            return before.number
        stored = self.read(before.number, self.touched(rows)) if before.number else self.spark.createDataFrame([], self.schema)
        new = rows.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
        kept = stored.join(new, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left_anti")
        return self._commit(before, kept.unionByName(rows.select(self.schema.names)), True, writer, commit)

    def append(self, rows: DataFrame, writer: str | None = None, commit: int | None = None) -> int:
        """rows beside what is stored: nothing is read."""
        before = self.version()
        if writer is not None and before.done.get(writer, -1) >= commit:
            return before.number
        return self._commit(before, rows, False, writer, commit)

    def compact(self, commits: int = 8) -> int:
        """Writes the buckets anew that so many commits or more have appended to; the number of the last version."""
        before = self.version()
        many = [int(b) for b, names in before.buckets.items() if len(names) >= commits]
        return self._commit(before, self.read(before.number, many), True, None, None) if many else before.number

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the last versions, and the data that none of these names: commits that were replaced and what runs that
        died have left. Not while another writer is at work. Returns the names of the data that went."""
        numbers = self.numbers()
        last = numbers[-keep:]
        named = {name for n in last for names in self.version(n).buckets.values() for name in names}
        gone = [n for n in self._names("data") if n not in named]
        for folder, names in (("versions", [str(n) for n in numbers[:-keep]] + [n for n in self._names("versions") if n.startswith("_")]), ("data", gone)):
            for name in names:
                fs, path = self._fs(f"{folder}/{name}")
                fs.delete(path, True)
        return gone
