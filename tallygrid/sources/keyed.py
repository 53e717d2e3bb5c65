"""A Parquet table with one row per key, written over by key, switched version by version.

Below ``path`` lie folders of buckets, written once and never changed, and numbered manifests.
A manifest names the folder of every bucket of its version, so the newest manifest *is* the
table: a job that dies before it writes one leaves the table as it was, and readers see either
the old or the new version whole.  Buckets are residues of a hash; how many there are stands in
the manifest and not in the caller's hands.  A write reads and rewrites only the buckets that
new rows fall into, and a bucket that has grown beyond ``bucket_rows`` is split in two.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
BUCKET_ROWS = 2_000_000
PART_ROWS = 100_000  # of a bucket, rewritten by one task
# A hash that equal values share cannot be split for ever.
MOST_BUCKETS = 1 << 16


class Conflict(RuntimeError):
    """Another writer has switched to the version that this one prepared."""


@dataclass(frozen=True)
class Bucket:
    """Rows whose hash is ``rest`` modulo ``size``, and the folder they lie in, if any."""

    size: int
    rest: int
    folder: str | None = None
    rows: int = 0

    def halves(self) -> list[Bucket]:
        """The two buckets that this one becomes; until they are written they share its folder."""
        return [Bucket(2 * self.size, r) for r in (self.rest, self.rest + self.size)]


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    by: str
    schema: dict
    buckets: list[Bucket]


class KeyedTable:
    """The table at ``path``.  ``key`` and ``by`` matter when it is first written.

    Rows are dealt to buckets by ``by``, which equal keys must share; without it by the key.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str = "id", by: str | None = None,
        buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS,
    ):
        if buckets < 1 or bucket_rows < 1:
            raise ValueError("buckets and bucket_rows must be positive")
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.by, self.first, self.bucket_rows = key, by or key, buckets, bucket_rows

    # -- manifests --------------------------------------------------------------------------

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests")
        return jvm, folder.getFileSystem(conf), folder

    def versions(self) -> list[int]:
        _, files, folder = self._files()
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest manifest, or that of a version; None if the table was never written."""
        versions = self.versions()
        if not versions:
            return None
        wanted = versions[-1] if version is None else version
        text = self.spark.read.text(
            f"{self.path}/_manifests/{wanted:010d}.json", wholetext=True).first()[0]
        content = json.loads(text)
        return Manifest(**content | {"buckets": [Bucket(**b) for b in content["buckets"]]})

    def _switch(self, manifest: Manifest) -> None:
        """Publish a manifest under its number, if nobody else has done so."""
        jvm, files, folder = self._files()
        files.mkdirs(folder)
        aside = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
        target = jvm.org.apache.hadoop.fs.Path(folder, f"{manifest.version:010d}.json")
        out = files.create(aside, False)
        out.write(json.dumps(asdict(manifest)).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            folder.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(
            jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            # without the option to overwrite, the file system lets one of two writers win
            context.rename(aside, target, options)
        except Exception as error:
            files.delete(aside, False)
            if files.exists(target):
                raise Conflict(f"version {manifest.version} exists") from None
            raise error

    # -- rows -------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an earlier one."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(manifest, manifest.buckets)

    def _rows(self, manifest: Manifest, buckets: list[Bucket]) -> DataFrame:
        schema = T.StructType.fromJson(manifest.schema)
        folders = [f"{self.path}/{b.folder}" for b in buckets if b.folder]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _placed(self, rows: DataFrame, by: str, buckets: list[Bucket]) -> DataFrame:
        """Rows beside the number of their bucket, by a table of the hash's residues."""
        most = max(b.size for b in buckets)
        slots = [(rest, i) for i, b in enumerate(buckets)
                 for rest in range(b.rest, most, b.size)]
        # At most MOST_BUCKETS residues.
        table = F.broadcast(self.spark.createDataFrame(slots, "_slot bigint, _bucket int"))
        slot = F.pmod(F.xxhash64(by), F.lit(most)).cast("bigint")
        return rows.withColumn("_slot", slot).join(table, "_slot").drop("_slot")

    def _one_per_key(
        self, rows: DataFrame, key: str, by: str, buckets: list[Bucket], largest: int
    ) -> DataFrame:
        """Of the rows with one key that with the largest ``_order``, beside its bucket.

        The only shuffle of whole rows: by parts of buckets, which hold all rows of their keys.
        ``largest`` is the number of rows of the largest bucket so far.
        """
        parts = -(-2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // len(buckets))
        parts = max(parts, -(-largest // PART_ROWS))
        values = F.struct(*[c for c in rows.columns if c != "_order"])
        return (
            self._placed(rows, by, buckets)
            .select("_bucket", F.pmod(F.xxhash64(key, F.lit(0)), F.lit(parts)).alias("_part"),
                    F.col(key).alias("_key"), values.alias("_row"), "_order")
            .repartition("_bucket", "_part")
            .groupBy("_bucket", "_part", "_key")
            .agg(F.max_by("_row", F.struct("_order")).alias("_row"))
            .select("_row.*", "_bucket")
        )

    def _refuse_null(self, rows: DataFrame, key: str) -> None:
        if rows.filter(F.col(key).isNull()).head(1):
            raise ValueError(f"a row has no {key}")

    def upsert(self, new: DataFrame, version: str | None = None) -> int:
        """Write rows over the table by key; the number of the version they are in.

        Of several new rows with one key the one with the largest ``version`` column is
        written, and of equal ones that with the largest hash.  Rows without a key are refused.
        """
        old = self.manifest()
        key, by = (old.key, old.by) if old else (self.key, self.by)
        buckets = old.buckets if old else [Bucket(self.first, r) for r in range(self.first)]
        rows = new.withColumn(
            "_order", F.struct(*([F.col(version)] if version else []), F.xxhash64(F.struct("*"))))
        folder = f"data/{uuid.uuid4().hex}"
        touched = set(range(len(buckets)))
        if old:
            # Computed once: the buckets to read depend on it.
            staged = f"{self.path}/{folder}-incoming"
            dealt = self._placed(rows, by, buckets)
            dealt.write.parquet(staged)
            incoming = self.spark.read.schema(dealt.schema).parquet(staged)
            self._refuse_null(incoming, key)
            touched = {r[0] for r in incoming.select("_bucket").distinct().collect()}
            # Rows of the table have no order, so that a new one comes before them.
            rows = self._rows(old, [buckets[i] for i in sorted(touched)]).unionByName(
                incoming.drop("_bucket"), allowMissingColumns=True)
        after = [b for i, b in enumerate(buckets) if i not in touched]
        written = [
            half for i in sorted(touched) for half in (
                buckets[i].halves()
                if buckets[i].rows > self.bucket_rows and 2 * buckets[i].size <= MOST_BUCKETS
                else [buckets[i]])
        ]
        largest = max((buckets[i].rows for i in touched), default=0)
        merged = self._one_per_key(rows, key, by, after + written, largest)
        merged.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        result = self.spark.read.schema(merged.schema).parquet(f"{self.path}/{folder}")
        if not old:
            self._refuse_null(result, key)
        counts = dict(result.groupBy("_bucket").count().collect())
        for i, b in enumerate(written, len(after)):
            place = f"{folder}/_bucket={i}" if counts.get(i) else None
            after.append(Bucket(b.size, b.rest, place, counts.get(i, 0)))
        number = old.version + 1 if old else 1
        schema = result.drop("_bucket").schema
        self._switch(Manifest(number, key, by, schema.jsonValue(), after))
        self._delete(f"{folder}-incoming")
        return number

    def _delete(self, folder: str) -> None:
        jvm, files, _ = self._files()
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"), True)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest ``keep`` versions and what only they or dead jobs used.

        No writer may be at work.  The number of deleted folders.
        """
        if keep < 1:
            raise ValueError("keep at least one version")
        versions = self.versions()
        used = {b.folder for v in versions[-keep:] for b in self.manifest(v).buckets}
        jvm, files, folder = self._files()
        for v in versions[:-keep]:
            files.delete(jvm.org.apache.hadoop.fs.Path(folder, f"{v:010d}.json"), False)
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        gone = 0
        for status in files.listStatus(data) if files.exists(data) else []:
            batch = status.getPath().getName()
            for inner in files.listStatus(status.getPath()):
                name = inner.getPath().getName()
                if inner.isDirectory() and f"data/{batch}/{name}" not in used:
                    files.delete(inner.getPath(), True)
                    gone += 1
            if not any(u and u.startswith(f"data/{batch}/") for u in used):
                files.delete(status.getPath(), True)
        return gone
