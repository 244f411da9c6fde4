"""A versioned log of keyed rows: immutable files, manifests committed by rename, and a run lease with fencing.

A commit writes its rows to a folder of their own, in files of disjoint ranges of the key's hash, and beside them a
table of each file's range and Bloom filter. It takes effect by the rename of a manifest to the next number,
which fails if that number is taken: of two writers of one version one wins, and the other starts again from
the new version. A write looks only into files that may hold one of its keys: the range says which file of a
commit a key could be in, the filter whether it is worth reading.

The lease of a run is a commit too. It raises the token, so a holder whose time ran out finds the next version
taken and a higher token there, and cannot commit any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from tidemark.sources.store import staged

BITS, PROBES, FILE_ROWS = 10, 4, 1_000_000
#: Counted rows up to which a side is broadcast.
SMALL = 200_000


class Held(RuntimeError):
    """The lease is another holder's, and its time has not run out."""


class Fenced(RuntimeError):
    """A later holder has taken the lease."""


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash: PROBES numbers from its two halves."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + np.arange(PROBES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)


def _file_stats(frame: pd.DataFrame) -> pd.DataFrame:
    hashes = frame["_hash"].to_numpy()
    bits = max(64, BITS * len(hashes))
    marked = np.zeros(bits, bool)
    marked[_places(hashes, bits).ravel()] = True
    return pd.DataFrame({"file": [frame["_file"].iat[0]], "low": [hashes.min()], "high": [hashes.max()], "rows": [len(hashes)], "bits": [bits], "filter": [np.packbits(marked).tobytes()]})


def _may_hold(keys: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
    """The file, if any of its possible keys passes its filter."""
    if not len(keys) or not len(stats):
        return pd.DataFrame({"file": []}, dtype=str)
    bits = int(stats["bits"].iat[0])
    marked = np.unpackbits(np.frombuffer(stats["filter"].iat[0], np.uint8), count=bits).astype(bool)
    return stats[["file"]].head(1) if marked[_places(keys["_hash"].to_numpy(), bits)].all(1).any() else pd.DataFrame({"file": []}, dtype=str)


@dataclass(frozen=True)
class Commit:
    """What a write did: the version it made (that it found, if there was nothing to write), rows by kind."""

    version: int
    new: int
    changed: int
    files_read: int


class Log:
    """Rows with unique ``keys``; ``meta`` is a column whose change makes a new row of a key that is stored."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...] = ("url", "content_hash"), meta: str | None = "metadata_hash") -> None:
        self.spark, self.folder, self.keys, self.meta = spark, folder.rstrip("/"), keys, meta
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._no_overwrite[0] = rename.valueOf("NONE")

    # ------------------------------------------------------------- manifests
    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.folder}/manifest")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifests(self, upto: int | None = None) -> list[dict]:
        """Manifests up to a version, in order: a line of names and counts for each commit."""
        found = [v for v in self.versions() if upto is None or v <= upto]
        if not found:
            return []
        rows = self.spark.read.text([self._manifest(v) for v in found], wholetext=True).collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda m: m["version"])

    def _commit(self, version: int, said: dict) -> bool:
        """Whether this manifest became ``version``: written aside, renamed, never over another."""
        aside, final = self._path(f"{self.folder}/aside/{uuid.uuid4().hex}"), self._path(self._manifest(version))
        self._files.mkdirs(final.getParent())
        out = self._files.create(aside)
        out.write(bytearray(json.dumps(said | {"version": version}).encode()))
        out.close()
        try:
            self._context.rename(aside, final, self._no_overwrite)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            self._files.delete(aside, False)
            return False
        return True

    # ----------------------------------------------------------------- lease
    def acquire(self, holder: str, now: datetime, seconds: int = 3600) -> int:
        """The token of a lease until ``now`` + ``seconds``; refused while another's runs."""
        while True:
            last = (self.manifests() or [{"version": 0, "token": 0}])[-1]
            until = last.get("until")
            if until and datetime.fromisoformat(until) > now and last["holder"] != holder:
                raise Held(f"the lease is held until {until}")
            lease = {"token": last["token"] + 1, "holder": holder, "until": (now + timedelta(seconds=seconds)).isoformat()}
            if self._commit(last["version"] + 1, lease):
                return lease["token"]

    def release(self, token: int) -> None:
        """Ends the lease; a stale holder's is not there to end."""
        last = (self.manifests() or [{"version": 0, "token": 0}])[-1]
        if last["token"] == token:
            self._commit(last["version"] + 1, {"token": token, "holder": last.get("holder"), "until": None})

    # ------------------------------------------------------------------ rows
    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows as of a version (the last by default), with the commit that wrote them; None if there are none."""
        folders = [m["data"] for m in self.manifests(version) if m.get("data")]
        return self.spark.read.parquet(*[f"{self.folder}/{f}" for f in folders]) if folders else None

    def current(self, version: int | None = None) -> DataFrame | None:
        """The last row of each key."""
        rows = self.read(version)
        return None if rows is None else rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), "_commit").alias("_r")).select("_r.*")

    def _key(self):
        return F.xxhash64(*self.keys)

    def holding(self, new: DataFrame, manifests: list[dict]) -> list[str]:
        """The files that may hold a key of ``new`` (with ``_hash``). What comes to the driver are names of files."""
        stats = [f"{self.folder}/{m['stats']}" for m in manifests if m.get("stats")]
        if not stats:
            return []
        files = staged(self.spark.read.parquet(*stats))
        hashes = new.select("_hash").distinct()
        few = files.count() <= SMALL
        ranges = files.select(F.col("file").alias("of"), "low", "high")
        near = hashes.join(F.broadcast(ranges) if few else ranges, F.col("_hash").between(F.col("low"), F.col("high"))).select("of", "_hash")
        found = near.groupBy("of").cogroup(files.groupBy("file")).applyInPandas(_may_hold, "file string")
        return [r.file for r in found.collect()]

    def append(self, rows: DataFrame, token: int | None = None, meanwhile: Callable[[int], None] | None = None, tries: int = 20) -> Commit:
        """Writes the rows whose key is not stored, and those whose ``meta`` differs from the stored one; of rows that repeat
        a key, the one with the largest ``meta``. ``meanwhile`` is called before each commit, for tests."""
        columns = [c for c in rows.columns]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), F.struct(F.col(self.meta)) if self.meta else F.lit(1)).alias("_r")).select("_r.*")
        new = staged(best.withColumn("_hash", self._key()))
        for attempt in range(tries):
            manifests = self.manifests()
            last = manifests[-1] if manifests else {"version": 0, "token": 0}
            if token is not None and last["token"] > token:
                raise Fenced(f"token {token} is stale: {last['token']} holds the lease")
            files = self.holding(new, manifests)
            if files:
                stored = self.spark.read.parquet(*files)
                held = stored.groupBy(*self.keys).agg(F.max_by(F.struct(F.lit(True).alias("there"), F.col(self.meta) if self.meta else F.lit(None).alias("m")), "_commit").alias("_old"))
                on = [new[k].eqNullSafe(held[k]) for k in self.keys]
                both = new.join(held, on, "left").select(*[new[c] for c in new.columns], held["_old"])
                old = F.col("_old").getField(self.meta) if self.meta else None
                kind = F.when(F.col("_old").isNull(), "new").when(~old.eqNullSafe(F.col(self.meta)), "changed") if self.meta else F.when(F.col("_old").isNull(), "new")
                todo = staged(both.withColumn("_kind", kind).where("_kind is not null").drop("_old"))
            else:
                todo = staged(new.withColumn("_kind", F.lit("new")))
            counted = {r["_kind"]: r["count"] for r in todo.groupBy("_kind").count().collect()}
            total = sum(counted.values())
            if not total:
                return Commit(last["version"], 0, 0, len(files))
            version, name = last["version"] + 1, uuid.uuid4().hex
            data = f"data/{name}"
            todo.withColumn("_commit", F.lit(version).cast("long")).repartitionByRange(-(-total // FILE_ROWS), "_hash").sortWithinPartitions("_hash").write.parquet(f"{self.folder}/{data}")
            self._write_stats(data, f"stats/{name}")
            if meanwhile:
                meanwhile(attempt)
            lease = {k: last[k] for k in ("holder", "until") if k in last}
            if self._commit(version, lease | {"token": last["token"], "data": data, "stats": f"stats/{name}", "rows": total}):
                return Commit(version, counted.get("new", 0), counted.get("changed", 0), len(files))
            for lost in (data, f"stats/{name}"):
                self._files.delete(self._path(f"{self.folder}/{lost}"), True)
        raise RuntimeError("other writers took every version")

    def _write_stats(self, data: str, stats: str) -> None:
        rows = self.spark.read.parquet(f"{self.folder}/{data}").select("_hash", F.col("_metadata.file_path").alias("_file"))
        rows.groupBy("_file").applyInPandas(_file_stats, "file string, low long, high long, rows long, bits long, filter binary").write.parquet(f"{self.folder}/{stats}")


def follow(log: Log, stream: DataFrame, checkpoint: str):
    """Every batch of a stream appended to the log; a batch that is replayed finds its rows stored."""

    def write(batch: DataFrame, n: int) -> None:
        log.append(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
