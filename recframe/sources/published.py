"""Tables published by commit records (S12, S18, S23, R03, ST03, E22).

Layout: ``data/<version>-<id>/…`` holds immutable Parquet folders and
``commits/<version>-<id>`` one small text file that says which folder holds
each partition.  A version exists once its commit file does (one file, moved
into place by Spark's output committer), so a reader sees the old version or the
new one, never half of either, and a writer that dies leaves only folders that
no commit names (``vacuum`` removes them).  There is one writer at a time;
readers need no lock.

An upsert rewrites only the partitions it touches; the others stay where they
are.  The partition columns must follow from the key (the day of a key's time,
or ``key_bucket`` of any key), for otherwise an old row could stay behind in
another partition; they are whole numbers.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe.sources import io as IO


#: Folder name that Spark gives to a null partition value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def key_bucket(key: str | list[str], buckets: int) -> Column:
    """Partition number of a key."""
    cols = [key] if isinstance(key, str) else key
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


class PublishedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------------ versions
    def commits(self) -> list[dict[str, Any]]:
        """All commit records, oldest first (a few hundred bytes a version, plus its partitions)."""
        where = f"{self.path}/commits"
        if not IO.exists(self.spark, where) or not IO.list_names(self.spark, where):
            return []
        rows = self.spark.read.text(f"{where}/*").collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda c: (c["version"], c["id"]))

    def current(self, version: int | None = None) -> dict[str, Any] | None:
        found = [c for c in self.commits() if version is None or c["version"] == version]
        return found[-1] if found else None

    def _commit(self, before: dict | None, schema: T.StructType, partition_by: list[str], folders: dict[str, list[str]], meta: dict | None) -> int:
        record = {"version": (before["version"] if before else 0) + 1, "id": uuid.uuid4().hex, "schema": json.loads(schema.json()),
                  "partition_by": partition_by, "folders": folders, "meta": meta or {}}
        line = self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1)
        line.write.mode("error").text(f"{self.path}/commits/{record['version']:012d}-{record['id']}")
        return record["version"]

    # ------------------------------------------------------------------- reading
    def read(self, version: int | None = None) -> DataFrame | None:
        """The current (or a given) version; None before the first."""
        commit = self.current(version)
        return None if commit is None else self._frame(commit, commit["folders"])

    def _frame(self, commit: dict, folders: dict[str, list[str]]) -> DataFrame:
        schema = T.StructType.fromJson(commit["schema"])
        by_folder: dict[str, list[str]] = {}
        for part, names in folders.items():
            for name in names:
                by_folder.setdefault(name, []).append(part)
        out = None
        for name, parts in sorted(by_folder.items()):
            base = f"{self.path}/data/{name}"
            paths = [f"{base}/{p}" if p else base for p in parts]
            df = self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema) if out is None else out

    # ------------------------------------------------------------------- writing
    def _write(self, df: DataFrame, partition_by: list[str], version: int) -> tuple[str, list[str]]:
        """(folder, partitions in it)."""
        name = f"{version:012d}-{uuid.uuid4().hex}"
        base = f"{self.path}/data/{name}"
        w = df.write.mode("error")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(base)
        parts = [""]
        for _ in partition_by:
            parts = [f"{p}/{n}".lstrip("/") for p in parts for n in IO.list_names(self.spark, f"{base}/{p}") if "=" in n]
        return name, parts

    def publish(self, df: DataFrame, partition_by: list[str] | None = None, meta: dict | None = None) -> int:
        """Replace the table by ``df``; returns the new version."""
        before, by = self.current(), list(partition_by or [])
        name, parts = self._write(df, by, (before["version"] if before else 0) + 1)
        return self._commit(before, df.schema, by, {p: [name] for p in parts}, meta)

    def append(self, df: DataFrame, meta: dict | None = None) -> int:
        """Add rows; nothing that is there is rewritten."""
        before = self.current()
        if before is None:
            return self.publish(df, meta=meta)
        name, parts = self._write(df.select(*T.StructType.fromJson(before["schema"]).names), before["partition_by"], before["version"] + 1)
        folders = {p: list(names) for p, names in before["folders"].items()}
        for p in parts:
            folders.setdefault(p, []).append(name)
        return self._commit(before, T.StructType.fromJson(before["schema"]), before["partition_by"], folders, meta)

    def compact(self, meta: dict | None = None) -> int:
        """One folder for all that appends and upserts have spread."""
        before = self.current()
        if before is None:
            raise ValueError(f"{self.path} has no version")
        return self.publish(self._frame(before, before["folders"]), before["partition_by"], meta if meta is not None else before["meta"])

    def upsert(self, new: DataFrame, keys: list[str], order: list[str], partition_by: list[str] | None = None, meta: dict | None = None) -> int:
        """Last write wins per key: of the new rows the greatest by ``order``
        replaces the stored row, whatever that is.  ``new`` is read twice."""
        payload = [c for c in new.columns if c not in keys]
        last = (new.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *payload)).alias("_b"))
                .select(*keys, *[F.col(f"_b.{c}").alias(c) for c in payload]).select(*new.columns))
        before = self.current()
        if before is None:
            return self.publish(last, partition_by, meta)
        by = before["partition_by"]
        touched = [""] if not by else ["/".join(f"{c}={NO_VALUE if r[c] is None else r[c]}" for c in by) for r in new.select(*by).distinct().collect()]
        old = self._frame(before, {p: before["folders"][p] for p in touched if p in before["folders"]})
        rest = old.join(last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_anti")
        merged = rest.unionByName(last, allowMissingColumns=True)
        name, parts = self._write(merged, by, before["version"] + 1)
        folders = {p: names for p, names in before["folders"].items() if p not in touched} | {p: [name] for p in parts}
        return self._commit(before, merged.schema, by, folders, meta)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last ``keep`` versions uses; returns their names."""
        used = {n for c in self.commits()[-keep:] for names in c["folders"].values() for n in names}
        gone = [n for n in IO.list_names(self.spark, f"{self.path}/data") if n not in used]
        for n in gone:
            IO.delete(self.spark, f"{self.path}/data/{n}")
        return gone
