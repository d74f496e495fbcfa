"""The store of detection records: days of Parquet files under a manifest.

    <path>/data/write=<id>/dt=<day>/...   what one write put into one day
    <path>/commits/<number>.json          the manifest: which of these folders are live

A write becomes visible with the commit that lists its folders, all days at once; a batch of a
stream that comes again after a crash finds its number in the manifest and adds nothing. Removing
old records commits a manifest without them, with the day of the cutoff rewritten beside the old
one, so a reader sees a day as it was or as it is now, never half of it. The manifest counts the
rows of every folder, so counts per day cost no scan: the newest page opens the newest days only,
and a retention that finds nothing to delete reads nothing.

Folders that are no longer listed stay for readers that began before; ``vacuum`` removes them.
``compact`` joins the folders of days written in many batches.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reqsieve.operators import history
from reqsieve.sources import commits

# Seconds that folders taken out of the manifest stay for running readers.
GRACE_SECONDS = 3600
# Rows of the first days that a task may keep to find a page.
TOP_ROWS = 10_000


def with_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The day in UTC, whatever the session's zone; history bounds are UTC days too."""
    days = F.floor(history.micros_of(df, ts) / F.lit(86_400_000_000)).cast("int")
    return df.withColumn("dt", F.date_from_unix_date(days))


def _plus(schema: StructType, **columns: str) -> StructType:
    """A schema with more columns; ``StructType.add`` would change the given one."""
    out = StructType(list(schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, ts: str = "ts", tie: str = "request_id"):
        self.spark, self.path, self.ts, self.tie = spark, path.rstrip("/"), ts, tie
        self._commits = f"{self.path}/commits"

    # --- the manifest -----------------------------------------------------------------

    def _manifest(self) -> dict | None:
        return commits.newest(self.spark, self._commits)[1]

    def days(self) -> list[tuple[str | None, int]]:
        """(day, rows) of the live days, newest first, records without a time last."""
        rows: dict[str | None, int] = {}
        for w in (self._manifest() or {"writes": []})["writes"]:
            rows[w["dt"]] = rows.get(w["dt"], 0) + w["rows"]
        return sorted(rows.items(), key=lambda x: (x[0] is not None, x[0] or ""), reverse=True)

    def count(self) -> int:
        return sum(n for _, n in self.days())

    # --- reading ----------------------------------------------------------------------

    def _read(self, manifest: dict, writes: Iterable[dict]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{w['folder']}" for w in writes]
        if not folders:
            return self.spark.createDataFrame([], _plus(schema, dt="date"))
        whole = _plus(schema, write="string", dt="date")
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders).drop("write")

    def read(self, days: Iterable[str | None] | None = None) -> DataFrame:
        """All live records with their day in ``dt``, or those of some days."""
        manifest = self._manifest()
        if manifest is None:
            raise ValueError(f"no records were written to {self.path}")
        wanted = None if days is None else set(days)
        return self._read(manifest, [w for w in manifest["writes"] if wanted is None or w["dt"] in wanted])

    def page(self, limit: int = 100, offset: int = 0, after: tuple | None = None) -> DataFrame:
        """Most recent first, as ``history.page`` orders them, from the days that the page covers.

        ``after`` is the (time, id) of the last row already seen.
        """
        days, first = self.days(), 0
        if after is not None:
            bound = history.parse_time_bound(after[0]).date().isoformat()
            days = [d for d in days if d[0] is None or d[0] <= bound]
        else:
            while days and offset >= days[0][1]:
                offset -= days.pop(0)[1]
        taken, held = [], 0
        for i, (day, n) in enumerate(days):
            taken.append(day)
            # Of the day of ``after`` any number of rows may be seen already.
            held += 0 if after is not None and i == 0 and day is not None else n
            if held >= offset + limit:
                break
        rows = self.read(taken)
        if after is None and offset + limit <= TOP_ROWS:
            # So few rows each task keeps while it reads; a deeper page is located by counts.
            return rows.orderBy(F.desc(self.ts), F.desc(self.tie)).offset(offset).limit(limit).drop("dt")
        return history.page(rows, limit, offset, after, self.ts, self.tie).drop("dt")

    # --- writing ----------------------------------------------------------------------

    def _write(self, df: DataFrame) -> list[dict]:
        """Write a folder, not live yet; returns what the manifest says of it.

        The rebalance gathers each day's rows into few files and splits a large day, so
        neither many small files nor one huge writer result.
        """
        name = f"data/write={uuid.uuid4().hex}"
        with_day(df, self.ts).hint("rebalance", F.col("dt")).write.partitionBy("dt").parquet(f"{self.path}/{name}")
        if not any(n.startswith("dt=") for n, _ in commits.children(self.spark, f"{self.path}/{name}")):
            return []
        written = self.spark.read.schema(_plus(df.schema, dt="date")).parquet(f"{self.path}/{name}")
        # One row per day; counts come from the footers.
        rows = written.groupBy(F.col("dt").cast("string").alias("dt")).count().collect()
        return [
            {"dt": r.dt, "folder": f"{name}/dt={r.dt or '__HIVE_DEFAULT_PARTITION__'}", "rows": r["count"]} for r in rows
        ]

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add records. ``batch`` is the name and the batch number of a stream: a number that
        is not above the last one committed under the name adds nothing, and False comes back.
        """
        df = df.drop("dt")
        manifest = self._manifest()
        if self._seen(manifest, batch):
            return False
        fields = lambda schema: [(f["name"], f["type"]) for f in schema["fields"]]
        if manifest and fields(manifest["schema"]) != fields(df.schema.jsonValue()):
            raise ValueError("records need the columns that the store has")
        writes = self._write(df)
        added = False

        def update(old: dict | None) -> dict | None:
            nonlocal added
            added = not self._seen(old, batch)
            if not added:
                return None
            old = old or {"schema": df.schema.jsonValue(), "writes": [], "streams": {}}
            streams = {**old["streams"], **({batch[0]: batch[1]} if batch else {})}
            return {**old, "writes": [*old["writes"], *writes], "streams": streams}

        commits.change(self.spark, self._commits, update)
        commits.trim(self.spark, self._commits)
        return added

    @staticmethod
    def _seen(manifest: dict | None, batch: tuple[str, int] | None) -> bool:
        return bool(manifest and batch and manifest["streams"].get(batch[0], -1) >= batch[1])

    def merge(self, df: DataFrame) -> bool:
        """Add the records whose id is not stored yet, each id once, so that a repeated call
        adds nothing. Only the days that ``df`` has are looked at for ids. Of two calls side by
        side neither sees the other's records."""
        days = [r.dt for r in with_day(df, self.ts).select(F.col("dt").cast("string").alias("dt")).distinct().collect()]
        once = df.dropDuplicates([self.tie])
        if self._manifest() is not None:
            once = once.join(self.read(days).select(self.tie), self.tie, "left_anti").select(df.columns)
        return self.append(once)

    # --- retention --------------------------------------------------------------------

    def cleanup(self, now, retention_days: int = 30, grace_seconds: int = GRACE_SECONDS) -> int:
        """Remove records older than the retention; returns how many. Records without a time stay."""
        at = history.cutoff(now, retention_days)
        day, deleted = at.date().isoformat(), 0

        def update(old: dict | None) -> dict | None:
            nonlocal deleted
            writes = old["writes"] if old else []
            gone = [w for w in writes if w["dt"] is not None and w["dt"] < day]
            edge = [w for w in writes if w["dt"] == day]
            kept = self._read(old, edge) if edge else None
            rewritten = edge
            if edge:
                stays = history.kept_records(kept, now, retention_days, self.ts).drop("dt")
                n = stays.count()
                if n < sum(w["rows"] for w in edge):
                    rewritten = self._write(stays) if n else []
            deleted = sum(w["rows"] for w in [*gone, *edge]) - sum(w["rows"] for w in rewritten)
            if not deleted:
                return None
            left = [w for w in writes if w not in gone and w not in edge]
            return {**old, "writes": [*left, *rewritten]}

        commits.change(self.spark, self._commits, update)
        self.vacuum(grace_seconds)
        return deleted

    def compact(self, grace_seconds: int = GRACE_SECONDS) -> int:
        """Write the days that lie in several folders anew, each into one; returns how many days."""
        manifest = self._manifest()
        writes = manifest["writes"] if manifest else []
        several = {d for d in {w["dt"] for w in writes} if sum(w["dt"] == d for w in writes) > 1}
        if not several:
            return 0
        old_folders = {w["folder"] for w in writes if w["dt"] in several}
        fresh = self._write(self._read(manifest, [w for w in writes if w["folder"] in old_folders]).drop("dt"))

        def update(old: dict | None) -> dict | None:
            # A day that lost or replaced a folder meanwhile is left as it is.
            live = {w["folder"] for w in old["writes"]}
            whole = {d for d in several if {w["folder"] for w in writes if w["dt"] == d} <= live}
            replaced = {w["folder"] for w in writes if w["dt"] in whole}
            left = [w for w in old["writes"] if w["folder"] not in replaced]
            return {**old, "writes": [*left, *(w for w in fresh if w["dt"] in whole)]}

        commits.change(self.spark, self._commits, update)
        self.vacuum(grace_seconds)
        return len(several)

    def vacuum(self, grace_seconds: int = GRACE_SECONDS) -> int:
        """Delete folders that no manifest lists and that are older than the grace; returns how many."""
        manifest = self._manifest()
        live = {w["folder"] for w in manifest["writes"]} if manifest else set()
        before, gone = time.time() - grace_seconds, 0
        for write, _ in commits.children(self.spark, f"{self.path}/data"):
            found = [x for x in commits.children(self.spark, f"{self.path}/data/{write}") if x[0].startswith("dt=")]
            old = [name for name, changed in found if f"data/{write}/{name}" not in live and changed <= before]
            for name in old:
                commits.delete(self.spark, f"{self.path}/data/{write}/{name}")
            if found and len(old) == len(found):
                commits.delete(self.spark, f"{self.path}/data/{write}")
            gone += len(old)
        return gone

