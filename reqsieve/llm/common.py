"""Small helpers the operators share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.session import scratch_dir

# Words are runs of ASCII letters and digits and of everything beyond ASCII. A table for
# bytes.translate lower-cases A-Z and turns every other ASCII byte into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back; cuts the lineage."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that :func:`stored` wrote and that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    base = scratch_dir(df.sparkSession, "x").rpartition("/")[0]
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        # Only folders right below the scratch folder.
        if path.getParent().toUri().getPath() == sc._jvm.org.apache.hadoop.fs.Path(base).toUri().getPath():
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def probably_in(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = 24) -> DataFrame:
    """The ``rows`` whose ``keys`` occur in ``wanted``, and few others.

    A bitmap of key hashes is broadcast; it has at most 2^(bits - 6) rows of 64 bits whatever
    the tables' sizes. It spares a following exact join the shuffle of rows without a partner.
    """
    mark = f"xxhash64({', '.join(keys)}) & {(1 << bits) - 1}"
    held = wanted.selectExpr(f"{mark} AS mark").groupBy(F.expr("mark >> 6 AS place")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(mark & 63 AS INT))) AS held")
    )
    marked = rows.withColumn("mark", F.expr(mark))
    found = marked.join(F.broadcast(held), F.expr("mark >> 6 = place"))
    return found.where("(shiftright(held, CAST(mark & 63 AS INT)) & 1) = 1").select(rows.columns)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: no name of the caller's can clash with those that an
    operator adds, and none needs quoting. :func:`named` gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named(df: DataFrame, like: DataFrame) -> DataFrame:
    """The numbered columns of ``df`` under the names that ``like`` has."""
    return df.select([F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns)])


# Keys that may be broadcast as heavy.
HEAVY = 1000


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row a key and in ``n`` how many rows have it.

    Keys of more than one in ``HEAVY`` of the ``total`` rows are at most ``HEAVY``; their side is
    broadcast and their rows stay where they are, so no task gets all rows of one key.
    """
    heavy = f"n > {max(1, -(-total // HEAVY))}"
    names = [c for c in per_key.columns if c not in (key, "n")]
    at_hand = per_key.where(heavy).selectExpr(key, "true AS at_hand", *[f"{c} AS heavy_{c}" for c in names])
    tagged = rows.join(F.broadcast(at_hand), key, "left")
    light = tagged.where("at_hand IS NULL").select(rows.columns).join(per_key.where(f"NOT ({heavy})").drop("n"), key)
    near = tagged.where("at_hand").selectExpr(*rows.columns, *[f"heavy_{c} AS {c}" for c in names])
    return near.unionByName(light)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], purpose: str) -> DataFrame:
    """Add to each row the sums of the rows before it in the given order.

    Two levels, so that no task sees all rows: the rows are dealt out by range and stored,
    each range sums its own, and the totals of the ranges before it are added. There are as
    many totals as partitions, which bounds their broadcast.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    parts = stored(
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), purpose
    )
    by = ", ".join(f"{c} ASC NULLS LAST" for c in order)
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    totals = parts.groupBy("_part").agg(*[F.expr(f"sum({e}) AS _t_{n}") for n, e in sums.items()])
    offsets = totals.selectExpr(
        "_part", *[f"coalesce(sum(_t_{n}) OVER (ORDER BY _part {before}), 0) AS _o_{n}" for n in sums]
    )
    local = parts.selectExpr(
        "*",
        *[f"coalesce(sum({e}) OVER (PARTITION BY _part ORDER BY {by} {before}), 0) AS _l_{n}" for n, e in sums.items()],
    )
    return local.join(F.broadcast(offsets), "_part").selectExpr(
        *df.columns, *[f"_o_{n} + _l_{n} AS {n}" for n in sums]
    )


def worker_memo() -> dict:
    """What a Python worker keeps from one task to the next.

    Functions travel to the workers by value, so their module's globals are new in every
    task; a module registered under a name of its own is not.
    """
    name = "_reqsieve_worker"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return vars(sys.modules[name]).setdefault("memo", {})
