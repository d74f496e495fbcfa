"""Saved models: a folder per version, listed, rotated, and read at the start of a job.

    <path>/versions/<number>.json   what a version is, published last and at once
    <path>/models/<id>/...          its tables

A version whose marker is not there yet does not exist for readers, so a failed or unfinished
save is never scored with. Numbers only grow, also after old versions are gone.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from reqsieve.operators import scoring
from reqsieve.operators.scoring import BigramModel
from reqsieve.sources import commits

UNIGRAM_SCHEMA = "token string, id int, n bigint, log_p double"
PAIRS_SCHEMA = "prev_id int, id int, n bigint, share double"
VERSIONS_SCHEMA = "version bigint, kind string, vocab_size bigint, weight double, trained_on bigint, note string, created_at double, folder string"

# Fixed value: versions kept.
KEEP = 5


def save_model(
    model: DataFrame | BigramModel, path: str, trained_on: int | None = None, note: str | None = None,
    created_at: float | None = None,
) -> int:
    """Write a model as the next version; returns its number."""
    unigram = model.unigram if isinstance(model, BigramModel) else model
    spark = unigram.sparkSession
    folder = f"models/{uuid.uuid4().hex}"
    # A model has at most vocab_size rows, its pairs may have many.
    unigram.select("token", "id", "n", "log_p").coalesce(1).write.parquet(f"{path}/{folder}/unigram")
    told = {"kind": "unigram", "vocab_size": None, "weight": None}
    if isinstance(model, BigramModel):
        model.pairs.select("prev_id", "id", "n", "share").write.parquet(f"{path}/{folder}/pairs")
        told = {"kind": "bigram", "vocab_size": model.vocab_size, "weight": model.weight}
    told |= {
        "trained_on": trained_on, "note": note, "folder": folder,
        "created_at": time.time() if created_at is None else created_at,
    }
    while True:
        version = max(commits.numbers(spark, f"{path}/versions"), default=0) + 1
        if commits.publish(spark, f"{path}/versions", version, {"version": version, **told}):
            return version


def versions(spark: SparkSession, path: str) -> DataFrame:
    """One row per saved version, with the newest marked as current."""
    found = [commits.read(spark, f"{path}/versions", n) for n in commits.numbers(spark, f"{path}/versions")]
    names = [c.split()[0] for c in VERSIONS_SCHEMA.split(", ")]
    rows = spark.createDataFrame([tuple(f[c] for c in names) for f in found], VERSIONS_SCHEMA)
    return scoring.newest_versions(rows, keep=max(1, len(found)))


def current_version(spark: SparkSession, path: str) -> int | None:
    return max(commits.numbers(spark, f"{path}/versions"), default=None)


def load_model(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | BigramModel | None:
    """A saved model, by default the newest; None where there is none, which scores 0."""
    version = version or current_version(spark, path)
    if version is None:
        return None
    told = commits.read(spark, f"{path}/versions", version)
    folder = f"{path}/{told['folder']}"
    unigram = spark.read.schema(UNIGRAM_SCHEMA).parquet(f"{folder}/unigram")
    if told["kind"] == "unigram":
        return unigram
    pairs = spark.read.schema(PAIRS_SCHEMA).parquet(f"{folder}/pairs")
    return BigramModel(unigram, pairs, told["weight"], told["vocab_size"])


def rotate(spark: SparkSession, path: str, keep: int = KEEP) -> list[int]:
    """Remove all but the ``keep`` newest versions; returns the numbers that went.

    The marker goes first, so that nobody starts to read what is about to be removed. Jobs
    read the newest version, which is never the one to go while they start.
    """
    if keep < 1:
        raise ValueError("the newest version is always kept")
    gone = commits.numbers(spark, f"{path}/versions")[:-keep]
    for n in gone:
        folder = commits.read(spark, f"{path}/versions", n)["folder"]
        commits.delete(spark, f"{path}/versions/{n:012d}.json")
        commits.delete(spark, f"{path}/{folder}")
    return gone


def retrain(
    spark: SparkSession, path: str, delta: DataFrame, text: str = "text", alpha: float = 1.0,
    max_length: int | None = None, min_new_samples: int = 0, keep: int = KEEP, created_at: float | None = None,
) -> int | None:
    """Add new normal requests to the newest unigram model, save and rotate.

    Returns the new version, or None where there is no model to start from or fewer than
    ``min_new_samples`` new requests.
    """
    base = current_version(spark, path)
    if base is None:
        return None
    new = delta.count()
    if new < min_new_samples:
        return None
    old = commits.read(spark, f"{path}/versions", base)
    model = load_model(spark, path, base)
    if isinstance(model, BigramModel):
        raise ValueError("pair counts are fitted whole, not from a delta")
    counts = scoring.merge_counts(model.select("token", "id", "n"), delta, text, max_length)
    total = None if old["trained_on"] is None else old["trained_on"] + new
    version = save_model(scoring.unigram_model(counts, alpha), path, total, f"delta of version {base}", created_at)
    rotate(spark, path, keep)
    return version
