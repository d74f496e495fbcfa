"""Near duplicates by ProbMinHash signatures, banding and exact verification.

A text is the weighted set of its runs of five words; the weight of a run that occurs n times
is 1 + ln n. Each element sends arrivals of a Poisson process of its rate to random registers;
a register keeps the element of its earliest arrival, and an element stops once its next
arrival is later than every register's. Two texts agree in a register with their probability
Jaccard similarity, which for equal weights is the plain one.

Texts with the same words are one node. Nodes that agree in a band of ``ROWS`` registers share
a bucket; with 26 bands of 5 a pair at 0.8 is missed with probability 4e-5. A bucket can be as
large as a group of copies, so its pairs are not enumerated: the member with the most company
is its hub, and every other member is compared with the hub. Connected components follow. Only
where members of one bucket are still in different components are the pairs between these
components compared, which makes the result that of all pairs of all buckets.

A pair is linked if the plain Jaccard similarity of its sets of runs, counted exactly, is at
least ``SIMILARITY``. For this the texts of candidates are read again; a hub's partners are dealt
out in chunks of bounded size.

Defined results: a text of one to four words is one run; texts without words (null, empty) are
never grouped; rows that repeat doc_id and text are copies like any others; the representative is the
smallest doc_id, rows without one last; an empty table gives no rows; ``deduplicated`` keeps
all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import WORD_BYTES, named, numbered, spread_join, stored
from reqsieve.llm.components import components

RUN = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
# Bytes of text whose runs are hashed at once; runs of partners that meet a hub in one group.
CHUNK_BYTES = 1 << 20
GROUP_RUNS = 200_000

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word, all at once: a polynomial over the bytes, as differences
    of running sums, each shifted back to the start of its word."""
    raw = np.frombuffer(data, np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    base, n = 0x100000001B3, len(raw)
    powers = _powers(base, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)])
    back = _powers(pow(base, -1, 1 << 64), n)
    return starts, _mixed((sums[ends] - sums[starts]) * back[starts])


def runs_of(texts: list[bytes], size: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, run, count) of the distinct runs of words, by text, then run; runs are 48-bit
    hashes. ``texts`` are lower-cased words between spaces, at most 65,536 of them."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts, words = _word_hashes(b" ".join(texts) + b" ")
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    per_text = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(per_text) - per_text
    found = []
    for n in range(1, size + 1):
        if n < size:
            at = first[per_text == n]
        else:
            at = np.arange(max(len(words) - size + 1, 0))
            at = at[owner[at] == owner[at + size - 1]]
        total = np.full(len(at), n, np.uint64)
        for k in range(n):
            total += words[at + k] * np.uint64(_ODD[k])
        found.append((owner[at].astype(np.uint64) << np.uint64(48)) | (_mixed(total) >> np.uint64(16)))
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), counts


def signatures(owner: np.ndarray, runs: np.ndarray, weights: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """The element in each of ``size`` registers of every text (row); 0 where there is none."""
    earliest = np.full(n_texts * size, np.inf)
    kept = np.zeros(n_texts * size, np.uint64)
    time, step = np.zeros(len(runs)), 0
    while len(runs):
        draw = _mixed(runs * np.uint64(_ODD[0]) + np.uint64(step * _ODD[1] & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weights
        at = owner * size + (_mixed(draw ^ np.uint64(_ODD[2])) % np.uint64(size)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        kept[at[won]] = runs[won]
        # An element whose arrival is later than all registers can win none any more.
        active, place = np.unique(owner, return_inverse=True)
        latest = earliest.reshape(n_texts, size)[active].max(axis=1)
        alive = time < latest[place]
        owner, runs, weights, time = owner[alive], runs[alive], weights[alive], time[alive]
        step += 1
    return kept.reshape(n_texts, size)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = _mixed(registers).reshape(len(registers), bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_ODD[4])
    total = np.broadcast_to(total, (len(registers), bands)).copy()
    for k in range(rows):
        total += parts[:, :, k] * np.uint64(_ODD[k])
    return _mixed(total).view(np.int64)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their words; a slice ends at ``CHUNK_BYTES`` of text."""
    for batch in batches:
        lo, held, texts = 0, 0, []
        for i, t in enumerate(batch["text"]):
            words = b" ".join((t.as_py() or "").encode("utf-8", "replace").translate(WORD_BYTES).split())
            texts.append(words)
            held += len(words)
            if held >= CHUNK_BYTES or len(texts) == 4096:
                yield batch.slice(lo, len(texts)), texts
                lo, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(lo, len(texts)), texts


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, body (digest of the text), node (digest of its words), n_runs, bands per row."""
    key = dict(docs.dtypes)["doc_id"]

    def sign(batches):
        for batch, texts in _chunks(batches):
            owner, runs, counts = runs_of(texts)
            registers = signatures(owner, runs, 1 + np.log(counts), len(texts), BANDS * ROWS)
            sizes = np.bincount(owner, minlength=len(texts))
            keys = band_keys(registers)
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1))
            )
            nodes = [hashlib.md5(t).digest() if t else None for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["body"], pa.array(nodes, pa.binary()), pa.array(sizes), bands],
                names=["doc_id", "body", "node", "n_runs", "bands"],
            )

    rows = docs.selectExpr("doc_id", "md5(coalesce(text, '')) AS body", "text")
    return rows.mapInArrow(sign, f"doc_id {key}, body string, node binary, n_runs bigint, bands array<bigint>")


def _run_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, runs (sorted 64-bit values) for the texts in ``wanted`` (doc_id, body, node)."""

    def sets(batches):
        for batch, texts in _chunks(batches):
            owner, runs, _ = runs_of(texts)
            cuts = np.searchsorted(owner, np.arange(1, len(texts)))
            data = [part.tobytes() for part in np.split(runs, cuts)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(data, pa.binary())], names=["node", "runs"])

    texts = (
        docs.selectExpr("doc_id AS id", "md5(coalesce(text, '')) AS text_body", "text")
        .join(wanted, F.expr("id <=> doc_id AND text_body = body"))
        .select("node", "text")
    )
    # A row that occurs twice gives the same set twice.
    return texts.mapInArrow(sets, "node binary, runs binary").groupBy("node").agg(F.first("runs").alias("runs"))


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, extras: bool = False) -> DataFrame:
    """The pairs (a, b) with their exact similarity, the number of runs they share and, if
    asked for, the runs that b has beyond a."""
    wanted = pairs.selectExpr("explode(array(a, b)) AS node").distinct().join(nodes, "node")
    wanted = stored(wanted.select("node", "first.doc_id", "first.body"), "near-candidates")
    sets = stored(_run_sets(docs, wanted), "near-sets")
    weight = pairs.groupBy("a").agg(F.expr(f"1 + sum(b_runs) div {GROUP_RUNS} AS chunks"), F.count("*").alias("n"))
    dealt = spread_join(pairs, weight, "a", pairs.count()).selectExpr("a", "b", "pmod(xxhash64(b), chunks) AS chunk")
    partners = dealt.join(sets, F.expr("b = node")).select("a", "chunk", "b", "runs")
    hubs = (
        dealt.select("a", "chunk").distinct().join(sets, F.expr("a = node"))
        .selectExpr("a", "chunk", "CAST(NULL AS binary) AS b", "runs")
    )

    def compare(group: pa.Table) -> pa.Table:
        names, sets = group["b"].to_pylist(), group["runs"].to_pylist()
        hub = np.frombuffer(sets[names.index(None)], np.uint64)
        found: dict[str, list] = {"a": [], "b": [], "similarity": [], "shared": [], "extra": []}
        for b, runs in zip(names, sets):
            if b is not None:
                other = np.frombuffer(runs, np.uint64)
                in_hub = np.isin(other, hub, assume_unique=True)
                shared = int(in_hub.sum())
                row = (group["a"][0].as_py(), b, shared / max(len(hub) + len(other) - shared, 1), shared,
                       other[~in_hub].view(np.int64) if extras else [])
                for column, value in zip(found.values(), row):
                    column.append(value)
        types = (pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(found.items(), types)})

    return partners.unionByName(hubs).groupBy("a", "chunk").applyInArrow(
        compare, "a binary, b binary, similarity double, shared bigint, extra array<bigint>"
    )


def _links(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Verified links between nodes; their components are those of all similar bucket mates."""
    entries = nodes.selectExpr("node", "n_runs", "explode(bands) AS bucket")
    shared = stored(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets")
    members = stored(entries.join(shared, "bucket"), "near-members")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = (
        members.join(company, "node").groupBy("bucket")
        .agg(F.expr("max(struct(company, node, n_runs)) AS hub"))
        .selectExpr("bucket", "hub.node AS hub", "hub.n_runs AS hub_runs")
    )
    near = "least({x}, {y}) >= %r * greatest({x}, {y})" % similarity
    members = stored(members.join(hubs, "bucket").drop("n"), "near-members")
    pairs = stored(
        members.where("node <> hub AND " + near.format(x="n_runs", y="hub_runs"))
        .selectExpr("hub AS a", "node AS b", "n_runs AS b_runs").distinct(),
        "near-pairs",
    )
    compared = stored(verified(docs, pairs, nodes, True), "near-links")
    links = compared.where(f"similarity >= {similarity}").select("a", "b")

    # What hubs did not join: pairs across the components of a bucket. Two members share at most
    # the runs that both have in common with the hub, plus those that both have beyond it; a
    # member too unlike the hub in size to be compared is bounded by its size alone. What the
    # bound rules out is no link, and only the rest is paired and counted.
    roots = components(links)
    rest = members.join(roots, "node", "left").selectExpr(
        "bucket", "node", "n_runs", "hub", "coalesce(root, node) AS root"
    )
    open_buckets = rest.groupBy("bucket").agg(F.expr("min(root) <> max(root) AS open")).where("open").select("bucket")
    rest = stored(
        rest.join(open_buckets, "bucket").where("node <> hub")
        .join(compared.selectExpr("a AS hub", "b AS node", "shared", "extra"), ["hub", "node"], "left")
        .selectExpr("bucket", "node", "n_runs", "root", "coalesce(shared, n_runs) AS shared", "extra"),
        "near-rest",
    )
    other = rest.selectExpr(*[f"{c} AS {c}_b" for c in rest.columns])
    needed = f"{similarity / (1 + similarity)!r} * (n_runs + n_runs_b) - 1e-6"
    cross = (
        rest.join(other, F.expr(
            f"bucket = bucket_b AND root < root_b AND {near.format(x='n_runs', y='n_runs_b')} AND "
            f"least(shared, shared_b) + coalesce(array_size(array_intersect(extra, extra_b)), least(n_runs, n_runs_b)) >= {needed}"
        ))
        .selectExpr("node AS a", "node_b AS b", "n_runs_b AS b_runs").distinct()
    )
    known = pairs.select("a", "b").unionByName(pairs.selectExpr("b AS a", "a AS b"))
    cross = stored(cross.join(known, ["a", "b"], "left_anti"), "near-pairs")
    if cross.isEmpty():
        return links
    more = verified(docs, cross, nodes).where(f"similarity >= {similarity}").select("a", "b")
    return stored(links.unionByName(more), "near-links")


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and for each node its class: the first row of it and its size."""
    rows = stored(signed(docs), "near-signatures")
    first = "struct(doc_id IS NULL AS last, doc_id, body)"
    nodes = stored(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.expr(f"min({first}) AS first"), F.expr("min(struct(n_runs, bands)) AS signed"),
            F.count("*").alias("copies"),
        ).selectExpr("node", "first", "copies", "signed.n_runs AS n_runs", "signed.bands AS bands"),
        "near-nodes",
    )
    links = _links(docs, nodes, similarity)
    grouped = stored(
        nodes.drop("bands", "n_runs").join(components(links), "node", "left")
        .selectExpr("node", "first", "copies", "coalesce(root, node) AS root"),
        "near-classes",
    )
    classes = grouped.groupBy("root").agg(F.min("first").alias("keep"), F.sum("copies").alias("class_size"))
    return rows, grouped.join(classes, "root").select("node", "keep", "class_size")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the doc_id that stands for its class), class_size per row.

    Documents are in one class if links lead from one to the other.
    """
    rows, classes = _classes(docs.select("doc_id", "text"), similarity)
    return rows.select("doc_id", "node").join(classes, "node", "left").selectExpr(
        "doc_id", "CASE WHEN node IS NULL THEN doc_id ELSE keep.doc_id END AS class_id",
        "coalesce(class_size, 1L) AS class_size",
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one of each class, and all rows without words."""
    rows, classes = _classes(docs.select("doc_id", "text"), similarity)
    kept = rows.where("node IS NULL").selectExpr("doc_id", "body", "false AS repeated")
    copies = rows.where("node IS NOT NULL").groupBy("node", "doc_id", "body").agg(F.count("*").alias("n"))
    stays = copies.join(classes, "node").where("doc_id <=> keep.doc_id AND body = keep.body")
    kept = stored(kept.distinct().unionByName(stays.selectExpr("doc_id", "body", "n > 1 AS repeated")), "near-kept")
    id_at, text_at = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    found = numbered(docs).withColumn("digest", F.expr(f"md5(coalesce({text_at}, ''))")).join(
        kept, F.expr(f"{id_at} <=> doc_id AND digest = body")
    )
    if kept.where("repeated").isEmpty():
        return named(found, docs)
    # Rows that repeat id and text: one of them stays.
    once = found.where("repeated").dropDuplicates([id_at, "digest"])
    return named(found.where("NOT repeated").unionByName(once), docs)
