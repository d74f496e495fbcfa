"""Models and scores against a direct computation."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqsieve.operators import scoring

SPLIT = re.compile(r"([/?=&:#.;,\[\]{}()<>\-_'\"|`~!@^*+\\])")
TEXTS = ["GET /a?x=1", "GET /a?x=2", "GET /b", "POST /b?y=1", "", "GET /a?x=' OR '1'='1"] * 3


def seq(text):
    return [t for t in SPLIT.split(text) if t and not t.isspace()] + ["[SEP]"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def unigram(texts, vocab_size, alpha=1.0):
    n = Counter(t for x in texts for t in seq(x))
    known = sorted((t for t in n if t != "[SEP]"), key=lambda t: (-n[t], t))[: vocab_size - 4]
    counts = {t: n[t] for t in known} | {"[SEP]": n["[SEP]"]}
    counts["[UNK]"] = sum(n.values()) - sum(counts.values())
    mass = sum(counts.values()) + alpha * len(counts)
    return {t: math.log((c + alpha) / mass) for t, c in counts.items()}


def test_unigram_scores(spark):
    for size in (6, 10, 100):
        want = unigram(TEXTS, size)
        model = scoring.fit_unigram(frame(spark), vocab_size=size)
        got = {r.token: r.log_p for r in model.collect()}
        assert got == pytest.approx(want)
        assert sum(math.exp(v) for v in got.values()) == pytest.approx(1)
        scores = {r.id: r.anomaly_score for r in scoring.score_unigram(frame(spark), model, "id").collect()}
        for i, t in enumerate(TEXTS):
            losses = [-want.get(x, want["[UNK]"]) for x in seq(t)]
            assert scores[i] == pytest.approx(sum(losses) / len(losses))


def bigram_score(texts, text, size, weight):
    uni = unigram(texts, size)
    name = lambda t: t if t in uni else "[UNK]"
    pairs, starts = Counter(), Counter()
    for x in texts:
        s = ["[CLS]", *map(name, seq(x))]
        pairs.update(zip(s, s[1:]))
        starts.update(s[:-1])
    s = ["[CLS]", *map(name, seq(text))]
    loss = [
        -math.log(weight * (pairs[a, b] / starts[a] if starts[a] else 0) + (1 - weight) * math.exp(uni[b]))
        for a, b in zip(s, s[1:])
    ]
    return sum(loss) / len(loss)


def test_bigram_scores_in_any_number_of_blocks(spark):
    new = [*TEXTS[:6], "PUT /zzz", "GET GET /a", "? ? ?"]
    model = scoring.fit_bigram(frame(spark), vocab_size=9, weight=0.6)
    want = {i: bigram_score(TEXTS, t, 9, 0.6) for i, t in enumerate(new)}
    for rows in (10**6, 9, 3):
        got = scoring.score_bigram(frame(spark, new), model, "id", pair_block=rows)
        assert {r.id: r.anomaly_score for r in got.collect()} == pytest.approx(want)


def test_longer_than_length_is_cut(spark):
    model = scoring.fit_unigram(frame(spark), max_length=4)
    got = {r.id: r.anomaly_score for r in scoring.score_unigram(frame(spark), model, "id", max_length=4).collect()}
    cut = {r.token: -r.log_p for r in model.collect()}
    assert got[0] == pytest.approx((cut["GET "] + cut["/"] + cut["[SEP]"]) / 3)
    assert scoring.effective_length(512, 128) == 128 and scoring.effective_length(64) == 64


def test_flag_is_strict_and_confidence_clamped(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (9.0,)], "anomaly_score double")
    got = [(r.is_anomaly, r.confidence) for r in scoring.with_decision(df, 1.0).collect()]
    assert got == [(False, 0.0), (False, 0.0), (True, 0.5), (True, 1.0)]
    got = [(r.is_anomaly, r.confidence) for r in scoring.with_decision(df, 0.0).collect()]
    assert got == [(True, 1.0)] * 4


def test_no_model_scores_zero(spark):
    got = scoring.score_requests(frame(spark), None, "id", 0.0).collect()
    assert len(got) == len(TEXTS)
    assert {(r.anomaly_score, r.is_anomaly, r.confidence) for r in got} == {(0.0, False, 0.0)}


def test_rethreshold_keeps_scores(spark):
    df = spark.createDataFrame([(2.0, False, 5.0)], "anomaly_score double, is_anomaly boolean, threshold double")
    r = scoring.rethreshold(df, 1.0).first()
    assert (r.anomaly_score, r.is_anomaly, r.threshold, r.confidence) == (2.0, True, 1.0, 1.0)


def test_merge_equals_fit_on_all_when_vocabulary_is_shared(spark):
    old, new = TEXTS[:10], TEXTS[10:] + ["zz/qq"]
    counts = scoring.unigram_counts(frame(spark, old))
    merged = {r.token: r.n for r in scoring.merge_counts(counts, frame(spark, new)).collect()}
    n = Counter(t for x in old + new for t in seq(x))
    known = {t for x in old for t in seq(x)}
    want = {t: n[t] for t in known} | {"[UNK]": sum(v for t, v in n.items() if t not in known)}
    assert merged == want


def test_model_of_no_requests_scores_everything(spark):
    model = scoring.fit_unigram(frame(spark, TEXTS).where("false"))
    df = frame(spark, TEXTS).withColumn("id", F.monotonically_increasing_id())
    assert all(r.anomaly_score is not None for r in scoring.score_unigram(df, model, "id").collect())


def test_split_is_complete_and_repeatable(spark):
    df = spark.range(1000)
    train, held = scoring.split_train_validation(df, "id")
    a, b = {r.id for r in train.collect()}, {r.id for r in held.collect()}
    assert not a & b and len(a | b) == 1000 and 700 < len(a) < 900
    again = scoring.split_train_validation(df.repartition(7), "id")[0]
    assert {r.id for r in again.collect()} == a


def test_versions(spark):
    df = spark.createDataFrame([(v,) for v in (1, 12, 3, 7, 10, 2)], "version int")
    got = {r.version: r.is_current for r in scoring.newest_versions(df, 3).collect()}
    assert got == {12: True, 10: False, 7: False}
    assert scoring.next_version(df).first().next_version == 13
    assert scoring.next_version(df.where("version > 99")).first().next_version == 1


def test_custom_scorer(spark):
    scores = scoring.score_with(frame(spark), lambda: lambda texts: texts.str.len(), "id")
    assert {r.id: r.anomaly_score for r in scores.collect()} == {i: float(len(t)) for i, t in enumerate(TEXTS)}


def test_model_reads_each_text_once(spark):
    """One scan of the corpus per fit: the plan has a single source."""
    plan = scoring.unigram_counts(frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_bigram_batches_are_looked_up_in_slices(spark, monkeypatch):
    """A batch of long texts is cut by its positions; no row is lost, doubled or cut."""
    sizes = [0, 3, 9, 1, 0, 50, 2, 2, 2]
    lists = pa.array([[f"t{i}"] * n for i, n in enumerate(sizes)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), lists], names=["key", "sequence"]).slice(1)
    for most in (1, 4, 10, 1000):
        parts = list(scoring._slices([batch, batch.slice(0, 0), batch], most))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch, batch]))
        for part in parts:
            assert part.num_rows == 1 or len(part["sequence"].flatten()) <= most
    assert len(list(scoring._slices([batch], 1000))) == 1
    # The result does not depend on the slices.
    df = spark.createDataFrame([(i, "/a/b?c=" * (i % 7) + str(i % 3)) for i in range(60)], "id int, text string").coalesce(1)
    found = []
    for most in (500_000, 5):
        monkeypatch.setattr(scoring._slices, "__defaults__", (most,))
        model = scoring.fit_bigram(df, vocab_size=50)
        found.append((
            sorted((r.prev_id, r.id, r.n) for r in model.pairs.collect()),
            sorted((r.id, round(r.anomaly_score, 9)) for r in scoring.score_bigram(df, model, "id").collect()),
        ))
    assert found[0] == found[1] and len(found[0][1]) == 60
