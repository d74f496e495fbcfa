"""Commits, the model store and the record store."""

import threading

import pytest
from pyspark.sql import functions as F

from reqsieve.operators import history, scoring
from reqsieve.sources import commits, model_store, record_store
from reqsieve.sources.record_store import RecordStore

DAY = 86_400


# --- commits ---------------------------------------------------------------------------


def test_numbers_are_never_overwritten(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert commits.newest(spark, folder) == (0, None)
    assert commits.publish(spark, folder, 1, {"a": "é"})
    assert not commits.publish(spark, folder, 1, {"a": 2})
    assert commits.newest(spark, folder) == (1, {"a": "é"})
    assert [n for n, _ in commits.children(spark, folder) if n.startswith(".draft")] == []


def test_change_starts_again_behind_another_writer(spark, tmp_path):
    folder, tries = str(tmp_path / "c"), []

    def update(old):
        tries.append(old)
        if len(tries) == 1:  # another writer is first
            commits.publish(spark, folder, 1, {"n": [0]})
        return {"n": [*(old or {"n": []})["n"], 9]}

    assert commits.change(spark, folder, update) == {"n": [0, 9]}
    assert tries == [None, {"n": [0]}]
    assert commits.change(spark, folder, lambda old: None) == {"n": [0, 9]}
    for i in range(5):
        commits.change(spark, folder, lambda old: {"n": [i]})
    commits.trim(spark, folder, keep=2)
    assert len(commits.numbers(spark, folder)) == 2 and commits.newest(spark, folder)[1] == {"n": [4]}


# --- models ----------------------------------------------------------------------------


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def test_save_list_rotate_and_score(spark, tmp_path):
    path = str(tmp_path / "m")
    assert model_store.load_model(spark, path) is None and model_store.current_version(spark, path) is None
    assert model_store.versions(spark, path).count() == 0
    assert model_store.retrain(spark, path, texts(spark, ["x"])) is None
    rows = texts(spark, ["GET /a", "GET /b?x=1", ""])
    model = scoring.fit_unigram(rows)
    want = sorted(map(tuple, scoring.score_unigram(rows, model, "id").collect()))
    for k in range(1, 5):
        assert model_store.save_model(model, path, trained_on=3, created_at=float(k)) == k
    assert model_store.rotate(spark, path, keep=2) == [1, 2]
    listed = model_store.versions(spark, path).orderBy("version").collect()
    assert [(r.version, r.kind, r.trained_on, r.created_at, r.is_current) for r in listed] == [
        (3, "unigram", 3, 3.0, False), (4, "unigram", 3, 4.0, True),
    ]
    assert len(commits.children(spark, f"{path}/models")) == 2
    # Numbers go on after old ones are gone.
    assert model_store.save_model(model, path) == 5
    back = model_store.load_model(spark, path)
    assert sorted(map(tuple, scoring.score_unigram(rows, back, "id").collect())) == want
    with pytest.raises(ValueError):
        model_store.rotate(spark, path, keep=0)


def test_bigram_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = texts(spark, ["GET /a/b", "GET /a/c", "POST /a"])
    model = scoring.fit_bigram(rows, vocab_size=50, weight=0.6)
    model_store.save_model(model, path)
    back = model_store.load_model(spark, path, 1)
    assert (back.weight, back.vocab_size) == (0.6, 50)
    scores = lambda m: sorted(map(tuple, scoring.score_bigram(rows, m, "id").collect()))
    assert scores(back) == scores(model)
    with pytest.raises(ValueError):
        model_store.retrain(spark, path, rows)


def test_retrain_equals_merged_counts(spark, tmp_path):
    path = str(tmp_path / "m")
    old, new = texts(spark, ["GET /a", "GET /b"]), texts(spark, ["GET /a?q=1", "PUT /zz"])
    model_store.save_model(scoring.fit_unigram(old), path, trained_on=2)
    assert model_store.retrain(spark, path, new, min_new_samples=3) is None
    assert model_store.retrain(spark, path, new, keep=1) == 2
    assert commits.numbers(spark, f"{path}/versions") == [2]
    merged = scoring.unigram_model(scoring.merge_counts(scoring.unigram_counts(old), new))
    got = model_store.load_model(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, merged.select("token", "id", "n", "log_p").collect()))
    assert model_store.versions(spark, path).first().trained_on == 4


def test_unpublished_save_does_not_exist(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    model = scoring.fit_unigram(texts(spark, ["GET /a"]))
    model_store.save_model(model, path)

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(commits, "publish", crash)
    with pytest.raises(OSError):
        model_store.save_model(model, path)
    monkeypatch.undo()
    assert model_store.current_version(spark, path) == 1 and model_store.load_model(spark, path).count() > 0


# --- records ---------------------------------------------------------------------------


def records(spark, times, start=0):
    rows = [(f"r{start + i:05d}", None if t is None else float(t), float(i % 7)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "request_id string, t double, anomaly_score double")
    return df.select("request_id", F.timestamp_seconds("t").alias("ts"), "anomaly_score")


def ids(df):
    return sorted(r.request_id for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return RecordStore(spark, str(tmp_path / "store"))


def test_appended_records_are_read_back(spark, store):
    with pytest.raises(ValueError):
        store.read()
    a, b = records(spark, [0, DAY - 1, DAY, None]), records(spark, [DAY + 5], 4)
    assert store.append(a) and store.append(b) and store.append(a.where("false"))
    assert ids(store.read()) == [f"r{i:05d}" for i in range(5)]
    assert store.days() == [("1970-01-02", 2), ("1970-01-01", 2), (None, 1)] and store.count() == 5
    assert ids(store.read(["1970-01-02"])) == ["r00002", "r00004"]
    assert store.read().drop("dt").schema == a.schema
    with pytest.raises(ValueError):
        store.append(a.withColumn("more", F.lit(1)))


def test_day_filter_prunes_partitions(spark, store):
    store.append(records(spark, [i * DAY / 2 for i in range(20)]))
    found = history.filter_history(store.read(), from_time=3 * DAY, to_time=4 * DAY)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dt" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ts" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert ids(found) == ["r00006", "r00007", "r00008"]


def test_repeated_batch_adds_nothing(spark, store):
    batch = records(spark, [1, 2, 3])
    assert store.append(batch, ("detect", 0)) and not store.append(batch, ("detect", 0))
    assert store.append(records(spark, [4], 3), ("detect", 1)) and not store.append(batch, ("detect", 0))
    # Another stream has numbers of its own; a plain append has none.
    assert store.append(records(spark, [5], 4), ("other", 0)) and store.append(records(spark, [6], 5))
    assert ids(store.read()) == [f"r{i:05d}" for i in range(6)]


def test_crash_before_the_commit_leaves_nothing(spark, store, monkeypatch):
    store.append(records(spark, [1]), ("detect", 0))

    def crash(*_, **__):
        raise OSError("lost")

    monkeypatch.setattr(commits, "change", crash)
    with pytest.raises(OSError):
        store.append(records(spark, [2], 1), ("detect", 1))
    monkeypatch.undo()
    assert ids(store.read()) == ["r00000"]
    assert store.append(records(spark, [2], 1), ("detect", 1))
    assert ids(store.read()) == ["r00000", "r00001"]
    assert store.vacuum(0) == 1 and ids(store.read()) == ["r00000", "r00001"]


def test_writers_side_by_side(spark, store):
    work = [threading.Thread(target=lambda k=k: store.append(records(spark, [k], k))) for k in range(4)]
    [w.start() for w in work]
    [w.join() for w in work]
    assert ids(store.read()) == [f"r{i:05d}" for i in range(4)]


def test_merge_adds_each_id_once(spark, store):
    first = records(spark, [1, DAY + 1])
    assert store.merge(first.union(first))
    again = first.union(records(spark, [2 * DAY], 2))
    store.merge(again)
    store.merge(again)
    assert ids(store.read()) == ["r00000", "r00001", "r00002"]


@pytest.mark.parametrize("now,keep", [(10 * DAY, 3), (10 * DAY + DAY // 2, 3), (9.5 * DAY + 1, 2), (400 * DAY, 30), (DAY, 30)])
def test_cleanup_row_by_row(spark, store, now, keep):
    times = [i * DAY / 4 for i in range(44)] + [None]
    store.append(records(spark, times[:20]))
    store.append(records(spark, times[20:], 20))
    stays = [f"r{i:05d}" for i, t in enumerate(times) if t is None or t >= now - keep * DAY]
    before = store.read()
    assert store.cleanup(now, keep) == len(times) - len(stays)
    assert ids(store.read()) == stays and store.count() == len(stays)
    # A reader that began before still finds all its files, until they are vacuumed.
    assert before.count() == len(times)
    assert store.cleanup(now, keep, grace_seconds=0) == 0
    assert ids(store.read()) == stays
    live = {w["folder"] for w in store._manifest()["writes"]}
    assert {f"data/{w}/{d}" for w, _ in commits.children(spark, f"{store.path}/data") for d, _ in commits.children(spark, f"{store.path}/data/{w}") if d.startswith("dt=")} == live


def test_cleanup_beside_an_append(spark, store, monkeypatch):
    store.append(records(spark, [0, 5 * DAY]))
    publish, first = commits.publish, []

    def late(*args):
        if not first:  # a batch is committed between reading the manifest and replacing it
            first.append(1)
            store.append(records(spark, [5 * DAY + 1, 1], 2))
        return publish(*args)

    monkeypatch.setattr(commits, "publish", late)
    assert store.cleanup(6 * DAY, 2) == 2
    assert ids(store.read()) == ["r00001", "r00002"]


def test_compact(spark, store):
    for i in range(4):
        store.append(records(spark, [i, DAY + i], 2 * i))
    assert store.compact(grace_seconds=0) == 2
    assert len(store._manifest()["writes"]) == 2 and store.compact() == 0
    assert ids(store.read()) == [f"r{i:05d}" for i in range(8)]


@pytest.mark.parametrize("top", [10_000, 0])
def test_pages_open_only_their_days(spark, store, monkeypatch, top):
    monkeypatch.setattr(record_store, "TOP_ROWS", top)
    times = [(i * 7919 % 500) * 1000.0 for i in range(500)] + [3000.0, 3000.0, None, None]
    store.append(records(spark, times[:300]))
    store.append(records(spark, times[300:], 300))
    order = sorted(range(len(times)), key=lambda i: (times[i] is not None, times[i] or 0, i), reverse=True)
    want = [f"r{i:05d}" for i in order]
    page = lambda **k: [r.request_id for r in store.page(**k).collect()]
    for limit, offset in ((10, 0), (100, 0), (7, 95), (50, 480), (10, 503), (10, 504), (1000, 0), (3, 86)):
        assert page(limit=limit, offset=offset) == want[offset : offset + limit], (limit, offset)
    for at in (0, 57, 86, 87, 400, 499):
        seen = (float(times[order[at]]), want[at])
        dated = [w for w in want[at + 1 :] if times[int(w[1:])] is not None]
        assert page(limit=40, after=seen) == dated[:40], at
    opened = lambda **k: {f.split("dt=")[1][:10] for f in store.page(**k).inputFiles()}
    newest = store.days()[0][0]
    assert opened(limit=20) == {newest}
    assert len(opened(limit=50, offset=70)) <= 2
