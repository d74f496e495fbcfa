from reqsieve.operators import evaluate


def test_error_rates(spark):
    df = spark.createDataFrame(
        [("benign", True), ("benign", False), ("benign", False), ("benign", True), ("attack", False), ("attack", True)],
        "label string, is_anomaly boolean",
    )
    r = evaluate.error_rates(df).first()
    assert (r.benign_total, r.false_positives, r.fpr) == (4, 2, 0.5)
    assert (r.attack_total, r.false_negatives, r.fnr) == (2, 1, 0.5)
    r = evaluate.error_rates(df.where("label = 'benign'")).first()
    assert (r.attack_total, r.fnr) == (0, None)


def test_case_totals(spark):
    cases = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", True)], "id int, name string, expected boolean")
    scored = spark.createDataFrame([(1, True), (2, True), (3, True)], "id int, is_anomaly boolean")
    results = evaluate.case_results(cases, scored, "id")
    assert {r.name: r.passed for r in results.collect()} == {"a": True, "b": False, "c": True}
    r = evaluate.case_totals(results).first()
    assert (r.total, r.passed, r.failed) == (3, 2, 1)


def test_evaluation_set(spark):
    routes = spark.createDataFrame(
        [("GET", "/", {}), ("GET", "/search", {"q": "old", "n": "1"})],
        "method string, path string, params map<string,string>",
    )
    payloads = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "position int, payload string")
    rows = evaluate.evaluation_set(routes, payloads, ["t0", "t1"], 3).collect()
    assert len(rows) == 3 * (2 + 12)
    terms = {r.iteration: r.params["q"] for r in rows if r.label == "benign" and r.path == "/search"}
    assert terms == {0: "t0", 1: "t1", 2: "t0"}
    assert {r.params["q"] for r in rows if r.label == "attack"} == {f"p{i}" for i in range(12)}
    assert evaluate.evaluation_set(routes, payloads, ["t"], 2, payload_limit=10).count() == 2 * 12
