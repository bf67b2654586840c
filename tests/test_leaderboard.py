"""Golden test: the reference's ten aggregate-score records must produce its
leaderboard and summary table (values below are the published results)."""


from summarium.operators import leaderboard as L

# The ten published aggregate records (name, total, ok, failed,
# success %, R1, R2, RL means, R1, R2, RL std, evaluation seconds).
AGGREGATES = [
    ("BART-Base", 200, 200, 0, 100.0, 46.16, 21.67, 29.92, 10.66, 10.87, 9.77, 15825.59),
    ("BART-Large-CNN", 200, 200, 0, 100.0, 41.02, 21.54, 30.83, 13.36, 15.87, 14.61, 9587.64),
    ("DistilBART", 200, 200, 0, 100.0, 42.05, 21.31, 30.32, 12.17, 13.49, 12.79, 3052.85),
    ("LED-ArXiv", 200, 200, 0, 100.0, 44.97, 20.76, 29.21, 11.31, 10.97, 10.17, 5946.02),
    ("LongT5-Base", 200, 200, 0, 100.0, 34.39, 14.43, 22.79, 10.72, 10.4, 9.94, 5663.54),
    ("mT5-Base", 200, 200, 0, 100.0, 14.92, 4.38, 10.14, 8.07, 4.7, 5.12, 2744.22),
    ("PEGASUS-CNN", 200, 200, 0, 100.0, 37.48, 17.72, 26.81, 10.26, 10.61, 10.6, 21900.08),
    ("PEGASUS-XSum", 200, 123, 77, 61.5, 33.27, 13.39, 21.82, 9.81, 7.62, 8.0, 1559.33),
    ("T5-Base", 200, 200, 0, 100.0, 38.11, 17.39, 27.08, 10.45, 10.92, 10.44, 3540.59),
    ("T5-Large", 200, 200, 0, 100.0, 40.26, 18.95, 28.45, 9.8, 10.82, 10.37, 43501.38),
]
# The published summary table (rank, model, R1, R2, RL, success %, hours).
SUMMARY = [
    (1, "BART-Base", 46.16, 21.67, 29.92, 100.0, 4.4),
    (2, "BART-Large-CNN", 41.02, 21.54, 30.83, 100.0, 2.66),
    (3, "DistilBART", 42.05, 21.31, 30.32, 100.0, 0.85),
    (4, "LED-ArXiv", 44.97, 20.76, 29.21, 100.0, 1.65),
    (5, "T5-Large", 40.26, 18.95, 28.45, 100.0, 12.08),
    (6, "PEGASUS-CNN", 37.48, 17.72, 26.81, 100.0, 6.08),
    (7, "T5-Base", 38.11, 17.39, 27.08, 100.0, 0.98),
    (8, "LongT5-Base", 34.39, 14.43, 22.79, 100.0, 1.57),
    (9, "PEGASUS-XSum", 33.27, 13.39, 21.82, 61.5, 0.43),
    (10, "mT5-Base", 14.92, 4.38, 10.14, 100.0, 0.76),
]
SCHEMA = ("model_name string, total_samples long, successful_samples long, failed_samples long, "
          "success_rate double, rouge1_mean double, rouge2_mean double, rougeL_mean double, "
          "rouge1_std double, rouge2_std double, rougeL_std double, evaluation_time_seconds double")


def board(spark):
    return L.project(spark.createDataFrame(AGGREGATES, SCHEMA))


def test_summary_table_golden(spark):
    got = [tuple(r) for r in L.summary(L.rank(board(spark))).orderBy("Rank").collect()]
    assert got == SUMMARY


def test_medals_and_selected(spark):
    r = L.with_selected(L.with_medal(L.rank(board(spark))))
    rows = {x["Model"]: x for x in r.collect()}
    assert rows["BART-Base"]["Medal"] == "GOLD" and rows["DistilBART"]["Medal"] == "BRONZE"
    assert rows["mT5-Base"]["Medal"] == ""
    assert [m for m, x in rows.items() if x["Selected"]] == ["LED-ArXiv"]


def test_totals_golden(spark):
    t = L.totals(board(spark)).first()
    assert t["total_models"] == 10 and t["full_success_models"] == 9
    assert t["total_successful"] == 1923 and t["total_failed"] == 77
    assert t["avg_rouge2"] == 17.15 and t["total_hours"] == 31.46


def test_best(spark):
    b = L.best(L.rank(board(spark))).first()
    assert b["best_model"] == "BART-Base" and b["best_rouge2"] == 21.67
    assert b["best_rougeL_model"] == "BART-Large-CNN"


def test_domain_shift(spark):
    ind = spark.createDataFrame([("BART-Large-CNN", 24.1), ("PEGASUS-CNN", 21.47)], "system string, score double")
    got = {r["Model"]: r["relative_change_pct"] for r in L.domain_shift(board(spark), ind).collect()}
    assert got == {"BART-Large-CNN": -10.6, "PEGASUS-CNN": -17.5}


def test_nan_sorts_last(spark):
    rows = AGGREGATES[:2] + [("Broken", 200, 0, 200, 0.0, float("nan"), float("nan"), float("nan"),
                              0.0, 0.0, 0.0, 1.0)]
    r = L.rank(L.project(spark.createDataFrame(rows, SCHEMA)))
    assert [x["Model"] for x in r.orderBy("Rank").collect()][-1] == "Broken"
