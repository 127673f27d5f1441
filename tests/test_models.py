import random

from conftest import TESTDATA
from pyspark.sql import functions as F

from tarmac.operators import learn
from tarmac.operators.quality import rmse
from tarmac.plans import QUERIES


def learnable(rows):
    dice = random.Random(11)
    data = []
    for i in range(600):
        x, z = dice.uniform(0, 10), dice.choice("ab")
        data.append((i, x, z, (3 * x if x > 5 else x) + (5 if z == "a" else 0) + dice.gauss(0, 0.1)))
    return rows("i:long x:double z:string y:double", data)


def test_boosting_beats_the_mean_and_survives_saving(rows, tmp_path):
    df = learnable(rows)
    df = learn.encode_static(learn.static_encoder("z", "hot").fit(df), df, "z", "hot")
    model = learn.boosted_trees(["x", "z_code"], "y", rounds=15, depth=3, rate=0.3).fit(df)
    predicted = learn.predict(model, df)
    error, spread = predicted.agg(rmse(F.col("y"), F.col("prediction")), F.stddev_pop("y")).first()
    assert error < spread / 4
    learn.save_model(model, f"{tmp_path}/m")
    again = learn.predict(learn.load_model(f"{tmp_path}/m"), df)
    assert predicted.select("i", "prediction").exceptAll(again.select("i", "prediction")).count() == 0


def test_unseen_label_gets_its_own_code(rows):
    model = learn.static_encoder("z", "hot").fit(rows("z:string", [("a",), ("b",)]))
    got = learn.encode_static(model, rows("z:string", [("q",), ("b",)]), "z", "hot").collect()
    assert {r.z: r.z_code for r in got} == {"q": 2, "b": 1}


def test_early_stopping_keeps_a_best_round(rows):
    df = learnable(rows).withColumn("held_out", F.col("i") % 5 == 0)
    model = learn.boosted_trees(["x"], "y", rounds=30, depth=2, rate=0.5, validation="held_out").fit(df)
    rounds = learn.best_round(model, df.filter("held_out")).collect()
    assert sum(r.best for r in rounds) == 1
    assert min(r.rmse for r in rounds) == next(r.rmse for r in rounds if r.best)


def test_random_search(rows):
    best, results = learn.random_search(learnable(rows), ["x"], "y", draws=2, folds=3, rounds=(2, 5))
    assert results.count() == 2 and best is not None


def test_staged_errors_equal_those_of_plain_fits(rows):
    df = learnable(rows)
    draws = [{"depth": 2, "rate": 0.3, "subsample": 1.0, "columns": 1.0}, {"depth": 1, "rate": 0.01, "subsample": 0.8, "columns": 1.0}, {"depth": 3, "rate": 0.2, "subsample": 0.7, "columns": 1.0}]
    found = {(r.draw, r.rounds): r for r in learn.staged_search(df, ["x"], "y", draws, (2, 4), ["i"], folds=2, keep=0.6).collect()}
    assert {r.dropped for r in found.values() if r.draw == 1} == {2}  # the slow one goes first
    assert {n for n, _ in found} == {0, 1, 2} and max(r for n, r in found if n == 1) == 2
    dealt = df.withColumn("fold", learn.hash_bucket(["i"], 42, 2))
    for number, rounds in ((0, 2), (0, 4), (2, 3)):
        d = draws[number]
        total = 0.0
        for fold in range(2):
            model = learn.boosted_trees(["x"], "y", rounds, d["depth"], d["rate"], d["subsample"]).fit(dealt.filter(F.col("fold") != fold))
            total += learn.predict(model, dealt.filter(F.col("fold") == fold)).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
        assert abs(found[number, rounds].mse - total / 2) < 1e-9


def test_drawn_parameters_keep_to_their_ranges():
    draws = learn.drawn_parameters(200)
    assert all(3 <= d["depth"] < 10 and 0.01 <= d["rate"] <= 0.11 and 0.6 <= d["subsample"] <= 1 for d in draws)


def test_forecast_fills_the_template(spark):
    out = QUERIES["gbt_forecast"](spark, TESTDATA)
    assert out.filter("NOT ID RLIKE '^[a-z]+_[0-9]{6}_[0-9]{4}_[0-9]+$' OR NOT is_count").count() == 0
    assert out.count() == out.select("ID").distinct().count() > 0


def test_trees_with_weather_beat_the_last_count(spark):
    from tarmac.plans import models

    table, _ = models.training_table(spark, TESTDATA)
    train, validation = models._parts(table)
    model = learn.boosted_trees(models.FEATURES, "value", rounds=8, depth=3, rate=0.3).fit(train)
    ours, last = learn.predict(model, validation).agg(rmse(F.col("value"), F.col("prediction")), rmse(F.col("value"), F.col("value_lag_0"))).first()
    assert ours < last
    assert {"temperature_lag_0", "visibility", "wind_speed_lag_3"} <= set(models.FEATURES)


def test_blend_scores(spark):
    got = {r.model: r for r in QUERIES["blended_forecast"](spark, TESTDATA).collect()}
    assert set(got) == {"trees", "linear", "blend"}
    assert all(r.is_score and r.not_above_worst for r in got.values())


def test_saved_model_predicts_the_same(spark):
    out = QUERIES["saved_model_forecast"](spark, TESTDATA)
    assert out.filter("NOT same").count() == 0 and out.count() > 0
