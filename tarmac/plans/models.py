"""Forecast models on the supervised windows of the counted grid, with weather beside the counts.

Fits depend on sampling, so no SQL gives their numbers. The SQL says which rows a query must have and what must hold for
each; the tests compare with naive forecasts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import numeric, timebucket
from tarmac.functions.timebucket import MINUTE_US, epoch_us, from_us
from tarmac.operators import learn, ordered, scale, series, split, submission
from tarmac.operators.asof import asof_observation
from tarmac.plans import standins as s
from tarmac.plans.registry import query
from tarmac.plans.series import counted
from tarmac.session import scratch

PAST = [f"{c}_lag_{k}" for c in ("value", *s.WEATHER) for k in range(4)]
FEATURES = [*PAST, *s.WEATHER, "step", "hour_sin", "hour_cos", "day_sin", "day_cos", "station_ord"]
VALIDATION_CYCLE = 3
#: Rounds of the queries' fits, and of the search: its draws, and the rounds at which the worse half goes.
ROUNDS, STOPPED_ROUNDS = 20, 40
DRAWS, STAGES = 4, (2, 5)


def training_table(spark, folder):
    """One row per window and step: scaled lags, observed weather at the lags and at the target instant (gaps filled along
    the station, else 0), time features of that instant, station code, scaled target."""
    rows = counted(spark, folder, "train").select("station", "station_ord", "cycle", "bucket_end", "value")
    params = scale.fit_minmax(rows.filter(F.col("cycle") < VALIDATION_CYCLE), ["value"])
    weather = asof_observation(rows, s.observations(spark, folder), s.WEATHER, [F.col("event_id")])
    weather = ordered.fill_both(weather, ["station"], "bucket_end", s.WEATHER).fillna(0.0, s.WEATHER)
    scaled = scale.apply_minmax(weather, params, ["value"])
    windows = series.supervised_windows(scaled, ["station", "station_ord", "cycle"], "bucket_end", "value", s.WEATHER, s.WEATHER)
    steps = series.long_steps(windows, ["station", "cycle"], "value", s.WEATHER)
    at = from_us(epoch_us("bucket_end") + F.col("step").cast("long") * F.lit(15 * MINUTE_US))
    hour_sin, hour_cos = numeric.cyclic(F.hour("at"), 24)
    day_sin, day_cos = numeric.cyclic(timebucket.monday_weekday("at"), 7)
    table = steps.withColumn("at", at).withColumns(
        {
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "day_sin": day_sin,
            "day_cos": day_cos,
            "part": split.chronological_part(F.col("cycle"), VALIDATION_CYCLE),
        }
    )
    return learn.materialised(table, "training"), params


def _parts(table):
    return table.filter("part = 'train'"), table.filter("part = 'validation'")


_TEMPLATE = f"""{s.counts_sql('train')},
    t AS (SELECT *, time_bucket(INTERVAL 4 HOURS, bucket_end - INTERVAL 1 MICROSECOND) AS block FROM counted WHERE cycle >= {VALIDATION_CYCLE})"""


@query(
    "gbt_forecast",
    f"""{_TEMPLATE} SELECT station || '_' || strftime(block + INTERVAL 1 HOUR, '%y%m%d_%H00_') || (date_diff('minute', block, bucket_end) - 60) AS "ID",
    station, bucket_end, true AS is_count FROM t WHERE date_diff('minute', block, bucket_end) > 60""",
)
def gbt_forecast(spark, folder):
    """Twelve steps ahead from four lags and the weather with one model; predictions unscaled, rounded, named and joined to
    the template, each row of which gets a count."""
    table, params = training_table(spark, folder)
    train, validation = _parts(table)
    model = learn.boosted_trees(FEATURES, "value", rounds=ROUNDS, depth=4, rate=0.2).fit(train)
    context = validation.filter(timebucket.block_pos("bucket_end") == 3)
    predicted = submission.to_submission(learn.predict(model, context).select("station", "at", "prediction"), params)
    template = submission.template_rows(s.grid(spark, folder, "train").filter(F.col("cycle") >= VALIDATION_CYCLE))
    done = submission.complete_submission(template, predicted)
    return done.select("ID", "station", "bucket_end", F.coalesce(F.col("Value") >= 0, F.lit(False)).alias("is_count"))


@query("blended_forecast", "SELECT unnest(['trees', 'linear', 'blend']) AS model, true AS is_score, true AS not_above_worst")
def blended_forecast(spark, folder):
    """Validation error of trees, a linear model and their mean, on z-scored features; the mean is never the worst."""
    table, _ = training_table(spark, folder)
    train, validation = _parts(table)
    fitted = scale.fit_zscore(train, FEATURES)
    train, validation = scale.apply_zscore(train, fitted), scale.apply_zscore(validation, fitted)
    trees = learn.boosted_trees(FEATURES, "value", rounds=ROUNDS, depth=4, rate=0.2).fit(train)
    line = learn.linear(FEATURES, "value").fit(train)
    both = learn.predict(line, learn.predict(trees, validation, "trees"), "linear")
    scores = learn.materialised(learn.scores(learn.blend(both, ["trees", "linear"]), "value", ["trees", "linear", "blend"]), "scores")
    worst = scores.filter("model <> 'blend'").agg(F.max("rmse")).first()[0]
    return scores.select("model", F.col("score").between(0, 1).alias("is_score"), (F.col("rmse") <= worst + 1e-9).alias("not_above_worst"))


@query("early_stopped_boosting", "SELECT 1::BIGINT AS best_rounds, true AS best_is_least, true AS within_rounds")
def early_stopped_boosting(spark, folder):
    """One fit that stops when the held-out error stops falling, and the error after each round."""
    table, _ = training_table(spark, folder)
    marked = split.hash_split(table.drop("part"), ["station", "bucket_end", "step"])
    marked = marked.withColumn("held_out", F.col("part") == "validation")
    model = learn.boosted_trees(FEATURES, "value", rounds=STOPPED_ROUNDS, depth=3, rate=0.3, validation="held_out").fit(marked)
    rounds = learn.best_round(model, marked.filter("held_out"))
    return rounds.agg(
        F.count_if("best").alias("best_rounds"),
        (F.min("rmse") == F.min(F.when(F.col("best"), F.col("rmse")))).alias("best_is_least"),
        F.max("round").between(1, STOPPED_ROUNDS).alias("within_rounds"),
    )


@query(
    "random_search",
    f"SELECT draw::INTEGER AS draw, true AS scored, true AS falls FROM generate_series(0, {DRAWS - 1}) g(draw)",
)
def random_search(spark, folder):
    """Cross-validated errors of sampled tree parameters after every round, the worse half dropped at each stage."""
    table, _ = training_table(spark, folder)
    found = learn.staged_search(_parts(table)[0], FEATURES, "value", learn.drawn_parameters(DRAWS), STAGES, ["station", "bucket_end", "step"])
    first = F.min(F.struct("rounds", "mse"))["mse"]
    scored = (F.min("mse") > 0) & (F.max("rounds") == F.coalesce(F.max("dropped"), F.lit(STAGES[-1])))
    return found.groupBy("draw").agg(scored.alias("scored"), (F.min("mse") <= first).alias("falls"))


@query(
    "saved_model_forecast",
    f"""{s.counts_sql('train')}, numbered AS (SELECT station, cycle, bucket_end, row_number() OVER (PARTITION BY station, cycle ORDER BY bucket_end) AS r,
      count(*) OVER (PARTITION BY station, cycle) AS n FROM counted WHERE cycle >= {VALIDATION_CYCLE})
    SELECT station, bucket_end + to_minutes(step * 15) AS "at", step::INTEGER AS step, true AS same
    FROM numbered, generate_series(1, 12) g(step) WHERE r >= 4 AND r + 12 <= n""",
)
def saved_model_forecast(spark, folder):
    """A model read back from the shared folder predicts as before."""
    table, _ = training_table(spark, folder)
    train, validation = _parts(table)
    model = learn.linear(FEATURES, "value").fit(train)
    path = scratch(spark, "model")
    learn.save_model(model, path)
    before = learn.predict(model, validation, "before")
    both = learn.predict(learn.load_model(path), before, "after")
    return both.select("station", "at", "step", (F.col("before") == F.col("after")).alias("same"))


@query(
    "static_encoding",
    "SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS station_code, "
    + ", ".join(f"(event_type = '{n}')::INTEGER AS is_{n}" for n in sorted(s.STATIONS))
    + " FROM events",
)
def static_encoding(spark, folder):
    """Station as code and as indicators, encoded by a model fitted once."""
    from tarmac.sources.tables import table

    rows = table(spark, folder, "events").select("event_id", F.col("event_type").alias("station"))
    encoded = learn.encode_static(learn.static_encoder("station", "hot").fit(rows), rows, "station", "hot")
    flags = [F.get("hot", F.lit(i)).cast("int").alias(f"is_{n}") for i, n in enumerate(sorted(s.STATIONS))]
    return encoded.select("event_id", "station_code", *flags)
