"""Queries that fit and predict compute their observations once."""

import pytest
from pyspark.sql import functions as F

from mentora.operators import bkt
from mentora.plans import tracing

SCHEMA = "d bigint, turn int, pos int, kc string, correct int, split string"


def counting(spark, obs):
    """``obs`` with an accumulator of how many of its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return obs.mapInArrow(count, SCHEMA), seen


def observations(spark):
    rows = spark.range(400).select((F.col("id") % 100).alias("d"), (F.col("id") / 100).cast("int").alias("turn"), F.lit(0).alias("pos"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("kc"), (F.crc32(F.col("id").cast("string")) % 2).cast("int").alias("correct"))
    return rows.withColumn("split", F.when(F.col("d") % 5 == 0, "test").otherwise("train"))


@pytest.mark.parametrize("fitter", ["filtered", "em"])
def test_cross_validation(spark, fitter):
    obs, seen = counting(spark, observations(spark))
    fold = lambda name, f: observations(spark).select("d").distinct().where(F.col("d") % 2 == f).select("d", F.lit(f + (name == "test")).alias("fold"), F.lit(name).alias("slice"))
    slices = fold("train", 0).union(fold("train", 1)).union(fold("test", 0)).union(fold("test", 1).withColumn("fold", F.lit(0)))
    got = {(r.fold, r.d, r.turn): r.p for r in bkt.cross_predictions(obs, slices, fitter=fitter).collect()}
    assert seen.value == 400
    # Each fold by itself.
    for f in (0, 1):
        train, test = (observations(spark).where(F.col("d") % 2 == x) for x in (f, 1 - f))
        seqs = bkt.label_sequences(train)
        parameters = bkt.fit(seqs) if fitter == "em" else bkt.fit_filtered(seqs)
        alone = bkt.predict(test, parameters, bkt.weighted_fallback(parameters, bkt.observation_counts(seqs)), margin=0.0 if fitter == "em" else 1e-6).collect()
        assert len(alone) == 200 and all(got[f, r.d, r.turn] == pytest.approx(r.p, abs=1e-12) for r in alone)


def test_estimable_em_split(spark, monkeypatch):
    obs, seen = counting(spark, observations(spark))
    monkeypatch.setattr(tracing, "_obs", lambda *_: obs)
    rows = tracing.TRACING["estimable_em_split"](spark, "").collect()
    assert sum(r.n for r in rows) == 80 and seen.value == 400
