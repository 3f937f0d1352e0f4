"""A scorer saved as one pipeline."""

import pytest

from driftline.operators import pipelines


def test_a_saved_scorer_scores_alike_and_refuses_other_channels(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, int(i % 2 == 0 and t > 5), (0.3 + 0.5 * (i % 2 == 0 and t > 5) + 0.01 * ((i * 7 + t) % 13)), 0.5) for i in range(30) for t in range(12)], "id long, step long, target int, good double, flat double")
    names = ["good", "flat"]
    made = pipelines.fitted(rows, names)
    pipelines.saved(rows, names, f"{tmp_path}/m")
    key = lambda df: sorted((r["id"], r["step"], r["target"], r["score"]) for r in df.collect())
    again = pipelines.scored(rows.select("flat", "id", "good", "step", "target"), f"{tmp_path}/m")
    assert again.columns == ["id", "step", "target", "score"] and key(again) == key(made.transform(rows))
    scores = {y: [s for *_, t, s in key(again) if t == y] for y in (0, 1)}
    assert min(scores[1]) > max(scores[0])
    for other in (rows.drop("flat"), rows.withColumn("more", rows["flat"]), rows.withColumnRenamed("flat", "round")):
        with pytest.raises(ValueError, match="channels where 2 are wanted"):
            pipelines.scored(other, f"{tmp_path}/m")
