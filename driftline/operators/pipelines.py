"""A scorer as one saved pipeline: channels in, scores out, and no other channels."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.learn import logit

#: Columns that are not channels.
KEYS = ("id", "step", "target", "fold")


class Channels(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Channels as one vector of logits. It holds their names and refuses tables with others, fewer or more."""

    names = Param(Params._dummy(), "names", "channels, in order", TypeConverters.toListString)

    @keyword_only
    def __init__(self, names: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        wanted, got = self.getOrDefault("names"), [c for c in dataset.columns if c not in KEYS]
        if set(got) != set(wanted) or len(got) != len(wanted):
            raise ValueError(f"{len(got)} channels where {len(wanted)} are wanted; other than wanted: {sorted(set(got) ^ set(wanted))[:5]}")
        keys = [c for c in dataset.columns if c in KEYS]
        shown = dataset.select(*keys, *(logit(F.col(c)).alias(c) for c in wanted))
        return VectorAssembler(inputCols=wanted, outputCol="features").transform(shown).select(*keys, "features")


class Scores(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The probability of a break as score, beside the keys."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(*(c for c in dataset.columns if c in KEYS), vector_to_array("probability")[1].alias("score"))


def fitted(rows: DataFrame, names: list[str]) -> PipelineModel:
    """A scorer fitted on (id, step, target, channels), each row alike."""
    learner = LogisticRegression(featuresCol="features", labelCol="target", maxIter=20, regParam=1e-4)
    return Pipeline(stages=[Channels(names=names), learner, Scores()]).fit(rows)


def saved(rows: DataFrame, names: list[str], path: str) -> None:
    fitted(rows, names).write().overwrite().save(path)


def scored(rows: DataFrame, path: str) -> DataFrame:
    """(keys, score) of rows by the scorer saved at path."""
    return PipelineModel.load(path).transform(rows)
