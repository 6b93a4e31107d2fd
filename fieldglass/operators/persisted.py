"""A fitted screen and model as Spark ML transformers: written with their fingerprint, verified and read back, scored in the JVM."""

from __future__ import annotations

import hashlib
import json

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.store import Files, write_json


class Screened(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``out``: the kept features as an array of doubles, unknown ones as 0. All features must be there, none infinite.

    ``statuses`` tells for every feature how the training screen judged it."""

    features = Param(Params._dummy(), "features", "features of the training matrix, in order", TypeConverters.toListString)
    statuses = Param(Params._dummy(), "statuses", "status of each feature", TypeConverters.toListString)
    out = Param(Params._dummy(), "out", "name of the array", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, features=(), statuses=(), out="screened"):
        super().__init__()
        self._setDefault(features=[], statuses=[], out="screened")
        self._set(features=list(features), statuses=list(statuses), out=out)

    def kept(self) -> list[str]:
        return [f for f, s in zip(self.getOrDefault("features"), self.getOrDefault("statuses"), strict=True) if s == "retained"]

    def _transform(self, df: DataFrame) -> DataFrame:
        features = self.getOrDefault("features")
        if missing := [f for f in features if f not in df.columns]:
            raise ValueError(f"features are missing: {missing}")
        x = {f: F.col(f).cast("double") for f in features}
        endless = [F.abs(c) == float("inf") for c in x.values()]
        known = F.array(*[F.coalesce(F.nanvl(x[f], F.lit(0.0)), F.lit(0.0)) for f in self.kept()]).cast("array<double>")
        bad = endless[0]
        for e in endless[1:]:
            bad = bad | e
        return df.withColumn(self.getOrDefault("out"), F.when(F.coalesce(bad, F.lit(False)), F.raise_error("a feature is infinite").cast("array<double>")).otherwise(known))


class Logistic(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``p``, the sigmoid of the weighted sum of the array ``source``, which it drops."""

    weights = Param(Params._dummy(), "weights", "weight of each kept feature", TypeConverters.toListFloat)
    source = Param(Params._dummy(), "source", "name of the array", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, weights=(), source="screened"):
        super().__init__()
        self._setDefault(weights=[], source="screened")
        self._set(weights=[float(w) for w in weights], source=source)

    def _transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(x) for x in self.getOrDefault("weights")]).cast("array<double>")
        z = F.aggregate(F.zip_with(self.getOrDefault("source"), w, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
        return df.withColumn("p", 1 / (1 + F.exp(-z))).drop(self.getOrDefault("source"))


def fitted_model(features: list[str], statuses: list[str], weights) -> PipelineModel:
    """``weights``: one a feature; those of features that aren't retained don't count."""
    kept = [w for w, s in zip(weights, statuses, strict=True) if s == "retained"]
    return PipelineModel([Screened(features=features, statuses=statuses), Logistic(weights=kept)])


def _content(spark: SparkSession, path: str) -> str:
    """Digest of all files below a folder by name and bytes, but for markers and checksums."""
    files, h = Files(spark), hashlib.sha256()
    for name in files.below(path):
        short = name.rsplit("/", 1)[-1]
        if not short.startswith((".", "_")) and short != "fingerprint.json":
            h.update(json.dumps([name, hashlib.sha256(files.read(f"{path}/{name}")).hexdigest()]).encode())
    return h.hexdigest()


def save_model(spark: SparkSession, model: PipelineModel, path: str) -> str:
    """Write a model once; its fingerprint is written last, so a folder without one isn't a model."""
    model.write().save(path)
    key = _content(spark, path)
    write_json(spark, f"{path}/fingerprint.json", {"sha256": key})
    return key


def load_model(spark: SparkSession, path: str, expected: str | None = None) -> PipelineModel:
    """The model of a folder whose files are what its fingerprint, and the one that is expected, say."""
    files = Files(spark)
    if not files.exists(f"{path}/fingerprint.json"):
        raise FileNotFoundError(f"{path} holds no finished model")
    key = json.loads(files.read(f"{path}/fingerprint.json"))["sha256"]
    if key != _content(spark, path) or (expected is not None and key != expected):
        raise ValueError(f"{path} holds other bytes than its fingerprint says")
    return PipelineModel.load(path)
