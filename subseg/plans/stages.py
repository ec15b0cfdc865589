"""The segmenter as a ``pyspark.ml`` stage: fits, saves and loads inside a ``Pipeline``."""

from __future__ import annotations

import os

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from ..config import GBTParams, SegConfig
from .segmenter import SegmenterModel, Tags, TrainReport, train


class _SegmenterParams(Params):
    keyCols = Param(Params._dummy(), "keyCols", "columns that name a word", TypeConverters.toListString)
    sep = Param(Params._dummy(), "sep", "separator of segments", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(keyCols=["doc_id", "pos"], sep="|")


class Segmenter(Estimator, _SegmenterParams):
    """Learns boundaries from rows ``(*keyCols, word, prev_word, next_word, seg[, tag])``; ``options`` are those of ``train``."""

    def __init__(self, cfg: SegConfig, lex_tags: DataFrame, freqs: DataFrame | None = None, keyCols: list[str] | None = None,
                 sep: str = "|", params: GBTParams | None = None, tags: Tags | None = None, **options):
        super().__init__()
        self.cfg, self.lex_tags, self.freqs, self.options = cfg, lex_tags, freqs, {"params": params, "tags": tags, **options}
        self._set(sep=sep, **({"keyCols": keyCols} if keyCols else {}))

    def _fit(self, dataset: DataFrame) -> "SegmenterStage":
        model, report = train(dataset, self.getOrDefault("keyCols"), self.cfg, self.lex_tags, self.freqs, **self.options)
        stage = SegmenterStage(model, report)
        stage._resetUid(self.uid)
        return self._copyValues(stage)


class SegmenterStage(Model, _SegmenterParams, MLWritable, MLReadable):
    """Adds ``seg`` and ``min_boundary_p`` to rows ``(*keyCols, word, prev_word, next_word[, tag])``; other columns stay."""

    def __init__(self, model: SegmenterModel, report: TrainReport | None = None):
        super().__init__()
        self.model, self.report = model, report

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keys = self.getOrDefault("keyCols")
        found = self.model.segment(dataset, keys, self.getOrDefault("sep"))
        return dataset.drop("seg", "min_boundary_p").join(found.drop("word"), keys)

    def write(self) -> "_Writer":
        return _Writer(self)

    @classmethod
    def read(cls) -> "_Reader":
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: SegmenterStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.model.save(os.path.join(path, "model"))


class _Reader(MLReader):
    def load(self, path: str) -> SegmenterStage:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        stage = SegmenterStage(SegmenterModel.load(spark, os.path.join(path, "model")))
        stage._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(stage, meta)
        return stage
