"""Inputs the queries share, built with the library from the given tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from ..operators import evaluate as E, labels as L
from ..plans.bounded import bounded_values
from ..plans.storage import stage
from ..sources import views


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return views.order_cases(spark, folder)


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return views.document_cases(spark, folder)


def settings(all_cases: DataFrame) -> Row:
    return L.auto_settings(all_cases).first()


def kept_vocab(counts: DataFrame, min_samples: int) -> list[str]:
    """The kept tags; a prediction row holds a cell per tag, so they must fit the bound."""
    names = bounded_values(L.kept_tags(counts, min_samples), "tag")
    if names is None:
        raise ValueError("too many tags for one prediction cell per case and tag")
    return names


@dataclass
class Scored:
    """Kept cases with synthetic predictions, written once and read by every step."""

    preds: DataFrame
    settings: Row
    vocab: list[str]
    n: int
    _info: DataFrame | None = None

    def tag_categories(self) -> DataFrame:
        counts = L.tag_counts(L.binarize_labels(self.preds))
        return L.tag_category(counts, self.n, self.settings["rare_freq"])

    def cells(self) -> DataFrame:
        return E.cells_of(self.preds)

    def sweep(self) -> DataFrame:
        return E.threshold_sweep(self.cells())

    def tag_info(self) -> DataFrame:
        if self._info is None:
            self._info = stage(E.tune_thresholds(self.sweep(), self.tag_categories()), "tag-info")
        return self._info

    def judged(self) -> DataFrame:
        return E.judge(self.preds, self.tag_info())

    def judged_cells(self) -> DataFrame:
        return E.judge_cells(self.cells(), self.tag_info())

    def metrics(self) -> DataFrame:
        return E.per_tag_metrics(self.judged_cells())


def scored(spark: SparkSession, folder: str) -> Scored:
    every = stage(cases(spark, folder), "cases")
    chosen = settings(every)
    counts = L.tag_counts(L.binarize_labels(every))
    vocab = kept_vocab(counts, chosen["min_tag_samples"])
    kept = L.drop_rare_tags(every, chosen["min_tag_samples"], counts)
    preds = stage(views.synthetic_predictions(kept, vocab), "preds")
    return Scored(preds, chosen, vocab, preds.count())
