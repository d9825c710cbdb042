"""Language identification by rank-order profiles of letter n-grams.

A profile is the list of the most frequent 1- to 3-grams of a language, most frequent
first. A document's own list is compared to each profile: an n-gram costs the difference
of its two ranks, or ``top`` where the profile lacks it. The language with the lowest
cost per n-gram wins; equal costs go to the language that sorts first.

Texts are lower-cased, everything but letters becomes a blank, and words keep one blank on
each side. Whole texts are read at any length.

Learning reads at most ``max_docs`` documents of each language (those whose hashed ids
come first), which bounds the cost of learning at any size of corpus; prediction covers
every row. A profile table has ``top`` rows per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.ranking import top_per_key
from .slices import in_slices

TOP = 300
MAX_DOCS = 2_000
UNKNOWN = "und"
_BLANK = np.uint32(32)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, count=0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (21 bits a character) in ascending order, with their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    chars = np.concatenate([[_BLANK], np.where(letter, points, _BLANK), [_BLANK]])
    blank = chars == _BLANK
    chars = chars[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint64)
    blank = chars == _BLANK
    one = chars << np.uint64(42)
    two = one[:-1] | chars[1:] << np.uint64(21)
    three = two[:-1] | chars[2:]
    return np.unique(np.concatenate([one[~blank], two, three[~blank[1:-1]]]), return_counts=True)


def ranked(text: str | None, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first, ties by code point."""
    grams, counts = gram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:top]]


def learn(docs: DataFrame, top: int = TOP, max_docs: int = MAX_DOCS) -> dict[str, list[int]]:
    """Profiles from ``docs(doc_id, text, lang)``; rows with a null in any of them teach nothing.

    Rows that share a doc_id count once each. An empty table gives no profiles. The result
    has ``top`` numbers per language.
    """
    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    ids = top_per_key(rows.select("doc_id", "lang"), ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], max_docs, "doc_id")
    chosen = rows.join(ids.distinct(), ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(gram_counts(text))
            for lang, parts in by_lang.items():
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(grams), pa.string()),
                    "gram": pa.array(grams.astype(np.int64)), "n": pa.array(sums)})

    counts = (chosen.mapInArrow(count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = top_per_key(counts, ["lang"], [F.desc("n"), F.col("gram")], top, "gram", "place")
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in best.select("lang", "place", "gram").collect():  # top rows per language
        profiles.setdefault(row["lang"], []).append((row["place"], row["gram"]))
    return {lang: [gram for _, gram in sorted(places)] for lang, places in sorted(profiles.items())}


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row of ``docs``, replacing columns of those names.

    The score is 1 at no cost and 0 where no n-gram is in the profile. A null text, one
    without a letter, and any text when there are no profiles get ``und`` with score 0.
    """
    tables = []
    for lang, grams in sorted(profiles.items()):
        known = np.array(grams, np.uint64)
        order = np.argsort(known)
        tables.append((lang, known[order], order))
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def judge(text: str | None) -> tuple[str, float]:
        own = ranked(text, top)
        if not len(own) or not tables:
            return UNKNOWN, 0.0
        place = np.arange(len(own))
        costs = []
        for lang, known, rank in tables:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            costs.append(int(np.where(known[at] == own, np.minimum(np.abs(rank[at] - place), top), top).sum()))
        best = int(np.argmin(costs))
        return tables[best][0], 1.0 - costs[best] / (top * len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=[*(f.name for f in kept), "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, f"{fields}, lang_pred string, score double")
