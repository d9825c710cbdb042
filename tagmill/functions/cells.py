"""Cells of whole batches of cases at once: synthetic ones, their decisions, their entropy.

A lambda over the cells of a row is interpreted cell by cell; these expressions take the
arrays of a batch as flat columns instead. Nulls come out as the plain expressions give them.
"""

from __future__ import annotations

import sys
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from .rand import DEFAULT_SEED

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PART = 1 << 19  # cells hashed at a time


def _bounds(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)


def _lists(bounds: np.ndarray, values: pa.Array, empty: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=empty)


def _uniforms(texts: list[bytes]) -> np.ndarray:
    """What ``rand.uniform`` gives for the joined texts."""
    digests = b"".join([md5(t, usedforsecurity=False).digest() for t in texts])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)).astype(np.float64) / float(1 << 52)


def synthetic_cells(key: Column, tags: Column, vocab: list[str], purpose: str = "pred") -> Column:
    """array<struct<tag, y, p>>, a cell per vocabulary tag: y whether ``tags`` has it, p = 0.35 y + 0.65 u(key, tag)."""
    heads, names = f"{DEFAULT_SEED}:{purpose}:".encode(), [t.encode() for t in vocab]

    def some(keys: pa.Array, lists: pa.Array) -> pa.Array:
        n, wide = len(keys), len(names)
        case = np.repeat(np.arange(n), np.diff(_bounds(lists)))
        flat = lists.flatten()
        at = pc.index_in(flat, value_set=pa.array(vocab, pa.string()))
        found = at.is_valid().to_numpy(zero_copy_only=False) & flat.is_valid().to_numpy(zero_copy_only=False)
        y = np.zeros((n, wide), np.int32)
        y[case[found], pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[found]] = 1
        open_ = lists.is_null().to_numpy(zero_copy_only=False)
        open_[case[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        unknown = (open_[:, None] & (y == 0)).ravel()
        starts = [heads if k is None else heads + k.encode() + b":" for k in keys.to_pylist()]
        p = 0.35 * y.ravel() + 0.65 * _uniforms([s + t for s in starts for t in names])
        tag = pa.array(vocab, pa.string()).take(pa.array(np.tile(np.arange(wide), n)))
        cells = pa.StructArray.from_arrays([tag, pa.array(y.ravel(), mask=unknown), pa.array(p, mask=unknown)], ["tag", "y", "p"])
        return _lists(np.arange(n + 1, dtype=np.int32) * wide, cells)

    def every(keys: pa.Array, lists: pa.Array) -> pa.Array:
        step = max(1, _PART // max(1, len(names)))
        return pa.concat_arrays([some(keys.slice(lo, step), lists.slice(lo, step)) for lo in range(0, max(1, len(keys)), step)])

    udf = F.arrow_udf(every, "array<struct<tag:string,y:int,p:double>>")
    return udf(key.cast("string"), tags)


def judged_cells(cells: Column, kinds: dict[str, str], info: pa.Table, threshold: float, category: str, decide: bool = True) -> Column:
    """Cells with threshold, category and (``decide``) the decision; ``info`` (tag, threshold, category) is looked up by tag, else the defaults.

    ``kinds`` gives the types of tag, y and p.
    """
    tags, limits, names = (info.column(c).combine_chunks() for c in ("tag", "threshold", "category"))

    def judge(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        parts = dict(zip([f.name for f in flat.type], flat.flatten()))
        at = pc.index_in(parts["tag"], value_set=tags)
        at = pc.if_else(parts["tag"].is_valid(), at, pa.scalar(None, at.type))
        limit = pc.fill_null(limits.take(at), threshold)
        found = {c: parts[c] for c in ("tag", "y", "p")} | {"threshold": limit, "category": pc.fill_null(names.take(at), category)}
        if decide:
            p = parts["p"].cast(pa.float64())
            found["pred"] = pc.or_(pc.greater_equal(p, limit), pc.is_nan(p)).cast(pa.int32())  # NaN is above all
        return _lists(_bounds(lists), pa.StructArray.from_arrays(list(found.values()), list(found)), lists.is_null())

    own = ",".join(f"{c}:{kinds[c]}" for c in ("tag", "y", "p"))
    return F.arrow_udf(judge, f"array<struct<{own},threshold:double,category:string{',pred:int' if decide else ''}>>")(cells)


def reaches(cells: Column, info: pa.Table, category: str) -> Column:
    """Whether a cell whose tag is of ``category`` in ``info`` (tag, threshold, category) has at least that threshold."""
    tags, limits, names = (info.column(c).combine_chunks() for c in ("tag", "threshold", "category"))

    def some(tag_lists: pa.Array, p_lists: pa.Array) -> pa.Array:
        flat = tag_lists.flatten()
        at = pc.index_in(flat, value_set=tags)
        at = pc.if_else(flat.is_valid(), at, pa.scalar(None, at.type))
        p, limit = p_lists.flatten(), limits.take(at)
        hit = pc.and_(pc.equal(names.take(at), category), pc.or_(pc.greater_equal(p, limit), pc.is_nan(p)))  # NaN is above all
        case = np.repeat(np.arange(len(tag_lists)), np.diff(_bounds(tag_lists)))
        return pa.array(np.bincount(case[pc.fill_null(hit, False).to_numpy(zero_copy_only=False)], minlength=len(tag_lists)) > 0)

    return F.arrow_udf(some, "boolean")(cells["tag"], cells["p"].cast("array<double>"))


def total_entropy(probabilities: Column) -> Column:
    """Sum of the binary entropies of an array of probabilities, each kept 1e-9 from 0 and 1; null if one is null."""
    def total(lists: pa.Array) -> pa.Array:
        bounds, flat = _bounds(lists), lists.flatten()
        none = flat.is_null().to_numpy(zero_copy_only=False)
        p = pc.fill_null(flat, 0.5).to_numpy(zero_copy_only=False)
        p = np.clip(np.where(np.isnan(p), 1.0, p), 1e-9, 1 - 1e-9)
        h = -(p * np.log(p) + (1 - p) * np.log(1 - p))
        case = np.repeat(np.arange(len(lists)), np.diff(bounds))
        gone = lists.is_null().to_numpy(zero_copy_only=False)
        gone[case[none]] = True
        return pa.array(np.bincount(case, h, len(lists)), mask=gone)

    return F.arrow_udf(total, "double")(probabilities.cast("array<double>"))
