"""Exact repeats of word runs across a corpus, by fixed-block anchors.

Reference blocks are the non-overlapping runs of ``width // 2`` words that start at
multiples of that length; any window of ``width`` words holds a whole one. Every rolling
run of the same length probes the blocks. Of two equal windows each meets all blocks of the
other, so only windows whose blocks are all met can repeat; they are extended to their full
length, and a window whose words also start earlier marks its words. Overlapping marked
windows run together to the maximal repeats.

What moves. Probes leave their task in buckets by hash, packed to about six bytes each: 30
bits of the hash inside the bucket (a chance hit costs one more window to extend and
changes no result), the document and the position. Each task first merges its own equal
runs, so a passage that stands in every document is sent once per task and not once per
document. Texts move once, by document; Spark reuses that exchange for both joins. Windows
are compared by 64 bits within buckets that take their numbers from the leading bits of
another hash, about 74 bits with 1,024 buckets: some 0.3 % for one false repeat anywhere
among 10^10 windows that share blocks. Words themselves are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import WORD, rolling, word_hashes

WIDTH = 20
FLUSH_WORDS = 1_500_000
_PROBES = "bucket int, doc long, keys binary, docs binary, places binary"
_PLACES = "_doc long, places binary"
_ANCHOR, _LOCAL, _PRINT = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1)


def pack(values: np.ndarray) -> bytes:
    """Integers as differences, bytes of equal weight together, compressed."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel())


def _buckets(spark: SparkSession) -> int:
    """A power of two, several buckets for each shuffle partition."""
    return 1 << max(10, (int(spark.conf.get("spark.sql.shuffle.partitions")) * 4 - 1).bit_length())


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_words, removed array<struct<start, stop>>, kept)`` per row of ``docs(doc_id, text)``.

    ``removed`` are the word ranges [start, stop) covered by windows of ``width`` words whose
    word sequence also starts earlier: in a smaller doc_id, or earlier in the document.
    Windows are judged on the input. ``kept`` is the text of the other words, joined by one
    space. A null text has no words; texts shorter than ``width`` words keep all. Rows that
    share a doc_id are one document read at the same positions: they do not repeat each
    other, and what one of them repeats goes from each. A row without doc_id neither
    repeats nor is repeated. Extra columns are not returned.
    """
    # Names that the table does not have keep this projection alike in both joins, so its exchange is reused.
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"))
    named, nameless = rows.where("_doc is not null"), rows.where("_doc is null")
    buckets = _buckets(docs.sparkSession)
    probes = named.mapInArrow(_prober(width // 2, width, buckets), _PROBES)
    hits = probes.groupBy("bucket").applyInArrow(_match, _PLACES)
    windows = named.join(_by_doc(hits), "_doc").mapInArrow(_extender(width, buckets), _PROBES)
    later = windows.groupBy("bucket").applyInArrow(_earliest, _PLACES)
    judged = named.join(_by_doc(later), "_doc", "left").unionByName(
        nameless.withColumn("found", F.lit(None).cast("array<binary>")))
    return judged.mapInArrow(_remover(width), "doc_id long, n_words long, removed array<struct<start:int,stop:int>>, kept string")


def _by_doc(places: DataFrame) -> DataFrame:
    """At most one packed list per bucket for a document, whatever its length."""
    return places.groupBy("_doc").agg(F.collect_list("places").alias("found"))


def _texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, list | None]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = part.column("found").to_pylist() if "found" in part.schema.names else [None] * part.num_rows
            hashes = word_hashes(part.column("_text").cast(pa.binary()).to_pylist())
            for doc, own, places in zip(part.column("_doc").to_pylist(), hashes, found):
                if len(own) >= width:
                    yield doc, own, places


Row = tuple[int, int | None, bytes, bytes, bytes]


def _batch(rows: Iterator[Row]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "doc", "keys", "docs", "places"])


def _known(docs: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[Row]:
    """Positions this task has decided itself, a row per document; sorted by document and position."""
    cuts = np.flatnonzero(np.diff(docs)) + 1
    for own, at in zip(np.split(docs, cuts), np.split(places, cuts)):
        if len(own):
            yield int(own[0]) % buckets, int(own[0]), b"", b"", pack(at)


def _sent(bucket: np.ndarray, keys: np.ndarray, docs: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[Row]:
    """A row per bucket; keys of any width, in the order of documents and positions."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    keys, docs, places = keys[order], docs[order], places[order]
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[b], edges[b + 1])
        yield b, None, keys[part].tobytes(), pack(docs[part]), pack(places[part])


def _prober(block: int, width: int, buckets: int):
    bits = buckets.bit_length() - 1

    def flush(ids: list[int], keys: list[np.ndarray]) -> Iterator[Row]:
        sizes = [len(k) for k in keys]
        docs, key = np.repeat(np.array(ids, np.int64), sizes), np.concatenate(keys)
        places = np.concatenate([np.arange(n) for n in sizes])
        order = np.argsort(key)  # runs of equal keys need no order inside
        fresh = np.concatenate([[True], np.diff(key[order]) != 0])
        starts = np.flatnonzero(fresh)
        often = np.diff(np.append(starts, len(key))) > 1
        first = order[starts]
        anchor = np.maximum.reduceat((places % block == 0)[order].astype(np.uint8), starts) > 0
        again = np.sort(order[np.repeat(often, np.diff(np.append(starts, len(key))))])
        again = again[places[again] % block == 0]
        by_doc = again[np.lexsort((places[again], docs[again]))]
        yield from _known(docs[by_doc], places[by_doc], buckets)
        line = np.argsort(first)
        first, anchor, often = first[line], anchor[line], often[line]
        mark = (key[first] >> np.uint64(8)).astype(np.uint32) & _PRINT
        mark |= anchor * _ANCHOR | often * _LOCAL
        yield from _sent((key[first] >> np.uint64(64 - bits)).astype(np.int32), mark.astype(np.uint32), docs[first], places[first], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held = [], [], 0
        for doc, hashes, _ in _texts(batches, width):
            ids.append(doc)
            keys.append(rolling(hashes, block))
            held += len(keys[-1])
            if held >= FLUSH_WORDS:
                yield _batch(flush(ids, keys))
                ids, keys, held = [], [], 0
        if ids:
            yield _batch(flush(ids, keys))
    return run


def _replies(docs: np.ndarray, places: np.ndarray, group: pa.Table) -> pa.Table:
    """Positions by document (as 32-bit integers), with those that tasks had decided themselves."""
    done = group.filter(pc.is_valid(group["doc"]))
    known = [unpack(p) for p in done["places"].to_pylist()]
    docs = np.concatenate([docs, np.repeat(done["doc"].to_numpy(), [len(k) for k in known])])
    places = np.concatenate([places, *known]).astype(np.int32)
    order = np.argsort(docs, kind="stable")
    docs, places = docs[order], places[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(docs) != 0])) if len(docs) else np.empty(0, np.int64)
    edges = np.append(starts, len(docs)).astype(np.int32) * 4
    cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(places.tobytes())])
    return pa.table({"_doc": pa.array(docs[starts], pa.int64()), "places": cut})


def _records(group: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sent = group.filter(pc.is_null(group["doc"]))
    empty = [np.empty(0, np.int64)]
    return (np.frombuffer(b"".join(sent["keys"].to_pylist()), kind), np.concatenate([unpack(d) for d in sent["docs"].to_pylist()] or empty),
            np.concatenate([unpack(p) for p in sent["places"].to_pylist()] or empty))


def _places(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.int32).astype(np.int64)


def _order(marks: np.ndarray) -> np.ndarray:
    """Sorts 32-bit marks together with their places, which is faster than an argsort."""
    both = marks.astype(np.uint64) << np.uint64(32) | np.arange(len(marks), dtype=np.uint64)
    both.sort()
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _match(group: pa.Table) -> pa.Table:
    """Blocks that a window of another task meets: their positions."""
    keys, docs, places = _records(group, np.uint32)
    order = _order(keys & _PRINT)
    marks = (keys & _PRINT)[order]
    alone = np.concatenate([[True], np.diff(marks) != 0, [True]]) if len(marks) else np.ones(1, bool)
    hit = order[~(alone[:-1] & alone[1:])]
    hit = hit[(keys[hit] & (_ANCHOR | _LOCAL)) == _ANCHOR]
    return _replies(docs[hit], places[hit], group)


def _extender(width: int, buckets: int):
    block = width // 2
    reach, bits = width - block + 1, buckets.bit_length() - 1

    def flush(ids: list[int], starts: list[np.ndarray], ones: list[np.ndarray], twos: list[np.ndarray]) -> Iterator[Row]:
        docs = np.repeat(np.array(ids, np.int64), [len(s) for s in starts])
        places, one, two = np.concatenate(starts), np.concatenate(ones), np.concatenate(twos)
        order = np.lexsort((places, docs, two, one))
        same = (np.diff(one[order]) == 0) & (np.diff(two[order]) == 0)
        # Equal windows at one position of one doc_id come from rows that share it.
        first = np.concatenate([[True], ~same])
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        later = order[(docs[order] != docs[lead]) | (places[order] != places[lead])]
        later = later[np.lexsort((places[later], docs[later]))]
        yield from _known(docs[later], places[later], buckets)
        send = np.sort(order[first])
        yield from _sent((two[send] >> np.uint64(64 - bits)).astype(np.int32), one[send], docs[send], places[send], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, ones, twos, held = [], [], [], [], 0
        for doc, hashes, found in _texts(batches, width):
            windows = len(hashes) - width + 1
            hit = np.zeros(len(hashes) + 1, np.int64)
            at = _places(found)
            hit[at[at < len(hashes)] + 1] = 1
            # Blocks of each window that no other window meets.
            unmet = np.cumsum(hit == 0) - np.cumsum(np.arange(-1, len(hashes)) % block != 0)
            at = np.flatnonzero(unmet[reach:reach + windows] == unmet[:windows])
            if len(at):
                ids.append(doc)
                starts.append(at)
                ones.append(rolling(hashes, width, 1, at))
                twos.append(rolling(hashes, width, 2, at))
                held += len(at)
            if held >= FLUSH_WORDS:
                yield _batch(flush(ids, starts, ones, twos))
                ids, starts, ones, twos, held = [], [], [], [], 0
        if ids:
            yield _batch(flush(ids, starts, ones, twos))
    return run


def _earliest(group: pa.Table) -> pa.Table:
    """Windows that also start earlier in another task's documents: their positions."""
    keys, docs, places = _records(group, np.uint64)
    order = np.lexsort((places, docs, keys))
    first = np.concatenate([[True], np.diff(keys[order]) != 0]) if len(keys) else np.empty(0, bool)
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(keys) else order
    later = order[(docs[order] != docs[lead]) | (places[order] != places[lead])]
    return _replies(docs[later], places[later], group)


def _remover(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            counts, ranges, kept = [], [], []
            for text, found in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist()):
                words = WORD.findall(text or b"")
                counts.append(len(words))
                if not found or len(words) < width:
                    ranges.append([])
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                    continue
                edge = np.zeros(len(words) + width + 1, np.int64)
                at = _places(found)
                at = at[at <= len(words) - width]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
                gone = np.cumsum(edge)[:len(words)] > 0
                sides = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                ranges.append([{"start": a, "stop": b} for a, b in zip(sides[::2].tolist(), sides[1::2].tolist())])
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(counts, pa.int64()), pa.array(ranges, kinds),
                                              pa.array(kept, pa.string())], names=["doc_id", "n_words", "removed", "kept"])
    return run
