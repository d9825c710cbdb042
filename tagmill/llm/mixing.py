"""Mixing sources to target weights by blocks, shards and index permutations.

Each source's words form one stream in document order, cut into blocks of ``block`` words
(the last may be shorter). The output is a sequence of slots dealt out in shards of
``shard`` slots. Every shard draws how many of its slots each source fills: a multinomial
draw conditional on the sources' totals (a multivariate hypergeometric one), taken by
splitting the shards in halves down to the single shard, so any shard can be drawn on its
own and the totals still come out exactly. Slots are dealt in runs of about ``RUN``: every
run takes its even part of each source, within a slot, and the shards of a run are drawn
from that, so that all draws stay in the range of the exact generator. A source's slots are numbered through all
shards; slot j takes block perm_e(j mod B) of the source's B blocks, where perm_e is the
pseudorandom permutation of pass e = j div B. So every block is used once before any is
used twice. The last slot of a source takes only the words still due. Slots and the
documents' pieces of blocks meet in a join by (source, block).

Everything random is a function of the seed, so reruns and lost tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.storage import stage
from .words import WORD, WORD_SQL, mix

BLOCK = 128
SHARD = 4096
SEED = 7
WEIGHTS = (5.0, 2.0, 1.0)
#: Sources are planned on the driver; more than this many raise an error.
MAX_SOURCES = 100_000
#: Slots of a run; the generator is exact below 10^9.
RUN = 1 << 28


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null; counted as gaps, without making the list."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Words per source: ``total`` shared by weight, none above ``most`` times its size.

    What a source cannot take is shared by weight among those that still can; a total
    above all that can be taken gives every source its most.
    """
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while free and left > 0:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight >= most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                block: int = BLOCK, shard: int = SHARD, seed: int = SEED, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Two tables for ``docs(doc_id, text, source)``.

    *plan*, a row per document: ``doc_id, source, size, source_size, target, taken``.
    *pieces*, a row per piece of a block in a document and per use: ``doc_id, shard, slot,
    source, block, use, start, stop`` with word positions [start, stop) of the document.

    Sources are ordered by code point with null last and weigh ``weights``, repeating.
    Together they take ``share`` of all words; none takes over ``most`` times its own.
    A source's words are its target rounded to a word, at any size of source. A null,
    empty or blank text has size 0 and takes 0. Rows that share a doc_id are one document:
    their texts count as repeats of it, each a row with its own size. A row without doc_id
    mixes like any other but has no pieces to join back to. An empty table gives empty tables.
    """
    plan, pieces = _mix(docs, F.monotonically_increasing_id(), weights, share, most, block, shard, seed, run)
    return plan, pieces.select("doc_id", "shard", "slot", "source", "block", "use", "start", "stop")


def _mix(docs: DataFrame, key: Column, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
         block: int = BLOCK, shard: int = SHARD, seed: int = SEED, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """``mix_sources`` with a key of each row, which the pieces carry as ``key``."""
    rows = docs.select(key.cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
                       F.xxhash64(F.col("text").cast("string")).alias("mark"))
    sized = stage(rows, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    names, words = [r["source"] for r in sources], [int(r["words"]) for r in sources]
    aims = targets(words, [weights[i % len(weights)] for i in range(len(names))], share * sum(words), most)
    blocks = [-(-w // block) for w in words]
    dealt = [_dealt(w, min(round(aim), int(most * w)), block, seed, s) for s, (aim, w) in enumerate(zip(aims, words))]
    slots, cuts = [n for n, _ in dealt], [cut for _, cut in dealt]
    spark = docs.sparkSession
    table = spark.createDataFrame(
        pa.table({"name": pa.array(names, pa.string()), "s": pa.array(range(len(names)), pa.int32()),
                  "source_size": pa.array(words, pa.int64()), "target": pa.array(aims, pa.float64())}),
        "name string, s int, source_size long, target double")
    known = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = stage(_placed(known), "placed")
    pieces = _used(placed.where("size > 0"), blocks, slots, cuts, block, shard, seed, run)
    taken = pieces.groupBy("key").agg(F.sum("words").alias("taken"))
    plan = placed.join(taken, "key", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return plan, pieces


def _dealt(words: int, due: int, block: int, seed: int, s: int) -> tuple[int, int]:
    """(slots, words of the last slot) with which source ``s`` of ``words`` words gives ``due``."""
    if not words:
        return 0, block
    blocks, (full, rest) = -(-words // block), divmod(due, words)
    if not rest:
        return full * blocks, block
    slots, lack = -(-rest // block), blocks * block - words
    # Where this pass has the block that is shorter than the others.
    at = place(blocks - 1, blocks, _pass_key(seed, s, full)) if lack and blocks > 1 else 0
    if lack and at < slots and slots * block - lack < rest:
        slots += 1
    return full * blocks + slots, rest - (slots - 1) * block + (lack if at < slots - 1 else 0)


def _placed(known: DataFrame) -> DataFrame:
    """Each row's first word in its source's stream (``first``).

    A source's documents are ordered by a hash of their ids, which cuts any source, hot or
    not, into even slices; sizes are summed inside a slice and shifted by the slices before.
    """
    slices = 4096
    cut = known.withColumn("h", F.xxhash64("doc_id", "size")).withColumn("slice", F.shiftright("h", 52) + slices // 2)
    sums = cut.groupBy("s", "slice").agg(F.sum("size").alias("words"))
    before = W.partitionBy("s").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = sums.select("s", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("shift"))
    # The key decides between rows of one doc_id with equal texts only, so any partitioning of the input will do.
    run = W.partitionBy("s", "slice").orderBy("h", "doc_id", "size", "mark", "key").rowsBetween(W.unboundedPreceding, 0)
    return (cut.withColumn("in", F.sum("size").over(run) - F.col("size"))
            .join(shifts, ["s", "slice"])
            .select("key", "doc_id", "source", "s", "size", "source_size", "target", (F.col("in") + F.col("shift")).alias("first")))


def _used(placed: DataFrame, blocks: list[int], slots: list[int], cuts: list[int], block: int, shard: int, seed: int,
          run: int) -> DataFrame:
    """The pieces of blocks that the mix takes, a row per use."""
    spark = placed.sparkSession
    runs, shards = plan_runs(sum(slots), len(slots), shard, run)
    drawn = spark.range(0, runs * shards, 1, max(1, min(runs * shards, spark.sparkContext.defaultParallelism * 4, 10_000))).mapInArrow(
        _drawer(blocks, slots, cuts, block, shard, runs, shards, seed), "s int, block long, shard long, slot long, use int, length long")
    last = F.floor((F.col("first") + F.col("size") - 1) / block)
    spans = placed.select("doc_id", "key", "source", "s", "first", "size", F.explode(
        F.sequence(F.floor(F.col("first") / block), last)).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("first"), F.lit(0))
    stop = F.least(F.col("block") * block + F.col("length") - F.col("first"), F.col("size"))
    return (spans.withColumn("start", start).join(drawn.hint("merge"), ["s", "block"])  # no size is known before the draw
            .withColumn("stop", stop).where("stop > start").withColumn("words", F.col("stop") - F.col("start")))


def plan_runs(total: int, sources: int, shard: int, run: int = RUN) -> tuple[int, int]:
    """(runs, shards of a run) for ``total`` slots; a run has a slot a source beyond its even part at most."""
    runs = max(1, -(-total // run))
    return runs, -(-(total if runs == 1 else -(-total // runs) + sources) // shard)


def split(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``take`` slots drawn without replacement fall on each source."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    take = min(take, rest)
    for i, n in enumerate(counts.tolist()):
        rest -= n
        if not take:
            break
        out[i] = got = int(rng.hypergeometric(n, rest, take)) if n and rest else min(n, take)
        take -= got
    return out


def draws(slots: list[int], shard: int, shards: int, number: int, seed: int, runs: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(first slot of each source in the shard, slots of each source in the shard).

    Run r of ``runs``, of ``shards`` shards each, has the slots from n * r // runs up to
    n * (r + 1) // runs of a source with n.
    """
    turn, number = divmod(number, shards)
    first = np.array([n * turn // runs for n in slots], np.int64)
    counts, lo, hi = np.array([n * (turn + 1) // runs for n in slots], np.int64) - first, 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        state = blake2b(f"{seed}:{turn * shards + lo}:{turn * shards + hi}".encode(), digest_size=8).digest()
        left = split(counts, (mid - lo) * shard, np.random.default_rng(int.from_bytes(state, "big")))
        if number < mid:
            counts, hi = left, mid
        else:
            counts, first, lo = counts - left, first + left, mid
    return first, counts


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1: a Feistel network, walked into range."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = value[todo] >> np.uint64(half), value[todo] & mask
        for turn in range(4):
            left, right = right, left ^ _turned(right, key, turn, mask)
        value[todo] = left << np.uint64(half) | right
        todo = todo[value[todo] >= size]
    return value.astype(np.int64)


def _turned(half: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    salt = np.uint64((key * 8 + turn) % (1 << 64))
    return mix(mix(half + salt) + salt) & mask


def place(value: int, size: int, key: int) -> int:
    """The index at which ``permuted`` has a value."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask, at = np.uint64((1 << half) - 1), np.array([value], np.uint64)
    while True:
        left, right = at >> np.uint64(half), at & mask
        for turn in reversed(range(4)):
            left, right = right ^ _turned(left, key, turn, mask), left
        at = left << np.uint64(half) | right
        if at[0] < size:
            return int(at[0])


def _pass_key(seed: int, s: int, use: int) -> int:
    return int.from_bytes(blake2b(f"{seed}:{s}:{use}".encode(), digest_size=7).digest(), "big")


def _drawer(blocks: list[int], slots: list[int], cuts: list[int], length: int, shard: int, runs: int, shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                first, counts = draws(slots, shard, shards, number, seed, runs)
                total = int(counts.sum())
                # The order of the slots inside a shard is a permutation too.
                order = permuted(np.arange(total), total, seed * 1_000_003 + number) if total else np.empty(0, np.int64)
                at = 0
                for s in np.flatnonzero(counts).tolist():
                    j = np.arange(first[s], first[s] + counts[s])
                    use, index = np.divmod(j, blocks[s])
                    block = np.empty_like(index)
                    for e in np.unique(use).tolist():
                        block[use == e] = permuted(index[use == e], blocks[s], _pass_key(seed, s, e))
                    n = len(j)
                    yield pa.RecordBatch.from_pydict({
                        "s": pa.array(np.full(n, s, np.int32)), "block": pa.array(block),
                        "shard": pa.array(np.full(n, number, np.int64)), "slot": pa.array(order[at:at + n]),
                        "use": pa.array(use.astype(np.int32)),
                        "length": pa.array(np.where(j == slots[s] - 1, cuts[s], length))})
                    at += n
    return run


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row with the words the mix takes of it, all its columns.

    A document's pieces follow one another in document order, those of a second use after
    those of the first, each piece as it is written in the text; pieces that do not touch
    are set apart by a line break. Documents of which nothing is taken are left out. Each
    row is a document of its own, with or without a doc_id and also where others have the
    same one: rows get a key, written with them, by which their pieces come back to them.
    ``n_chars``, where there is such a column, is counted anew. Columns may have any names:
    the key and the pieces get names that the table does not have.
    """
    names = {c.lower() for c in docs.columns}
    own_key, own_spans = (next(n for n in (base + "_" * i for i in range(len(names) + 1)) if n not in names) for base in ("_key", "_spans"))
    keyed = stage(docs.withColumn(own_key, F.monotonically_increasing_id()), "keyed")
    _, pieces = _mix(keyed, F.col(own_key), **options)
    spans = pieces.groupBy(F.col("key").alias(own_key)).agg(
        F.sort_array(F.collect_list(F.struct("use", "start", "stop"))).alias(own_spans))
    joined = keyed.join(spans, own_key)
    kept = [f for f in docs.schema.fields]

    def cut(text: str, spans: list[dict]) -> str:
        raw = text.encode("utf-8", "surrogatepass")
        at = [m.span() for m in WORD.finditer(raw)]
        runs: list[list[int]] = []
        for span in spans:
            if runs and runs[-1][0] == span["use"] and runs[-1][2] == span["start"]:
                runs[-1][2] = span["stop"]
            else:
                runs.append([span["use"], span["start"], span["stop"]])
        return b"\n".join(raw[at[a][0]:at[b - 1][1]] for _, a, b in runs if b <= len(at)).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t or "", s) for t, s in zip(batch.column("text").to_pylist(), batch.column(own_spans).to_pylist())]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [new[f.name].cast(batch.column(f.name).type) if f.name in new else batch.column(f.name) for f in kept],
                names=[f.name for f in kept])

    return joined.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))
