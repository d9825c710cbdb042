"""Near-duplicate documents by circulant MinHash, linked on their full shingle sets.

Two fixed permutations of a universe of 2^20 numbers make the whole signature: the first
shuffles a document's shingles, the second, shifted round by one place per coordinate,
gives all coordinates as minima. Coordinates are cut into bands; documents that share a
band are candidates, and every link is confirmed by the exact Jaccard similarity of the
full sets of 64-bit shingle hashes. With 40 bands of 6, a pair at similarity 0.8 is missed
with a probability of about 5e-6, a closer one less often.

Large groups. Documents with equal sets are one class from the start (128-bit digest), so
copies are never paired. Inside a band's group no pairs are made up front: its members are
compared to a hub and links are contracted to components; then, in a few rounds, those
outside the group's main component are compared to some more of its members. What is still
in different components of one group after that is compared pair by pair, but only pairs
that can reach the threshold: two sets whose sizes ask for an overlap of k share one of
their rarest size - k + 1 shingles (prefix filtering, exact under any one order of
shingles). The result does not
depend on which hubs were taken, as no pair of a group that could join two components goes
untested.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.bounded import small_side
from ..plans.storage import stage
from .components import components
from .words import mix, rolling, word_hashes

WORDS = 5
THRESHOLD = (80, 100)
BANDS, ROWS = 40, 6
UNIVERSE = 1 << 20
#: Hubs per group in each round before the remaining pairs are compared.
HUBS = (1, 4)
#: Shingles are ordered by how often their slot of this many is met: a fixed 1 MB on every machine.
SLOTS = 1 << 18
#: Ids and pairs of ids go to all tasks in place of shuffled sets, as long as there are no more than these.
MAX_IDS = 1_000_000


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    return first, np.concatenate([second, second[:BANDS * ROWS]])


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes; fewer words than ``words`` make one shingle, none make none."""
    lowered = [None if t is None else t.lower() for t in texts.cast(pa.binary()).to_pylist()]  # A-Z only, as these are bytes
    return [np.unique(rolling(h, min(words, len(h)))) if len(h) else h for h in word_hashes(lowered)]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of band keys per non-empty set."""
    first, second = _permutations()
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    places = first[(np.concatenate(sets) & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), np.uint64(band + 1), np.uint64)
        for row in range(ROWS):
            least = np.minimum.reduceat(second[band * ROWS + row:].take(places), starts)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64))
        keys[:, band] = key
    return keys


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row per row of ``docs(doc_id, text)``.

    Words are lower-cased in A-Z only. Documents link when intersection/union of their
    sets of ``words``-word shingles is at least ``threshold``. ``component_id`` is the
    smallest doc_id reachable over links; ``kept`` marks that document. A null, empty or
    blank text has no shingles and links with nothing. Rows that share a doc_id each get the
    smallest component that any of their texts is in. A row without doc_id is linked with
    nothing, has no component and is kept. Extra columns are not returned.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(rows.mapInArrow(_signer(words), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signatures")
    classes = (signed.where("digest is not null and doc_id is not null").groupBy("digest")
               .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    classes = stage(classes, "classes")
    links = _linked(rows, classes, words, threshold)
    joined = (signed.join(classes.select("digest", "rep"), "digest", "left")
              .join(links.select(F.col("id").alias("rep"), "component"), "rep", "left"))
    found = joined.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    # Rows that share a doc_id may sit in several classes; the smallest id counts for all of them.
    best = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = found.drop("component_id").join(best, "doc_id", "left")
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document is the kept one of its component, all columns.

    Of equal rows of one doc_id one stays; rows that share a doc_id but differ all stay, as
    do rows without doc_id.
    """
    gone = near_duplicates(docs, words, threshold).where("not kept").select("doc_id").distinct()
    shared = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared")
    if shared.isEmpty():
        return docs.join(gone, "doc_id", "left_anti")
    kept = docs.join(stage(gone, "gone"), "doc_id", "left_anti")
    return kept.join(shared, "doc_id", "left_anti").union(kept.join(shared, "doc_id", "left_semi").dropDuplicates())


def _signer(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column("text"), words)
                filled = [s for s in sets if len(s)]
                keys = iter(band_keys(filled).astype(np.int64).tolist() if filled else [])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands"])
    return run


def _linked(rows: DataFrame, classes: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """``(id, component)`` of the classes that link with another one."""
    # Most bands are met once. Only the band and its count are shuffled to tell, once, and what
    # names a group's members is worked out for the bands that are left.
    rows_of = classes.select("rep", F.explode("bands").alias("band"))
    repeated = stage(rows_of.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band"), "repeated")
    met = stage(rows_of.join(small_side(repeated), "band"), "met")
    print_of = F.xxhash64("rep")
    groups = met.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.sum(print_of.cast("decimal(38,0)")).alias("s"),
                                     F.bit_xor(print_of).alias("x"))
    # Bands that gather the same documents are one group.
    groups = groups.groupBy("m", "s", "x").agg(F.min("band").alias("band")).select("band")
    members = stage(met.join(small_side(groups), "band").join(classes.select("rep", "n"), "rep"), "members")
    # Texts move only if the documents in question are too many to send their ids instead.
    wanted = small_side(members.select(F.col("rep").alias("doc_id")).distinct())
    sets = stage(rows.join(wanted, "doc_id", "left_semi").mapInArrow(_setter(words), "doc_id long, items binary"), "sets")
    labels = members.select("rep").distinct().withColumn("component", F.col("rep"))
    tested = None
    for turn in range(len(HUBS) + 1):
        members = members.drop("component").join(labels, "rep")
        parts = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"))
        main = parts.groupBy("band").agg(F.max(F.struct("m", (-F.col("component")).alias("c"))).alias("main"), F.count(F.lit(1)).alias("parts"))
        # Groups that are one component are done with.
        members = stage(members.join(main.where("parts > 1").select("band", (-F.col("main.c")).alias("main")), "band"), "members")
        if members.isEmpty():
            break
        pairs = _star(members, turn, HUBS[turn], threshold) if turn < len(HUBS) else _rest(members, sets, threshold)
        members = members.drop("main")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        links = stage(_confirmed(pairs, sets, threshold), "confirmed")
        labels = stage(_relabelled(labels, links), "labels")
        done = pairs.select("a", "b")
        tested = done if tested is None else tested.union(done)
    return labels.withColumnRenamed("rep", "id")


def _sizes_allow(n: Column, m: Column, threshold: tuple[int, int]) -> Column:
    return F.least(n, m) * threshold[1] >= F.greatest(n, m) * threshold[0]


def _star(members: DataFrame, turn: int, hubs: int, threshold: tuple[int, int]) -> DataFrame:
    """Members outside a group's main component against up to ``hubs`` drawn from inside."""
    drawn = F.xxhash64(F.lit(turn), "rep")
    heart = (members.where("component = main").groupBy("band", F.pmod(drawn, F.lit(hubs)).alias("slot"))
             .agg(F.min(F.struct(drawn.alias("o"), "rep", "n")).alias("h")).select("band", "h"))
    star = members.where("component != main").join(heart, "band").where(_sizes_allow(F.col("n"), F.col("h.n"), threshold))
    return star.select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b")).distinct()


def _rest(members: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs of unlike components that share a rare shingle and have sizes that allow a link."""
    # Any one order of shingles will do, so they are counted over all sets, which stay where they are.
    left = small_side(members.select("rep", "component").distinct(), max_rows=MAX_IDS)
    full = sets.join(left, F.col("doc_id") == F.col("rep")).select("rep", "component", "items")
    counts = sets.select("items").mapInArrow(_slot_counts, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    often = np.zeros(SLOTS, np.int32)
    often[counts["slot"].to_numpy()] = np.minimum(counts["n"].to_numpy(), np.iinfo(np.int32).max)
    shared = members.sparkSession.sparkContext.broadcast(often)
    rare = stage(full.mapInArrow(_rarest(shared, threshold), "rep long, n long, component long, shingle long, place long"), "rare")
    shared.unpersist()
    parts = rare.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("m"))
    main = (parts.groupBy("shingle").agg(F.max(F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
            .where("parts > 1").select("shingle", F.col("main.component").alias("main")))
    placed = rare.join(main, "shingle")
    one = placed.where("component != main").select("shingle", F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("component").alias("xc"),
                                                       F.col("place").alias("xplace"))
    overlap = F.ceil((F.col("n") + F.col("xn")) * threshold[0] / (threshold[0] + threshold[1]) - 1e-9)
    pairs = placed.join(one, "shingle").where("component != xc").where(
        (F.col("place") <= F.col("n") - overlap) & (F.col("xplace") <= F.col("xn") - overlap))
    return pairs.select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct()


def _slots(items: np.ndarray) -> np.ndarray:
    return (mix(items) & np.uint64(SLOTS - 1)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for items in batch.column("items").to_pylist():
            total[_slots(np.frombuffer(items, np.uint64))] += 1
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(met.astype(np.int32)), "n": pa.array(total[met].astype(np.int32))})


def _rarest(shared, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            reps, ns, components_, shingles, places = [], [], [], [], []
            for rep, component, items in zip(*(batch.column(c).to_pylist() for c in ("rep", "component", "items"))):
                own = np.frombuffer(items, np.uint64)
                count = often[_slots(own)]
                first = np.lexsort((own, count))[:len(own) - -(-len(own) * threshold[0] // threshold[1]) + 1]
                place = np.flatnonzero(count[first] > 1)  # what is met once is in no other set
                first = first[place]
                reps.append(np.full(len(first), rep))
                ns.append(np.full(len(first), len(own)))
                components_.append(np.full(len(first), component))
                shingles.append(own[first].view(np.int64))
                places.append(place)
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (reps, ns, components_, shingles, places)],
                                                 names=["rep", "n", "component", "shingle", "place"])
    return run


def _setter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"),
                    pa.array([s.tobytes() for s in shingle_sets(part.column("text"), words)], pa.binary())],
                    names=["doc_id", "items"])
    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if not len(p) or not len(q):
                    continue
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                shared = int((p[at] == q).sum())
                if shared * threshold[1] >= (len(p) + len(q) - shared) * threshold[0]:
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    # Sets in no pair are left where they are.
    second = small_side(pairs.select("b").distinct(), max_rows=MAX_IDS)
    full = (small_side(pairs.select("a", "b"), max_rows=MAX_IDS).join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")).join(second, "b", "left_semi"), "b"))
    return full.mapInArrow(run, "u long, v long")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components joined by the new links, named after their smallest member."""
    of = lambda name: labels.select(F.col("rep").alias(name), F.col("component").alias(f"c{name}"))
    between = links.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
    merged = components(between).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return labels.join(merged, "component", "left").select("rep", F.coalesce("to", "component").alias("component"))
