"""Which tokens of two tokenizers cover the same bytes of a text.

Both token sequences of a text are sparse matrices, a row per token and a column per byte,
kept in CSR form by hand. The product of the one with the transpose of the other, taken row
by row (Gustavson), has an entry for each pair of tokens that share bytes, and its value is
how many: these are the overlap links. Bytes at which tokens of both end cut the text into
groups; token-group matrices multiply in the same way into the shared-group links, all
pairs of tokens in one group. Those may be many more than tokens (the product of the two
counts in each group), so the sizes of the rows of that product, its symbolic half, tell
their number, and the links themselves are made in blocks of rows by who asks for them.

The first tokenizer (byte-level BPE, the "A" side) is given a blank and the text, the second
(SentencePiece BPE, the "B" side) the text, before which it puts a blank itself. A single
blank between two other characters ends a token of both, whatever stands around it, so a
long text is cut at such blanks and its parts are encoded on their own, without the blank,
which both put back. A stretch without one is encoded by the tree of ``bpe`` and the table
of ``pieces``. For the same reason the tokens of a part are those of its units, the stretches
between such blanks, one after the other, and a unit that was met lately is not encoded again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from ..plans.storage import stage
from .bpe import tree_encode
from .pieces import BLANK, pieces

CUT = 1 << 15
BLOCK = 1 << 19
SLICE = 128
HOT_PAIRS = 1 << 18
LEAF = 4096
#: Units of so many characters are kept by a worker.
UNIT_CHARS = 1 << 22
_SINGLE_BLANK = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")  # what the second tokenizer takes for a blank is none of the others
_PLAIN = re.compile(r"[^\s\u2581](?s:.*[^\s\u2581])?")
PAIRS = "array<struct<a:int,b:int,n:int>>"
FACTS = f"n_a long, n_b long, n_groups long, n_links long, n_shared long, groups string, pairs {PAIRS}"


class Csr(NamedTuple):
    """Row ``i`` has ``weights`` in ``columns[starts[i]:starts[i + 1]]``; columns ascend within a row."""
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    width: int


def incidence(sizes: np.ndarray) -> Csr:
    """Rows of ``sizes[i]`` ones each, in columns that follow one another."""
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    total = int(starts[-1])
    return Csr(starts, np.arange(total, dtype=np.int32), np.ones(total, np.int32), total)


def membership(group: np.ndarray, groups: int) -> Csr:
    """A one per row, in the column of its group."""
    return Csr(np.arange(len(group) + 1), group.astype(np.int32), np.ones(len(group), np.int32), groups)


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.starts) - 1, dtype=np.int32), np.diff(m.starts))
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    if len(m.columns) and (np.diff(m.columns) < 0).any():
        order = np.argsort(m.columns, kind="stable")
        return Csr(starts, rows[order], m.weights[order], len(m.starts) - 1)
    return Csr(starts, rows, m.weights, len(m.starts) - 1)


def row_products(a: Csr, b: Csr) -> np.ndarray:
    """The symbolic half of Gustavson's product: how many terms each row of ``a @ b`` has."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.columns])])
    return terms[a.starts[1:]] - terms[a.starts[:-1]]


def product(a: Csr, b: Csr, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of rows ``first`` to ``last`` of ``a @ b``, in order.

    A row of the product is the sum of the rows of ``b`` that the row of ``a`` names.
    """
    last = len(a.starts) - 1 if last is None else last
    low, high = a.starts[first], a.starts[last]
    named, weights = a.columns[low:high], a.weights[low:high]
    many = np.diff(b.starts)[named]
    rows = np.repeat(np.repeat(np.arange(first, last, dtype=np.int32), np.diff(a.starts[first:last + 1])), many)
    ends = np.cumsum(many)
    places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(b.starts[named] - (ends - many), many)
    columns, values = b.columns[places], np.repeat(weights, many) * b.weights[places]
    new = (np.diff(rows, prepend=-1) != 0) | (np.diff(columns, prepend=-1) != 0)
    if (np.diff(columns)[np.diff(rows) == 0] < 0).any():
        order = np.lexsort((columns, rows))
        rows, columns, values = rows[order], columns[order], values[order]
        new = (np.diff(rows, prepend=-1) != 0) | (np.diff(columns, prepend=-1) != 0)
    at = np.flatnonzero(new)
    return rows[at], columns[at], np.add.reduceat(values, at) if len(at) else values


def row_blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` terms each, one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        stop = max(stop, at + 1)
        yield at, stop
        at = stop


class Block(NamedTuple):
    """Tokens of some parts of texts, one text after the other; ``doc_*`` are places in the batch."""
    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    bytes_a: Csr
    bytes_b: Csr
    groups_a: Csr
    groups_b: Csr


class Aligner:
    """Both tokenizers and the bytes of their tokens; one per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.path_b = path_b
        self.names_a = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        # Bytes that print stand for themselves in byte-level tokens, the others are counted up from 256.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [i for i in range(256) if i not in set(shown)]
        byte = {chr(i): i for i in shown} | {chr(256 + n): i for n, i in enumerate(hidden)}
        self.bytes_a = [bytes(byte.get(c, 0) for c in name) for name in self.names_a]
        self.bytes_b = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(BLANK, " ").encode()
                        for i, name in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        top = max(len(self.bytes_a), len(self.bytes_b))
        self.top = top
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(top)]
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}
        self.chars = 0
        self.odd_unit = np.empty(0, bool)
        # Of each side: the tokens of all units one after the other, where each unit's start and how many they are.
        self.tokens = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in "ab"]

    def _learn(self, new: list[str]) -> None:
        """Encode units and keep their tokens."""
        joined: list[list[str]] = [[]]
        alone, size = [], 0
        for unit in new:
            if len(unit) > CUT or not _PLAIN.fullmatch(unit):
                alone.append(unit)
                continue
            if size > CUT:
                joined.append([])
                size = 0
            joined[-1].append(unit)
            size += len(unit) + 1
        units, sides = [], ([], [])
        texts = [" ".join(some) for some in joined if some]
        for some, text, a, b in zip((x for x in joined if x), texts, self.encode_a(texts), self.encode_b(texts)):
            expected = (" " + text).encode()
            ends = np.cumsum([len(u.encode()) + 1 for u in some])
            found = []
            for ids, table, sizes in ((a, self.bytes_a, self.size_a), (b, self.bytes_b, self.size_b)):
                if b"".join([table[i] for i in ids]) == expected:
                    ids = np.array(ids, np.int32)
                    at = np.cumsum(sizes[ids])
                    cut = np.searchsorted(at, ends)
                    if np.array_equal(at[cut], ends):
                        found.append((ids, np.diff(cut + 1, prepend=0)))
            if len(found) < 2:
                alone += some
                continue
            units += some
            for side, one in zip(sides, found):
                side.append(one)
        odd = np.zeros(len(units) + len(alone), bool)
        if alone:
            for n, (unit, a, b) in enumerate(zip(alone, self.encode_a(alone), self.encode_b(alone)), len(units)):
                expected = (" " + unit).encode()
                odd[n] = not b"".join([self.bytes_a[i] for i in a]) == expected == b"".join([self.bytes_b[i] for i in b])
                for side, ids in zip(sides, (a, b)):
                    side.append((np.array(ids, np.int32), np.array([len(ids)])))
        units += alone
        self.odd_unit = np.concatenate([self.odd_unit, odd])
        for n, side in enumerate(sides):
            flat, starts, counts = self.tokens[n]
            more = np.concatenate([c for _, c in side])
            self.tokens[n] = (np.concatenate([flat, *(ids for ids, _ in side)]),
                              np.concatenate([starts, len(flat) + np.cumsum(more) - more]), np.concatenate([counts, more]))
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units))))
        self.chars += sum(map(len, units))

    def _numbers(self, parts: list[str]) -> list[np.ndarray]:
        """The numbers of each part's units."""
        if self.chars > UNIT_CHARS:
            self._forget()
        cut = [_SINGLE_BLANK.split(part) for part in parts]
        new = dict.fromkeys(unit for some in cut for unit in some if unit not in self.units)
        if new:
            self._learn(list(new))
        return [np.fromiter(map(self.units.__getitem__, some), np.int64, len(some)) for some in cut]

    def encode_a(self, parts: list[str]) -> list[list[int]]:
        short = [" " + p for p in parts if len(p) <= 4 * CUT]
        found = iter(self.a.encode_batch_fast(short, add_special_tokens=False))
        return [next(found).ids if len(p) <= 4 * CUT else self._tree(" " + p) for p in parts]

    def _tree(self, text: str) -> list[int]:
        model = self.a.model
        ids = lambda piece: [t.id for t in model.tokenize(piece)]
        return [i for piece, _ in self.a.pre_tokenizer.pre_tokenize_str(text) for i in tree_encode(piece, ids, ids, self.names_a, LEAF)]

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        found = iter(self.b.encode([p for p in parts if len(p) <= 4 * CUT], num_threads=1))
        return [next(found) if len(p) <= 4 * CUT else np.frombuffer(pieces(self.path_b).encode([p], ends=False)[0], "<u4").tolist()
                for p in parts]

    def blocks(self, texts: list[str | None], odd: set[int]) -> Iterator[Block]:
        """The tokens of all texts; puts those whose bytes differ from their tokens' into ``odd``."""
        held: list[tuple[int, str]] = []
        size = 0
        for at, text in enumerate(texts):
            for part in parts_of(text or ""):
                held.append((at, part))
                size += len(part)
                if size >= BLOCK:
                    yield from self._block(held, odd)
                    held, size = [], 0
        if held:
            yield from self._block(held, odd)

    def _block(self, held: list[tuple[int, str]], odd: set[int]) -> Iterator[Block]:
        good, units = [], []
        for (at, _), numbers in zip(held, self._numbers([p for _, p in held])):
            if self.odd_unit[numbers].any():
                odd.add(at)
            else:
                good.append(at)
                units.append(numbers)
        if not units:
            return
        docs = np.repeat(np.array(good, np.int64), [len(u) for u in units])
        number = np.concatenate(units)
        sides = []
        for (tokens, starts, counts), sizes in zip(self.tokens, (self.size_a, self.size_b)):
            many = counts[number]
            ends = np.cumsum(many)
            flat = tokens[np.arange(ends[-1]) + np.repeat(starts[number] - (ends - many), many)]
            sides.append((flat, np.repeat(docs, many), incidence(sizes[flat])))
        (a, doc_a, bytes_a), (b, doc_b, bytes_b) = sides
        if not len(a):
            return
        ends_a, ends_b = bytes_a.starts[1:], bytes_b.starts[1:]
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        yield Block(a, b, doc_a, doc_b, bytes_a, bytes_b, membership(np.searchsorted(both, ends_a), len(both)),
                    membership(np.searchsorted(both, ends_b), len(both)))

    def facts(self, texts: list[str | None]) -> list[tuple]:
        """Per text (n_a, n_b, n_groups, n_links, n_shared, groups, pair keys, their links)."""
        odd: set[int] = set()
        counts = np.zeros((5, len(texts)), np.int64)
        written: list[list[str]] = [[] for _ in texts]
        pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
        for block in self.blocks(texts, odd):
            rows, columns, _ = product(block.bytes_a, transposed(block.bytes_b))
            shared = row_products(block.groups_a, transposed(block.groups_b))
            group_a, group_b = block.groups_a.columns, block.groups_b.columns
            last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
            for n, (docs, weights) in enumerate(((block.doc_a, None), (block.doc_b, None), (block.doc_a[last_a], None),
                                                 (block.doc_a[rows], None), (block.doc_a, shared))):
                counts[n] += np.bincount(docs, weights, len(texts)).astype(np.int64)
            # Both sides of a group stand together: behind each token of A those of B in earlier groups, and so on.
            before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
            upto_a = np.flatnonzero(last_a) + 1
            entries = np.empty(len(block.a) + len(block.b), np.int64)
            entries[np.arange(len(block.a)) + before_b[group_a]] = block.a + self.top * last_a
            entries[np.arange(len(block.b)) + upto_a[group_b]] = block.b + 2 * self.top * last_b
            order = block.doc_a[rows] << 40 | block.a[rows].astype(np.int64) << 20 | block.b[columns]
            keys, many = np.unique(order, return_counts=True)
            docs, at = np.unique(keys >> 40, return_index=True)
            token_at = np.searchsorted(block.doc_a, docs) + np.searchsorted(block.doc_b, docs)
            for n, doc in enumerate(docs):
                own = slice(at[n], at[n + 1] if n + 1 < len(at) else None)
                pairs[doc].append((keys[own] & ((1 << 40) - 1), many[own]))
                own = entries[token_at[n]:token_at[n + 1] if n + 1 < len(at) else None]
                written[doc].append("".join(map(self.written.__getitem__, own.tolist())))
        nothing = (np.empty(0, np.int64), np.empty(0, np.int64))
        out = []
        for doc in range(len(texts)):
            if doc in odd:
                out.append((0, 0, 0, 0, 0, "", *nothing))
                continue
            found = pairs[doc] or [nothing]
            keys, many = found[0]
            if len(found) > 1:
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                many = np.bincount(at, np.concatenate([m for _, m in found]), len(keys)).astype(np.int64)
            out.append((*counts[:, doc].tolist(), "".join(written[doc])[:-1], keys, many))
        return out


def parts_of(text: str) -> Iterator[str]:
    """The text cut at single blanks, about every ``CUT`` characters; the blanks are left out."""
    at = 0
    while len(text) - at > CUT:
        blank = _SINGLE_BLANK.search(text, at + CUT)
        if not blank:
            break
        yield text[at:blank.start()]
        at = blank.end()
    if at < len(text):
        yield text[at:]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Adds the alignment of each row's ``text`` to ``docs``, in place of ``text`` and columns of the same names.

    ``n_a`` and ``n_b`` count tokens, ``n_groups`` groups, ``n_links`` overlap links,
    ``n_shared`` shared-group links. ``groups`` writes the ids out, ``a1,a2|b1;a3|b2,b3``.
    ``pairs`` has each pair of ids that is linked, with its number of links. A text that is
    null or empty, or whose tokens' bytes are not its own behind a blank (U+2581 counts as a
    blank), has no tokens: zeros, an empty string and no pairs. Rows are taken one by one
    and whole, without a shuffle; an empty table gives none. Ids have to be below 2^20.
    """
    own = {f.split()[0] for f in FACTS.replace(PAIRS, "x").split(", ")}
    kept = [f for f in docs.schema.fields if f.name not in own | {"text"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = both.facts(part.column("_text").to_pylist())
                keys = np.concatenate([f[6] for f in found])
                pairs = pa.StructArray.from_arrays(
                    [pa.array((keys >> 20).astype(np.int32)), pa.array((keys & ((1 << 20) - 1)).astype(np.int32)),
                     pa.array(np.concatenate([f[7] for f in found]).astype(np.int32))], names=["a", "b", "n"])
                offsets = np.concatenate([[0], np.cumsum([len(f[6]) for f in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array([f[n] for f in found], pa.int64()) for n in range(5)),
                     pa.array([f[5] for f in found], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pairs)],
                    names=[*(f.name for f in kept), "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "pairs"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    rows = docs.select(*[f"`{f.name}`" for f in kept], F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, fields + FACTS)


def links(docs: DataFrame, path_a: str, path_b: str, shared: bool = False, most: int = 1 << 18) -> DataFrame:
    """``(doc_id, a_at, a, b_at, b, n_bytes)``: a row per overlap link, or per shared-group link.

    ``a_at`` and ``b_at`` are the tokens' places in their sequences. Shared-group links have
    the bytes in common too, which may be none. At most about ``most`` links are held at a
    time. Null, empty and odd texts have none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for i in range(batch.num_rows):
                odd: set[int] = set()
                found = list(both.blocks([batch.column("text")[i].as_py()], odd))
                seen_a = seen_b = 0
                for block in () if odd else found:
                    left, right = (block.groups_a, transposed(block.groups_b)) if shared else (block.bytes_a, transposed(block.bytes_b))
                    for first, last in row_blocks(row_products(left, right), most):
                        rows, columns, n = product(left, right, first, last)
                        if shared:
                            low = np.maximum(block.bytes_a.starts[rows], block.bytes_b.starts[columns])
                            n = np.maximum(np.minimum(block.bytes_a.starts[rows + 1], block.bytes_b.starts[columns + 1]) - low, 0)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(np.full(len(rows), i))), pa.array(rows.astype(np.int64) + seen_a),
                             pa.array(block.a[rows]), pa.array(columns.astype(np.int64) + seen_b), pa.array(block.b[columns]),
                             pa.array(n.astype(np.int64))], names=["doc_id", "a_at", "a", "b_at", "b", "n_bytes"])
                    seen_a, seen_b = seen_a + len(block.a), seen_b + len(block.b)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, a_at long, a int, b_at long, b int, n_bytes long")


def with_counts(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to what ``align`` returns and takes ``pairs`` away.

    A pair of ids counts in how many rows it is linked. ``count_sum`` adds these counts up
    over a row's links, ``n_best`` counts the links whose pair has the highest count of all
    pairs with its id of A. The rows are staged once. Pairs met most often, at most
    ``hot_pairs`` of them, go to all tasks; the others are joined by a shuffle, in which each
    has few rows, so that no key is hot.
    """
    taken = set(aligned.columns)
    name = lambda n: n if n not in taken else name("_" + n)
    row, key, docs, best, many = (name(n) for n in ("row", "key", "docs", "best", "links"))
    rows = stage(aligned.withColumn(row, F.monotonically_increasing_id()), "aligned")
    met = rows.select(row, F.explode("pairs").alias("pair")).select(
        row, F.expr("shiftleft(cast(pair.a as bigint), 20) | pair.b").alias(key), F.col("pair.n").alias(many))
    counts = met.groupBy(key).agg(F.count(F.lit(1)).alias(docs))
    per_a = Window.partitionBy(F.shiftright(F.col(key), 20))  # at most the second vocabulary
    facts = stage(counts.withColumn(best, F.col(docs) == F.max(docs).over(per_a)), "pair-counts")
    level = F.floor(F.log2(F.col(docs))).cast("int")
    sizes = {r["level"]: r["n"] for r in facts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    least, held = 64, 0
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > hot_pairs:
            break
        least = at
    add = [F.sum(F.when(F.col(best), F.col(many)).otherwise(0)).alias("n_best"), F.sum(F.col(many) * F.col(docs)).alias("count_sum")]
    hot = F.broadcast(facts.where(level >= least))
    sums = met.join(hot, key).groupBy(row).agg(*add)
    if held > hot_pairs:
        rare = met.join(hot, key, "left_anti").join(facts.where(level < least), key).groupBy(row).agg(*add)
        sums = sums.unionByName(rare).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", *({"n_best", "count_sum"} & taken)).join(sums, row, "left").drop(row)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.withColumns({"n_best": zero(F.col("n_best")), "count_sum": zero(F.col("count_sum"))})
