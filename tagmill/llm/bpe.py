"""BPE encoding and decoding, long unsplit texts by tree concatenation.

Texts are cut at ASCII white space, over which neither the normalizer, the splitting
pattern nor a merge reaches, so the ids of a text are those of its chunks in order. Short
chunks are encoded by the library and kept in a bounded table, as words repeat.

A chunk of more than ``long`` characters is one that white space does not split. It is
normalized and split by the tokenizer's own rules, and each resulting piece that is still
long is encoded as a tree: its leaves are encoded on their own (all but the last without
the end-of-word mark), and two neighbours are joined by encoding a window around the seam
anew, from whole tokens on either side. The window grows until its outer tokens agree
exactly with the tokens that stand there on both sides; what lies beyond is then
unchanged, because a sequence of tokens is the encoding of its text as soon as each
adjacent pair of tokens is. A window that has taken in both sides is the encoding itself.

Leaves of one document go to tasks of their own when the document is longer than
``spread`` characters, and the document's parts are joined in one task afterwards.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .words import WORD

LONG = 512
LEAF = 256
SPREAD = 200_000
CACHED = 200_000
AGREE = 2
TEXT, PIECES, INNER, LAST = range(4)
_CHUNK = re.compile(WORD.pattern.decode())


def tree_encode(text: str, encode_inner, encode_last, spell: list[str], leaf: int = LEAF, last: bool = True) -> list[int]:
    """Ids of one unsplit piece: halves first, then the seam.

    ``encode_inner`` and ``encode_last`` give the ids of a string that does not, and does,
    end a word; ``spell`` gives the string of an id, with the end mark where it has one.
    """
    if len(text) <= leaf:
        return encode_last(text) if last else encode_inner(text)
    half = len(text) // 2
    return join_seam(tree_encode(text[:half], encode_inner, encode_last, spell, leaf, False),
                     tree_encode(text[half:], encode_inner, encode_last, spell, leaf, last),
                     encode_inner, encode_last, spell, last)


def join_seam(left: list[int], right: list[int], encode_inner, encode_last, spell: list[str], last: bool) -> list[int]:
    """Ids of the concatenation of two encoded parts."""
    width = 8
    while True:
        a, b = left[-width:], right[:width]
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        text = "".join(spell[i] for i in a) + "".join(spell[i] for i in b)
        if last and whole_right:
            window = encode_last(text)
        else:
            window = encode_inner(text)
        if ((whole_left or window[:AGREE] == a[:AGREE] and len(a) > AGREE)
                and (whole_right or window[-AGREE:] == b[-AGREE:] and len(b) > AGREE)):
            return left[:len(left) - len(a)] + window + right[len(b):]
        width *= 2


class Encoder:
    """A tokenizer file with the tree for long unsplit text; one per Python worker."""

    def __init__(self, path: str, long: int = LONG):
        self.long, self.path = long, path
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or spec["post_processor"] \
                or spec["decoder"] or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("a plain BPE without decoder and post-processor is needed")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or _CHUNK.fullmatch(t["content"]) is None for t in added):
            raise ValueError("added tokens have to be plain strings without white space")
        self.added = {t["content"]: t["id"] for t in added}
        self.extra = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.mark = model.get("end_of_word_suffix") or ""
        self.last = self.whole.model
        self.inner = Tokenizer.from_str(json.dumps({**spec, "model": {**model, "end_of_word_suffix": None}})).model
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.names = [self.whole.id_to_token(i) or "" for i in range(size)]
        self.spell = [n[:-len(self.mark)] if self.mark and n.endswith(self.mark) else n for n in self.names]
        self.known: dict[str, tuple[bytes, str]] = {}

    def _inner(self, text: str) -> list[int]:
        return [t.id for t in self.inner.tokenize(text)]

    def _last(self, text: str) -> list[int]:
        return [t.id for t in self.last.tokenize(text)]

    def _unsplit(self, text: str) -> list[int]:
        """Ids of a long chunk."""
        out: list[int] = []
        for part in self.extra.split(text) if self.extra else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(part)):
                    out += tree_encode(piece, self._inner, self._last, self.spell)
        return out

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), " ".join([self.names[i] for i in ids])

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text; null counts as empty."""
        out = []
        for text in texts:
            if len(self.known) > CACHED:  # the words met first are the common ones
                self.known = dict(islice(self.known.items(), CACHED // 2))
            chunks = _CHUNK.findall(text or "")
            missing = set(chunks).difference(self.known)
            short = [c for c in missing if len(c) <= self.long]
            if short:
                for chunk, found in zip(short, self.whole.encode_batch_fast(short, add_special_tokens=False)):
                    self.known[chunk] = self._entry(found.ids)
            own = {c: self._entry(self._unsplit(c)) for c in missing if len(c) > self.long}
            found = [own[c] if c in own else self.known[c] for c in chunks] if own else [self.known[c] for c in chunks]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])))
        return out

    def encode_part(self, kind: int, text: str) -> bytes:
        """Ids of a part as ``_cutter`` makes it."""
        if kind == TEXT:
            return self.encode([text])[0][0]
        if kind == PIECES:
            ids = [i for piece in text.split(" ") for i in tree_encode(piece, self._inner, self._last, self.spell)]
        else:
            ids = tree_encode(text, self._inner, self._last, self.spell, last=kind == LAST)
        return np.array(ids, "<u4").tobytes()

    def stitch(self, parts: list[tuple[int, bytes]]) -> bytes:
        """Ids of a text from those of its parts; leaves of one piece are joined as a tree."""
        out, leaves = [], []
        for kind, ids in parts:
            if kind not in (INNER, LAST):
                out.append(ids)
                continue
            leaves.append(np.frombuffer(ids, "<u4").tolist())
            if kind == LAST:
                while len(leaves) > 1:
                    pairs = [leaves[i:i + 2] for i in range(0, len(leaves), 2)]
                    leaves = [join_seam(*pair, self._inner, self._last, self.spell, n == len(pairs) - 1) if len(pair) == 2 else pair[0]
                              for n, pair in enumerate(pairs)]
                out.append(np.array(leaves.pop(), "<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    return Encoder(path)


def tokenize(docs: DataFrame, path: str, spread: int = SPREAD) -> DataFrame:
    """``(doc_id, ids binary, decoded)`` per row of ``docs(doc_id, text)``.

    ``ids`` are those of the tokenizer file at ``path`` (readable on every executor) without
    special tokens added, as little-endian unsigned 32-bit integers; ``decoded`` is what its
    decoder, with special tokens kept, makes of them. A null or empty text gives no ids and
    an empty string. Each row is encoded on its own, whole, so repeated rows and null ids
    come out row by row; extra columns are not returned. Texts over ``spread`` characters
    are cut into parts that are encoded in tasks of their own, at white space where there is
    some and else into leaves of the tree; the parts of a document are put together in one
    task, as its ids are one value.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.length("text"), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = own.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.binary()),
                                                  pa.array([f[1] for f in found], pa.string())], names=["doc_id", "ids", "decoded"])

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode_part(k, t) for k, t in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "copies", "mark", "seq", "kind")),
                                              pa.array(ids, pa.binary())], names=["doc_id", "copies", "mark", "seq", "kind", "ids"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = own.stitch([(p["kind"], p["ids"]) for p in batch.column("parts")[i].as_py()])
                n = batch.column("copies")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id")[i].as_py()] * n, batch.column("doc_id").type),
                                                  pa.array([ids] * n, pa.binary()), pa.array([own.decode(ids)] * n, pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    short = rows.where(size <= spread).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
    whole = f"doc_id {kind}, copies long, mark string, seq long, kind int"
    long = rows.where(size > spread).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    parts = long.mapInArrow(_cutter(path, max(spread // 4, 1)), f"{whole}, text string")
    encoded = parts.repartition("mark", "seq").mapInArrow(run_parts, f"{whole}, ids binary")
    gathered = encoded.groupBy("doc_id", "mark", "copies").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "ids"))).alias("parts"))
    return short.unionByName(gathered.mapInArrow(stitch, f"doc_id {kind}, ids binary, decoded string"))


def _cutter(path: str, size: int):
    """Parts of a text, each about ``size`` characters at most; ``mark`` names the text.

    TEXT ends at white space; PIECES are whole pieces of an unsplit stretch, apart by blanks
    (which byte-level strings lack); INNER and LAST are the leaves of one long piece.
    """
    def parts_of(text: str, own: Encoder) -> Iterator[tuple[int, str]]:
        at = 0
        for chunk in _CHUNK.finditer(text):
            start, stop = chunk.span()
            if stop - start > size:
                if start > at:
                    yield TEXT, text[at:start]
                yield from unsplit(chunk.group(), own)
                at = stop
            elif stop - at > size:
                yield TEXT, text[at:stop]
                at = stop
        if at < len(text):
            yield TEXT, text[at:]

    def unsplit(chunk: str, own: Encoder) -> Iterator[tuple[int, str]]:
        for part in own.extra.split(chunk) if own.extra else [chunk]:
            if part in own.added:
                yield TEXT, part
                continue
            held, total = [], 0
            for piece, _ in own.whole.pre_tokenizer.pre_tokenize_str(own.whole.normalizer.normalize_str(part)):
                if held and total + len(piece) > size:
                    yield PIECES, " ".join(held)
                    held, total = [], 0
                if len(piece) <= size:
                    held.append(piece)
                    total += len(piece)
                    continue
                cuts = range(0, len(piece), size)
                for cut in cuts:
                    yield LAST if cut == cuts[-1] else INNER, piece[cut:cut + size]
            if held:
                yield PIECES, " ".join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text, n = (batch.column(c)[i].as_py() for c in ("doc_id", "text", "copies"))
                mark = sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                for seq, (kind, part) in enumerate(parts_of(text, own)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc], batch.column("doc_id").type), pa.array([n], pa.int64()), pa.array([mark]),
                         pa.array([seq], pa.int64()), pa.array([kind], pa.int32()), pa.array([part])],
                        names=["doc_id", "copies", "mark", "seq", "kind", "text"])
    return run


def digested(tokens: DataFrame) -> DataFrame:
    """What ``tokenize`` returns, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    return tokens.select("*", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
