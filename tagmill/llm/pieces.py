"""SentencePiece (BPE) encoding by a table of prefixes, and decoding.

Every prefix of a text has one encoding, and the encoding of a prefix without its last
token is that of a shorter prefix. So one number per prefix, the length of its last token,
holds the encodings of all prefixes. An Aho-Corasick automaton over the pieces names all
that end at a place, longest first; a piece is the last token of that prefix if the last
token of the prefix before it and the piece are a compatible pair, which is one that
merging leaves as it is. Just one piece passes. The ids are then read backwards from the
end of the text. Time grows with the text, and the table takes a byte a character.

A compatible pair is found from the merges that build its two tokens: the last symbol of
the left one and the first symbol of the right one grow, each at its own ranks, and the
pair fails if at some moment the two symbols that meet make a piece that is due before
either of them grows (at equal rank the merge further left is first).

Merges do not reach over a blank that follows a word, nor over a line end, so a text is
taken in chunks between these, and the ids of the chunks met are kept in a bounded table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

BLANK = "▁"
CACHED = 300_000
LONGEST_KEPT = 64
TAIL = ",.;:!?"
SLICE = 256
_UNKNOWN = -1
_NEVER = 1 << 62


class Pieces:
    """A model file with the merges of its pieces; one per Python worker."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        silent = {i for i in range(size) if model.is_control(i)}
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        known = [i for i in range(size) if i not in silent and i != self.unknown and not model.is_byte(i)]
        if len(self.byte_ids) != 256 or any(model.is_unused(i) for i in known):
            raise ValueError("a model with byte fallback and no unused pieces is needed")
        self.ids = {self.names[i]: i for i in known}
        if any(c not in self.ids for name in self.ids for c in name):
            raise ValueError("each character of a piece has to be a piece")
        if any(BLANK in name.lstrip(BLANK) or len(name) > 1 and "\n" in name for name in self.ids):
            raise ValueError("pieces may not go on behind a blank or a line end")
        if any(a.isalpha() and b in TAIL for name in self.ids for a, b in zip(name, name[1:])):
            raise ValueError("pieces may not go on from a letter to punctuation")
        if model.encode(" a  Ａ ", out_type=str) != [*model.encode(f"{BLANK}a{BLANK}{BLANK}Ａ{BLANK}", out_type=str)] \
                or model.decode(model.encode(" a  Ａ ")) != " a  Ａ ":
            raise ValueError("a model that adds a blank in front and changes nothing else is needed")
        # A merge is due in the order of falling scores; equal scores share a rank.
        scores = {name: model.get_score(i) for name, i in self.ids.items()}
        places = {score: at for at, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {name: places[score] for name, score in scores.items()}
        self.bytes = [b"" if i in silent else b" \xe2\x81\x87 " if i == self.unknown else name.replace(BLANK, " ").encode()
                      for i, name in enumerate(self.names)]
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        self.is_byte = frozenset(self.byte_ids.values())
        self.silent = frozenset(silent)
        self.breaks = np.isin(np.arange(size), [*silent])
        self._build()
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.chunk = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """(symbols, last merge) of a short text by the definition: best pair first, leftmost at equal rank."""
        symbols, last = list(text), None
        while True:
            due = [(self.rank[a + b], at) for at, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank]
            if not due:
                return symbols, last
            at = min(due)[1]
            last = symbols[at], symbols[at + 1]
            symbols[at:at + 2] = ["".join(last)]

    def _build(self) -> None:
        """The automaton over all pieces that merging can make, and the growing edges of each."""
        parts: dict[str, tuple[str, str] | None] = {}
        for name in sorted(self.ids, key=len):
            symbols, last = self.merged(name)
            if len(symbols) == 1:
                parts[name] = last
        if any(len(half) > 1 and self.rank[half] > self.rank[name] for name, two in parts.items() for half in two or ()):
            raise ValueError("a piece has to come after the pieces it is made of")
        self.size = [0] * len(self.names)
        self.left_edge: dict[int, list[tuple[str, int]]] = {}
        self.right_edge: dict[int, list[tuple[str, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for name in parts:
            own = self.ids[name]
            self.size[own] = len(name)
            self.automaton.add_word(name, (own, len(name)))
            for side, edges in ((0, self.left_edge), (1, self.right_edge)):
                chain, at = [name], parts[name]
                while at:
                    chain.append(at[side])
                    at = parts[at[side]]
                chain.reverse()
                # (symbol, rank of the merge that takes it up)
                edges[own] = [(s, self.rank[t]) for s, t in zip(chain, chain[1:])] + [(name, _NEVER)]
        self.automaton.make_automaton()
        self.longest = max(map(len, parts))

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of two tokens gives just these two."""
        a, b = self.right_edge[left], self.left_edge[right]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            due = self.rank.get(x + y)
            if due is not None and due < x_until and due <= y_until:
                return False
            if x_until == y_until == _NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _fits(self, before: int, token: int) -> bool:
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        fits = self.pairs[before << 20 | token] = self.compatible(before, token)
        return fits

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of short texts with their blanks as U+2581, in one run over all of them.

        Between two chunks stands a line end, which no other character merges with.
        """
        text = "\n".join(chunks)
        last, done, pairs = [_UNKNOWN] * (len(text) + 1), 0, self.pairs
        for at, (token, size) in self.automaton.iter(text):
            if at < done:
                continue
            before = last[at + 1 - size]
            if before >= 0:
                try:
                    if not pairs[before << 20 | token]:
                        continue
                except KeyError:
                    if not self._fits(before, token):
                        continue
            done = at + 1
            last[done] = token
        out, base, sizes = [], 0, self.size
        for chunk in chunks:
            ids, end = [], base + len(chunk)
            while end > base:
                token = last[end]
                if token >= 0:
                    ids.append(token)
                    end -= sizes[token]
                else:
                    ids.extend(self._spelled(text[end - 1]))
                    end -= 1
            ids.reverse()
            out.append(array("I", ids).tobytes())
            base += len(chunk) + 1
        return out

    def _spelled(self, char: str) -> list[int]:
        """The byte ids of a character that no piece has, last one first."""
        if char in self.ids:
            raise ValueError("no last token for a prefix; this is not a BPE vocabulary")
        return [self.byte_ids[b] for b in reversed(char.encode("utf-8", "replace"))]

    def encode_long(self, text: str) -> bytes:
        """The same of one text of any length: a byte a character, and the tokens of the latest prefixes."""
        lengths, turn, done = bytearray(len(text) + 1), self.longest + 1, 0
        ring = [_UNKNOWN] * turn
        for at, (token, size) in self.automaton.iter(text):
            if at < done:
                continue
            while done < at:
                done += 1
                ring[done % turn] = _UNKNOWN
            before = ring[(at + 1 - size) % turn] if at + 1 > size else _UNKNOWN
            if before >= 0:
                fits = self.pairs.get(before << 20 | token)
                if not (self._fits(before, token) if fits is None else fits):
                    continue
            done = at + 1
            lengths[done] = size
            ring[done % turn] = token
        out, end = array("I"), len(text)
        while end:
            size = lengths[end]
            if size:
                out.append(self.ids[text[end - size:end]])
            else:
                out.extend(self._spelled(text[end - 1]))
            end -= size or 1
        out.reverse()
        return out.tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of chunks into the table; punctuation behind a letter is a chunk of its own."""
        if len(self.known) + 2 * len(chunks) > CACHED:  # the chunks met first are the common ones
            self.known = dict(islice(self.known.items(), CACHED // 2))
        known, split, missing = self.known, {}, set()
        for chunk in chunks:
            core = chunk.rstrip(TAIL)
            if core and len(core) < len(chunk) and core[-1].isalpha():
                split[chunk] = core, chunk[len(core):]
                missing.update(split[chunk])
            else:
                missing.add(chunk)
        new = [c for c in missing if c not in known]
        known.update(zip(new, self.encode_chunks(new)))
        for chunk, (core, tail) in split.items():
            known[chunk] = known[core] + known[tail]

    def encode(self, texts: list[str | None], ends: bool = True) -> list[bytes]:
        """Ids as 32-bit integers, with those of begin and end if asked; null counts as empty."""
        first, last = (array("I", [i]).tobytes() if ends else b"" for i in (self.begin, self.end))
        out = []
        for text in texts:
            chunks = self.chunk.findall(BLANK + text.replace(" ", BLANK)) if text else []
            missing = set(chunks).difference(self.known)
            long = {c for c in missing if len(c) > LONGEST_KEPT}
            for at in range(0, len(missing := [*(missing - long)]), 1 << 14):
                self._learn(set(missing[at:at + (1 << 14)]))
            try:
                found = [self.known[c] for c in chunks]
            except KeyError:  # long ones, and where a text has more chunks than the table
                found = [self.encode_long(c) if c in long else self.known.get(c) or self.encode_chunks([c])[0] for c in chunks]
            out.append(b"".join([first, *found, last]))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of any ids; bytes that are no UTF-8 become U+FFFD one by one."""
        numbers = np.frombuffer(ids, "<u4")
        tokens, table = numbers.tolist(), self.bytes
        try:
            if self.breaks[numbers[1:-1]].any():  # bytes on either side are not one character
                raise ValueError
            text = b"".join([table[i] for i in tokens]).decode()
        except ValueError:
            text = self._repaired(tokens)
        first = next((i for i in tokens if i not in self.silent), None)
        strip = first is not None and first not in self.is_byte and self.names[first].startswith(BLANK)
        return text[1:] if strip else text

    def _repaired(self, tokens: list[int]) -> str:
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at:at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                at += size
            run.clear()

        for i in tokens:
            if i in self.is_byte:
                run += self.bytes[i]
            else:
                flush()
                out.append(self.bytes[i].decode())
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, path: str, ends: bool = True) -> DataFrame:
    """``(doc_id, ids binary, decoded)`` per row of ``docs(doc_id, text)``.

    ``ids`` are those of the model file at ``path`` (readable on every executor), with the
    ids of begin and end around them if ``ends``, as little-endian unsigned 32-bit integers;
    ``decoded`` is what the model makes of them again. A null or empty text gives no ids but
    the ends, and an empty string. Rows are encoded one by one and whole, without a shuffle,
    so repeated rows and null ids come out row by row and an empty table gives none; extra
    columns are not returned. A text's memory is its ids and a byte a character of its
    longest unsplit stretch.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = own.encode(part.column("text").to_pylist(), ends)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()),
                                                  pa.array([own.decode(i) for i in ids], pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def decode_pieces(tokens: DataFrame, path: str) -> DataFrame:
    """``(doc_id, decoded)`` per row of ``tokens(doc_id, ids binary)``; null ids give null."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            texts = [None if i is None else own.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")
