"""Problem 6: byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last one of the prefix's encoding. Reading left to right, an
automaton over the vocabulary gives the tokens that end at a position; the one that is compatible with the last token
of the prefix before it is stored, and following these back gives the ids. The time is linear in the length whatever
the text, so very long runs of letters do no harm.

Two neighbouring tokens are compatible if no merge across their border comes first when the bytes of both are merged.
Undoing the latest merges on both sides in turn visits exactly the pairs of neighbours that were at the border.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how these vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES, CACHED_LENGTH, CACHED_PAIRS = 400_000, 64, 1_000_000
_BASE = -1


def _byte_of_letter() -> dict[str, int]:
    """The printable letter that stands for each byte in the json vocabularies: itself, or the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        table[chr(256 + i)] = b
    return table


class _Words(dict):
    """Ids, as int32 bytes, of what stands between two single spaces, made when first asked for.

    The space before a word belongs to it, so a text falls apart at each single space between two letters or signs
    without any change to its pieces; the pattern then runs only over words not seen before.
    """

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes | None:
        outer = not word or word[0].isspace() or word[-1].isspace()  # white space next to white space: see packed()
        ids = None if outer else self.encode(self.before + word)
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids


class _Pieces(dict):
    """Ids of the pieces that the pattern makes, as int32 bytes."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.fromiter(self.encode(piece.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(piece) <= CACHED_LENGTH:
            self[piece] = ids
        return ids


class PrefixEncoder:
    """Encoder for a vocabulary file: .json with merges, or .tiktoken with ranks."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        self._split = regex.compile(PATTERN).findall
        if path.endswith(".json"):
            self._read_json(path)
        else:
            self._read_ranks(path)
        self._memo: dict[int, bool] = {}
        self._length = {t: len(b) for t, b in self._bytes.items()}
        self._auto = ahocorasick.Automaton()
        for t, b in self._bytes.items():
            self._auto.add_word(b.decode("latin-1"), t)
        self._auto.make_automaton()
        self._inner, self._first = _Words(self._encode_run, " "), _Words(self._encode_run, "")
        self._pieces = _Pieces(self.encode_piece)

    def _read_json(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_of_letter()
        vocab = model["vocab"]
        self._made: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank of its merge
        self._rank: dict[int, int] = {}  # pair: rank
        self._bytes: dict[int, bytes] = {}
        for t, i in vocab.items():
            if len(t) == 1:
                self._bytes[i] = bytes([letters[t]])
                self._made[i] = (i, i, _BASE)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self._rank[x << 20 | y] = rank
            if z not in self._made:
                self._made[z] = (x, y, rank)
                self._bytes[z] = self._bytes[x] + self._bytes[y]

    def _read_ranks(self, path: str) -> None:
        """Merges aren't listed: a token is made by the one split whose halves are compatible below its rank."""
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self._made, self._rank, self._bytes, self._memo = {}, {}, {}, {}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self._bytes[i], self._made[i] = b, (i, i, _BASE)
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            halves = [(x, y) for p in range(1, len(b)) if (x := ranks.get(b[:p], i)) < i or p == 1 and x != i if (y := ranks.get(b[p:], i)) < i or p == len(b) - 1 and y != i]
            halves = [(x, y) for x, y in halves if x in self._made and y in self._made]
            if len(b) > 1:
                made = next(((x, y) for x, y in halves if self._border_holds(x, y)), None)
                if made:
                    self._made[i], self._bytes[i] = (*made, i), b
                for x, y in halves:
                    self._rank[x << 20 | y] = i

    def _border_holds(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their bytes are merged together.

        left and right are the ranks of the merges that took in the tokens now at the border. Of equal merges the
        leftmost comes first, so the border's own merge must be below the left one but not above the right one.
        """
        made, rank = self._made, self._rank
        left = right = 1 << 40
        while True:
            r = rank.get(a << 20 | b)
            if r is not None and r < left and r <= right:
                return False
            made_a, made_b = made[a][2], made[b][2]
            if made_b >= made_a:
                if made_b == _BASE:
                    return True
                right, b = made_b, made[b][0]
            else:
                left, a = made_a, made[a][1]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        last = [-1] * (len(piece) + 1)
        length, memo = self._length, self._memo
        if len(memo) > CACHED_PAIRS:
            memo.clear()
        for end, t in self._auto.iter(piece.decode("latin-1")):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - length[t]
            if start:
                pair = last[start] << 20 | t
                holds = memo.get(pair)
                if holds is None:
                    holds = memo[pair] = self._border_holds(last[start], t)
                if not holds:
                    continue
            last[end + 1] = t
        ids, end = [], len(piece)
        while end:
            t = last[end]
            ids.append(t)
            end -= length[t]
        return tuple(reversed(ids))

    def _encode_run(self, run: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._split(run)))

    def packed(self, text: str | None) -> bytes:
        """The ids as int32 bytes."""
        if not text:
            return b""
        words = text.split(" ")
        first = self._first[words[0]]
        rest = list(map(self._inner.__getitem__, words[1:]))
        if first is None or None in rest:
            return self._encode_run(text)
        return first + b"".join(rest)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def rest(self) -> None:
        """Between batches: keep the memory of the caches bounded."""
        for cache in (self._inner, self._first, self._pieces):
            if len(cache) > CACHED_PIECES:
                cache.clear()


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of a file, built once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """doc_id, ids of each row; null and empty texts have an empty list. One pass, no shuffle.

    vocabulary is the path of the file on every executor. Strings that look like special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [enc.packed(text) for text in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])
                enc.rest()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")
