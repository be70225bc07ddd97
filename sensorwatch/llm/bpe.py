"""Byte-level BPE over whole texts with a given public vocabulary file.

A text is cut at added tokens, then into pieces by the byte-level pattern. The symbols of a
piece form a doubly linked list; a priority queue holds the merge rank of every adjacent
pair, and entries whose pair has changed meanwhile are skipped when they come up. Short
pieces are kept per worker up to a bound. Decoding concatenates vocabulary strings.

A null text counts as empty and gives no tokens; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructType

from sensorwatch.llm import common as C

# Fixed value: the byte-level pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# Code points that the pattern library takes for letters or digits and the vocabulary's Unicode version does not.
UNASSIGNED = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


def unassigned() -> str:
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in UNASSIGNED.split())


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary strings."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Pieces(dict):
    """Piece -> its ids as packed 32-bit integers, computed on demand. Short pieces are kept in two generations
    of up to ``most``: a full one becomes the old one, from which pieces still in use come back."""

    def __init__(self, bpe: Bpe, most: int):
        super().__init__()
        self.bpe, self.most, self.old = bpe, most, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.bpe.merge(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 40:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, kept: int = 150_000):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary = whole["model"]["vocab"]
        shown = byte_characters()
        byte_of = {c: b for b, c in enumerate(shown)}
        self.first = [vocabulary[c] for c in shown]
        self.ranks, self.made = {}, []  # rank by (left << 32 | right), merged id by rank
        for rank, merge in enumerate(whole["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocabulary[left] << 32 | vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        self.strings = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.strings |= {i: t.encode() for t, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find_all = regex.compile(PATTERN).findall
        self.rare = self.find_rare = None
        self.pieces = Pieces(self, kept)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: lowest rank first, the leftmost pair on ties. Queue entries are rank << 32 | position."""
        ids = [self.first[b] for b in piece]
        n, rank_of = len(ids), self.ranks.get
        if n < 2:
            return ids
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            top = pop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] < 0 or rank_of(ids[i] << 32 | ids[j]) != top >> 32:
                continue  # stale: one side has been merged since
            ids[i] = made = self.made[top >> 32]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(made << 32 | ids[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] << 32 | made)) is not None:
                push(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def find(self, text: str) -> list[str]:
        """Pieces of a text without added tokens."""
        if text.isascii() or max(text) < "\u0530":
            return self.find_all(text)
        if self.rare is None:
            new = unassigned()
            self.rare = regex.compile(f"[{new}]").search
            pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])")
            for kind in "LN":
                pattern = pattern.replace(rf" ?\p{{{kind}}}+", rf" ?(?:(?![{new}])\p{{{kind}}})+")
            self.find_rare = regex.compile(pattern).findall
        return self.find_rare(text) if self.rare(text) else self.find_all(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.added):
            pieces = self.pieces
            return b"".join([pieces[p] for p in self.find(text)])
        return b"".join(struct.pack("<I", self.added[part]) if part in self.added else b"".join([self.pieces[p] for p in self.find(part)]) for part in self.cut.split(text))

    def decode(self, packed: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in memoryview(packed).cast("I")]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> Bpe:
    return Bpe(path)


def tokenised(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of the rows plus ``ids`` (binary, little-endian 32-bit) and ``decoded`` (text).

    ``path`` names a vocabulary file that every executor has. Columns of these names are replaced.
    """
    kept = docs.drop("ids", "decoded")
    place = kept.columns.index(text)

    def encode(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = _loaded(path)
        packed = [bpe.encode(x) for x in C.python_texts(batch.column(place))]
        return [*batch.columns, C.binary(packed), pa.array([bpe.decode(x) for x in packed], pa.string())]

    schema = StructType(list(kept.schema.fields)).add("ids", BinaryType()).add("decoded", StringType())
    return C.map_arrow(kept, encode, schema, rows=256)
