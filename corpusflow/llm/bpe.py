"""Byte-level BPE with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: as many slots as entries,
each entry found with one digest and one comparison of bytes.  It resolves whole
pre-tokens that are vocabulary entries.  Tier two merges the other pre-tokens
with a heap of candidate pairs over doubly linked bytes, O(n log n) in their length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.runtime import text_batches

#: How many distinct pre-tokens a worker remembers before it starts anew.
MEMO = 1 << 19


class MinimalPerfectHash:
    """Hash-and-displace over distinct byte strings; ``find`` gives the value of a key or None."""

    def __init__(self, values: dict[bytes, int]):
        n = self.n = max(1, len(values))
        self.buckets = max(1, n // 4)
        where: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in values:
            h = xxhash.xxh64_intdigest(key)
            where.setdefault(h % self.buckets, []).append(((h >> 16) % n, (h >> 40) % max(1, n - 1) + 1, key))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        free, spots = np.ones(n, bool), np.arange(n)
        for bucket in sorted(where, key=lambda b: -len(where[b])):
            rows = where[bucket]
            starts, steps = (np.array([r[i] for r in rows]) for i in (0, 1))
            if len(rows) == 1:
                free_spots = np.flatnonzero(free[starts[0] :])
                at = starts[0] + free_spots[0] if len(free_spots) else np.flatnonzero(free)[0]
                shift, places = int((at - starts[0]) % n), [int(at)]
            else:
                shift, places = self._displace(starts, steps, free, spots)
            self.shift[bucket] = shift
            for place, row in zip(places, rows, strict=True):
                free[place], self.keys[place], self.values[place] = False, row[2], values[row[2]]

    def _displace(self, starts, steps, free, spots):
        n = self.n
        for turn in range(n):
            base = (starts + turn * steps) % n
            if len(set(base.tolist())) < len(base):
                continue
            for lo in range(0, n, 512):
                moved = (base[:, None] + spots[None, lo : lo + 512]) % n
                good = np.flatnonzero(free[moved].all(axis=0))
                if len(good):
                    return turn * n + lo + int(good[0]), moved[:, good[0]].tolist()
        raise ValueError("two keys share a 64-bit digest")

    def find(self, key: bytes) -> int | None:
        h, n = xxhash.xxh64_intdigest(key), self.n
        turn, shift = divmod(self.shift[h % self.buckets], n)
        place = ((h >> 16) % n + turn * ((h >> 40) % max(1, n - 1) + 1) + shift) % n
        return self.values[place] if self.keys[place] == key else None


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked neighbouring pair merges first, the leftmost of equals."""
    n, get = len(piece), rank.get
    # Byte i starts a symbol that ends before end[i]; the symbol before it starts at prev[i]; a merged symbol's end is 0.
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, upto = pop(heap)
        j = end[i]
        if not j or j >= n or end[j] != upto:  # one of the two has merged meanwhile
            continue
        end[j], end[i] = 0, upto
        if upto < n:
            prev[upto] = i
            k = end[upto]
            if (r := get(piece[i:k])) is not None:
                push(heap, (r, i, k))
        h = prev[i]
        if h >= 0 and (r := get(piece[h:upto])) is not None:
            push(heap, (r, h, upto))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return out


#: Letters and numbers that the pattern library's Unicode tables have and the encoder's (Unicode 16) lack.
NEWER_LETTERS = (
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEWER_NUMBERS = (
    (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6),
)


def _set(ranges) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


def pinned(pattern: str) -> str:
    """The pattern with the letters and numbers of the encoder's Unicode version; newer ones are other characters."""
    letters, numbers = _set(NEWER_LETTERS), _set(NEWER_NUMBERS)
    others = r"[^\s\p{L}\p{N}]"
    parts = pattern.split(others)
    parts = [x.replace(r"\p{L}", rf"[^\P{{L}}{letters}]").replace(r"\p{N}", rf"[^\P{{N}}{numbers}]") for x in parts]
    return f"(?:{others}|[{letters}{numbers}])".join(parts)


class Codec:
    """Encodes and decodes whole texts; special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.table = ranks, MinimalPerfectHash(ranks)
        self.pattern = pattern
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._encode = None

    def __getstate__(self):
        return {**self.__dict__, "_encode": None}

    def encode(self, text: str) -> np.ndarray:
        if self._encode is None:
            self._encode = self.encoder()
        return self._encode(text)

    def pieces(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.table.find(raw)
        return [whole] if whole is not None else merge(raw, self.ranks)

    def encoder(self):
        """A function from text to an int32 array, with a bounded memory of pre-tokens."""
        split, pieces = regex.compile(self.pattern).findall, self.pieces
        exact, newer = regex.compile(pinned(self.pattern)).findall, regex.compile(f"[{_set(NEWER_LETTERS)}{_set(NEWER_NUMBERS)}]").search
        first = chr(min(a for a, _ in NEWER_LETTERS + NEWER_NUMBERS))

        class Memo(dict):
            def __missing__(self, piece):
                if len(self) >= MEMO:
                    self.clear()
                found = self[piece] = tuple(pieces(piece))
                return found

        memo = Memo()

        def encode(text: str) -> np.ndarray:
            plain = text.isascii() or max(text) < first or not newer(text)  # both patterns split these alike
            return np.fromiter(chain.from_iterable(map(memo.__getitem__, (split if plain else exact)(text))), np.int32)

        return encode

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>, decoded binary)`` of every row.

    ``path`` names a rank file that the driver reads; tasks get the finished tables
    as a broadcast of about 50,000 entries.  Null text counts as empty, an empty
    text has no ids; rows repeat as they come; other columns are ignored.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec(load_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value  # a worker keeps it, and so its memory of pre-tokens, from task to task
        encode = own.encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounded output batches
                part = batch.slice(at, 256)
                ids = [encode(t.as_py() or "") for t in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                decoded = pa.array([own.decode(x.tolist()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), decoded], names=["doc_id", "ids", "decoded"]
                )

    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def ids_digest(ids: str = "ids") -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
