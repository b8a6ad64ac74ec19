"""Byte-level BPE of a corpus with a public vocabulary.

Two tiers. Most pre-tokens are whole vocabulary entries: a minimal perfect hash over the vocabulary
finds their id with one probe and one comparison. The others are merged byte by byte: a heap holds the
neighbouring pairs of a linked list of bytes by rank. Each worker remembers what it resolved.

Null text and empty text give an empty list. Strings that look like special tokens are ordinary text.
Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import map_rows, spread

#: The pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the public vocabularies are, if the caller names no other folder.
TOKENIZERS = "/opt/tokenizers"
#: A worker forgets what it resolved beyond so many pre-tokens; longer ones than KEEP_CHARS are never kept.
CACHE, KEEP_CHARS = 400_000, 40


class PerfectHash:
    """Compress, hash and displace: n keys to the slots 0..n-1 without collision.

    Keys fall into n/4 buckets. From the largest bucket on, a displacement is searched which sends all keys of
    the bucket to free slots; buckets of one key are given the next free slot directly."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.r = max(1, n // 4)
        h = np.array([xxhash.xxh3_128_intdigest(k) for k in keys], dtype=object)
        lo = np.array([x & 0xFFFFFFFFFFFFFFFF for x in h], dtype=np.uint64)
        hi = np.array([x >> 64 for x in h], dtype=np.uint64)
        bucket = (lo % np.uint64(self.r)).astype(np.int64)
        f1 = ((lo >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        f2 = (hi % np.uint64(n)).astype(np.int64)
        self.shift = np.zeros(self.r, np.int64)
        self.slot = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.r + 1))
        sizes = np.diff(starts)
        free = None
        for b in np.argsort(-sizes, kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if not len(own):
                break
            if len(own) == 1:
                free = iter(np.flatnonzero(~taken)) if free is None else free
                at = int(next(free))
                self.shift[b] = -at - 1  # a bucket of one key names its slot
                self.slot[at] = own[0]
                taken[at] = True
                continue
            base, width = 0, 64
            while True:
                d = np.arange(base, base + width)
                at = (f1[own][:, None] + d[None, :] // n + (d[None, :] % n) * f2[own][:, None]) % n
                ok = ~taken[at].any(axis=0)
                s = np.sort(at, axis=0)
                ok &= (s[1:] != s[:-1]).all(axis=0)
                if ok.any():
                    j = int(ok.argmax())
                    self.shift[b] = d[j]
                    self.slot[at[:, j]] = own
                    taken[at[:, j]] = True
                    break
                base, width = base + width, min(4096, 2 * width)
        self.keys = [keys[i] for i in self.slot]

    def find(self, key: bytes) -> int:
        """The index of a key in the list that was given, or -1."""
        h = xxhash.xxh3_128_intdigest(key)
        lo, hi = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        d = int(self.shift[lo % self.r])
        n = self.n
        at = -d - 1 if d < 0 else ((lo >> 32) % n + d // n + d % n * (hi % n)) % n
        return int(self.slot[at]) if self.keys[at] == key else -1


class ByteBPE:
    """ranks: the token id of each byte string; an id is also the rank of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.ids = np.array([ranks[k] for k in keys], np.int32)
        self.hash = PerfectHash(keys)
        self.forget()

    def forget(self) -> None:
        """Nothing resolved yet: of pre-tokens, of byte strings; and the ids of single bytes."""
        self.known: dict[str, tuple[int, ...]] = {}
        self.ranked: dict[bytes, int] = {}
        self.single = [self.rank(bytes([b])) for b in range(256)]

    @classmethod
    def load(cls, name: str, folder: str = TOKENIZERS) -> ByteBPE:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def rank(self, token: bytes) -> int:
        i = self.hash.find(token)
        return -1 if i < 0 else int(self.ids[i])

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Merge the lowest rank first, the leftmost of equals; n log n in the bytes."""
        n, ranked, single = len(raw), self.ranked, self.single
        if len(ranked) > CACHE:
            ranked.clear()
        part, ids = [raw[i : i + 1] for i in range(n)], [single[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                both = part[i] + part[j]
                r = ranked.get(both)
                if r is None:
                    r = self.rank(both)
                    if len(both) <= KEEP_CHARS:
                        ranked[both] = r
                if r >= 0:
                    heapq.heappush(heap, (r, i, both))

        for i in range(n):
            offer(i)
        while heap:
            r, i, both = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or part[i] + part[j] != both:
                continue
            part[i], part[j], ids[i] = both, b"", r
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(x for x, p in zip(ids, part) if p)

    def resolve(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        i = self.hash.find(raw)
        return (int(self.ids[i]),) if i >= 0 else self.merge(raw)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text))) if text else []

    def pieces(self, text: str):
        pattern, known = _pattern(), self.known
        if len(known) > CACHE:
            known.clear()
        words = pattern.findall(text)
        for w in set(words).difference(known):
            ids = self.resolve(w)
            if len(w) <= KEEP_CHARS:
                known[w] = ids
        try:
            return [known[w] for w in words]
        except KeyError:
            return [known[w] if w in known else self.resolve(w) for w in words]

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0

    def __getstate__(self):
        return {"ids": self.ids, "hash": self.hash}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()


_compiled: list = []


def _pattern():
    if not _compiled:
        _compiled.append(regex.compile(PATTERN))
    return _compiled[0]


def encode_corpus(df: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids of each row. The vocabulary (under 2 MB) is broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(ByteBPE.load(name, folder))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = shared.value
        rows = [bpe.encode(t) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return map_rows(spread(df.select(key, text)), f"{key} {kind}, ids array<int>", text, kernel)


def counter(name: str, folder: str = TOKENIZERS, shared=None):
    """A function from a list of texts to their token counts, for any of the public formats. shared: a broadcast ByteBPE."""
    if shared is not None or os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
        bpe = shared.value if shared is not None else ByteBPE.load(name, folder)
        return lambda texts: [bpe.count(t) for t in texts]
    if os.path.exists(os.path.join(folder, f"{name}.model")):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
        return lambda texts: list(map(len, sp.encode([t or "" for t in texts], num_threads=1)))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    tok.encode_special_tokens = True
    return lambda texts: [len(tok.encode(t, add_special_tokens=False)) if t else 0 for t in texts]
