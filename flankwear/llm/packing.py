"""Best-fit packing of token pieces into fixed-length sequences by large-item matching.

Documents are tokenised once (whole texts, white-space chunks cached per worker), closed with an end id
and cut into pieces of at most ``capacity`` tokens.  Pieces of equal length are interchangeable, so the
packing is decided on the histogram of lengths, at most ``capacity`` rows whatever the corpus size:

1. lengths above a third of the capacity fit at most twice into a sequence: from the longest down, each
   length is matched with the longest such partner that still fits, else it opens a sequence alone;
2. the shorter lengths, longest first, go to the smallest gap that holds them, else to new sequences.

The decision is a list of intervals "ranks a..b of length l go to sequences s.. at offset o" (a function
of the histogram alone).  Spark then ranks the pieces of each length with per-partition counters and a
prefix sum over partitions, and every task looks its pieces' ranks up in the intervals.  Nothing but the
histogram reaches the driver and no length, however frequent, gathers in one task.

Defined results: null text is empty; an empty document is one piece that holds only the end id; repeated
rows are packed once each; a null ``doc_id`` is carried along; an empty table gives no rows.
"""
from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flankwear.llm.common import slices, stage

CACHE = 160_000          # distinct chunks a worker keeps in each of two generations


#: Printable stand-ins of bytes in byte-level vocabularies: visible Latin-1 characters stand for themselves, the others
#: for U+0100 on, in order.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_IN = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_VISIBLE}))}
#: Marks behind a word; not the apostrophe, which starts contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKS_B = _MARKS.encode()


class ChunkCache(dict):
    """Token ids (little-endian bytes) of white-space chunks; the pre-tokeniser never joins two chunks.

    Most chunks are one word of Latin letters and perhaps some marks behind it: the pre-tokeniser's two parts,
    which go straight to the vocabulary model.  All others are encoded by the tokeniser itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.whole, self.older = Tokenizer.from_file(path), {}
        self.parts = self.whole.model.tokenize if _is_word_bpe(self.whole) else None

    def _encode(self, chunk: bytes) -> bytes:
        ids = self.whole.encode(chunk.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _letters(self, word: str) -> bytes:
        return array("I", [t.id for t in self.parts(word)]).tobytes()

    def _find(self, chunk: bytes) -> bytes:
        if self.parts is None:
            return self._encode(chunk)
        stem = chunk.rstrip(_MARKS_B)
        if len(stem) < len(chunk):       # letters and marks are parts of their own
            if not stem:
                return self._encode(chunk)
            text = stem.decode("utf-8", "surrogatepass")
            word = text.isalpha() and max(text) < "\u0250" and text.lower().isalpha()
            return self[stem] + self[chunk[len(stem):]] if word else self._encode(chunk)
        if chunk.isalpha():              # ASCII letters, lower case unless the text holds "<|"
            return self._letters(chunk.decode().lower())
        text = chunk.decode("utf-8", "surrogatepass")
        if text.isalpha() and max(text) < "\u0250" and (low := text.lower()).isalpha():
            return self._letters(low.encode().decode("latin-1").translate(_STAND_IN))
        return self._encode(chunk)

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self._find(chunk)
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[chunk] = found
        return found


def _is_word_bpe(tokenizer) -> bool:
    """Whether the tokeniser lower-cases, splits letters from marks and is byte-level, so that the short way holds."""
    import json
    spec = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"]
            and split[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})


_CACHES: dict[str, ChunkCache] = {}


def token_bytes(text: str | None, cache: ChunkCache) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if b"<|" not in raw:     # special tokens are matched before lower-casing
        raw = raw.lower()    # ASCII only: commutes with the tokeniser's own normalisation, fewer distinct chunks
    return b"".join(map(cache.__getitem__, raw.split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; (part, nth) numbers the pieces of a length in each partition."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _CACHES.get(tokenizer) or _CACHES.setdefault(tokenizer, ChunkCache(tokenizer))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            row, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                buf = memoryview(token_bytes(text, cache) + end)
                for p, a in enumerate(range(0, len(buf), 4 * capacity)):
                    body = buf[a:a + 4 * capacity]
                    n = len(body) // 4
                    row.append(i), piece.append(p), start.append(a // 4), length.append(n)
                    crc.append(zlib.crc32(body)), nth.append(int(seen[n]))
                    seen[n] += 1
                    if with_ids:
                        ids.append(np.frombuffer(body, "<u4").astype(np.int32))
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(cols, names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, "
                                "nth bigint" + (", ids array<int>" if with_ids else ""))


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, ranks, first sequence, offset) for a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []                                # sizes of open gaps, ascending
    bins: dict[int, list[tuple[int, int]]] = {}         # gap -> runs of sequences (first, how many)
    opened = 0

    def put(n: int, k: int, first: int, offset: int) -> None:
        out.append((n, used[n], k, first, offset))
        used[n] += k
        left[n] -= k

    def leave(gap: int, first: int, k: int) -> None:
        if gap:
            if gap not in bins:
                bisect.insort(gaps, gap)
                bins[gap] = []
            bins[gap].append((first, k))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            mates = large[:bisect.bisect_right(large, min(n, capacity - n))]
            m = next((m for m in reversed(mates) if left[m] >= 1 + (m == n)), None)
            k = left[n] if m is None else left[n] // 2 if m == n else min(left[n], left[m])
            put(n, k, opened, 0)
            if m is not None:
                put(m, k, opened, n)
            leave(capacity - n - (m or 0), opened, k)
            opened += k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                first, k = bins[gap].pop()
                if k > left[n]:
                    bins[gap].append((first + left[n], k - left[n]))
                    k = left[n]
                if not bins[gap]:
                    del bins[gap], gaps[at]
                put(n, k, first, capacity - gap)
                leave(gap - n, first, k)
            else:                                       # fill new sequences with this length alone
                each = min(capacity // n, left[n])
                k = left[n] // each
                for j in range(each):
                    put(n, k, opened, j * n)
                leave(capacity - each * n, opened, k)
                opened += k
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
         plan: Callable[[dict[int, int], int], list] = plan_sequences) -> DataFrame:
    """Pack all documents (doc_id, text): one row per piece with its sequence_id and offset there.

    ``with_ids`` adds the piece's token ids.  The tokeniser file's path must exist on the executors.
    """
    cut = stage(pieces(docs, tokenizer, capacity, end_id, with_ids))
    per_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "base")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(sorted(plan(counts, capacity)) or np.empty((0, 5)), np.int64)     # at most ``capacity`` lengths
    lengths, ranks, _, firsts, places = runs.T.copy()
    begin = np.searchsorted(lengths, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("base").to_numpy() + batch.column("nth").to_numpy()
            run = np.empty(len(n), np.int64)
            for v in np.unique(n):
                at = n == v
                run[at] = begin[v] + np.searchsorted(ranks[begin[v]:begin[v + 1]], rank[at], "right") - 1
            keep = [c for c in batch.schema.names if c not in ("part", "nth", "base")]
            yield pa.record_batch([batch.column(c) for c in keep] + [pa.array(firsts[run] + rank - ranks[run]),
                                                                     pa.array(places[run])], [*keep, "sequence_id", "offset"])

    names = [c for c in cut.columns if c not in ("part", "nth")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return (cut.join(offsets, ["length", "part"]).select(*names, "part", "nth", "base")
            .mapInArrow(place, schema + ", sequence_id bigint, offset bigint"))
