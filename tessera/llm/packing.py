"""Best-fit packing of tokenized documents into sequences by bin completion.

Only lengths matter for a packing, and there are no more than `size` of them: tasks tokenize texts and
count lengths, the driver packs the histogram, and every piece finds its place from its rank among the
pieces of its length. The packing is branch-and-bound over bins: the largest piece left opens a bin, the
undominated fillings of what remains, of any number of pieces, are made one by one in order of waste, a
branch ends where its waste is beyond what fewer bins than the incumbent's leave, and best-fit decreasing
gives the first incumbent. A filling is first used as often as its lengths allow at once, then once, so that
the plan has a few rows for each length, whatever the number of documents, and no packing is out of
reach. The search ends with a packing that meets the lower bound (Martello and Toth's L2), when nothing
is left to try, or after `NODES` fillings, the one limit there is; `bound` and `plan` tell the gap.

A document is its ids and an end id. Only longer ones than `size` are cut, into pieces of `size` ids,
the first piece being the shorter one. Null and empty texts are the end id alone. Repeated rows are
packed each; very long texts are tokenized whole by one task; an empty table gives an empty result; extra
columns are not read. Ids come from an engine that is faster than the `tokenizers` library; the first text of
each Arrow batch goes through the library as well, and unlike ids are an error.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import doc_input, staged

END = 2
#: Fillings made by the search after which the incumbent is taken.
NODES = 4000


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a bin, number of such bins)."""
    left = Counter({k: v for k, v in counts.items() if v > 0})
    out = []
    while left:
        bin_, room = [], size
        used: Counter[int] = Counter()
        while True:
            # For the bin just opened, the piece that fits best is the largest that still fits.
            fit = max((k for k in left if k <= room and left[k] > used[k]), default=None)
            if fit is None:
                break
            n = min(room // fit, left[fit] - used[fit])
            bin_ += [fit] * n
            used[fit] += n
            room -= n * fit
        times = min(left[k] // n for k, n in used.items())
        out.append((tuple(bin_), times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether filling a's pieces can be put into the places of b's pieces (so b is as good)."""
    room = sorted(b)
    for x in sorted(a, reverse=True):
        fit = next((i for i, r in enumerate(room) if r >= x), None)
        if fit is None:
            return False
        room[fit] -= x
        room.sort()
    return True


def bound(counts: dict[int, int], size: int) -> int:
    """Lower bound on the bins: the best of L2 over all thresholds, the total length among them."""
    n = np.zeros(size + 2, np.int64)
    for k, v in counts.items():
        n[k] = v
    mass = n * np.arange(size + 2)
    many, much = np.cumsum(n), np.cumsum(mass)
    half, best = size // 2, 0
    for t in range(half + 1):
        # Pieces over half a bin each need one; those of t up to half go into what is left beside the
        # ones of at most size - t, or into further bins.
        large = int(many[size] - many[half])
        beside = int(many[size - t] - many[half])
        room = beside * size - int(much[size - t] - much[half])
        small = int(much[half] - (much[t - 1] if t else 0))
        best = max(best, large + max(0, -(-(small - room) // size)))
    return best


def fillings(left: dict[int, int], room: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of the room by pieces of `left`, least waste first, larger pieces first."""
    lengths = sorted((k for k, v in left.items() if k <= room and v), reverse=True)
    if not lengths or lengths[0] == room:  # one piece that fits exactly dominates all others
        yield tuple(lengths[:1])
        return
    # Bit x of reach[i]: pieces of lengths[i:] can fill x.
    reach, full = [1] * (len(lengths) + 1), (1 << (room + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        k, sums = lengths[i], reach[i + 1]
        for _ in range(min(left[k], room // k)):
            more = sums | (sums << k) & full
            if more == sums:
                break
            sums = more
        reach[i] = sums

    def exact(i: int, target: int) -> Iterator[tuple[int, ...]]:
        if not target:
            yield ()
            return
        while reach[i] >> target & 1:
            k = lengths[i]
            i += 1
            for n in range(min(left[k], target // k), 0, -1):
                if reach[i] >> (target - n * k) & 1:
                    for rest in exact(i, target - n * k):
                        yield (k,) * n + rest

    seen: list[tuple[int, ...]] = []
    for total in range(room, 0, -1):
        if reach[0] >> total & 1:
            for f in exact(0, total):
                # The latest ones are the most alike.
                if any(_dominated(f, g) for g in seen[:-33:-1]):
                    yield ()  # a step of the search, and no filling
                else:
                    seen.append(f)
                    yield f


class Branch(NamedTuple):
    """A node of the search: pieces left, their total length, bins so far (linked) and their number, and
    what is still to try: (filling, whether as often as it goes)."""

    left: dict[int, int]
    total: int
    trail: tuple | None
    n: int
    tries: Iterator[tuple[tuple[int, ...], bool]]


def plan(counts: dict[int, int], size: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Bins (lengths, times) for a histogram of lengths at most size, as few as the search finds."""
    counts = {int(k): int(v) for k, v in counts.items() if v > 0}
    if not counts:
        return []
    need = bound(counts, size)
    incumbent = best_fit(counts, size)
    least = sum(n for _, n in incumbent)
    seen: set[int] = set()

    def branch(left: dict[int, int], total: int, trail: tuple | None, n: int) -> Branch:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1

        def tries() -> Iterator[tuple[tuple[int, ...], bool]]:
            for f in fillings(rest, size - largest):
                if f or largest == size or not any(v and k <= size - largest for k, v in rest.items()):
                    yield (largest, *f), True
                    if left[largest] > 1:
                        yield (largest, *f), False
                else:
                    yield (), False

        return Branch(left, total, trail, n, tries())

    stack = [branch(counts, sum(k * v for k, v in counts.items()), None, 0)]
    while stack and least > need and nodes > 0:
        nodes -= 1
        b = stack[-1]
        bin_, often = next(b.tries, (None, False))
        if bin_ is None:
            stack.pop()
            continue
        if not bin_:
            continue
        used = Counter(bin_)
        if b.total + size - sum(bin_) > (least - 1 - b.n) * size:  # fillings only get more wasteful
            stack.pop()
            continue
        times = min(b.left[k] // m for k, m in used.items())
        if not often:
            if times == 1:
                continue
            times = 1
        left = {k: v for k in b.left if (v := b.left[k] - used.get(k, 0) * times)}
        n, trail, total = b.n + times, (b.trail, (bin_, times)), b.total - times * sum(bin_)
        if not left:
            if n < least:
                least, incumbent = n, []
                while trail is not None:
                    trail, bin_ = trail
                    incumbent.append(bin_)
            continue
        mark = hash((n, *sorted(left.items())))
        if n + -(-total // size) < least and mark not in seen:
            seen.add(mark)
            stack.append(branch(left, total, trail, n))
    return incumbent


class Tokenizer:
    """Ids as the `tokenizers` library gives them for a byte-level BPE file, through the faster engine
    of the same vocabulary; texts that hold a special token's string go through the library itself."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(json_path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.engine = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


    def check(self, text: str) -> None:
        """An error if the library gives other ids."""
        if self.library.encode(text, add_special_tokens=False).ids != self.ids(text).tolist():
            raise ValueError("the two engines of this vocabulary give unlike ids")


_TOKENIZERS: dict[tuple, Tokenizer] = {}


def tokenizer(json_path: str, ranks_path: str, pattern: str) -> Tokenizer:
    key = (json_path, ranks_path, pattern)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(*key)
    return _TOKENIZERS[key]


class Placed(NamedTuple):
    """For every length, where runs of ranks go; ascending by (length, first rank)."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def placed(bins: list[tuple[tuple[int, ...], int]]) -> Placed:
    seen: Counter[int] = Counter()
    rows, base = [], 0
    for lengths, times in bins:
        at = 0
        for k, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append((k, seen[k], n, base, at))
            seen[k] += n * times
            at += k * n
        base += times
    rows.sort()
    return Placed(*(np.array(c, np.int64) for c in zip(*rows, strict=True))) if rows else Placed(*(np.empty(0, np.int64),) * 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def pieces(docs: DataFrame, tokens: tuple[str, str, str], size: int) -> DataFrame:
    """Pieces of all documents; local is a piece's rank among those of its length in its partition (part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, t = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), tokenizer(*tokens)
        for b in batches:
            rows: list[tuple] = []
            if b.num_rows:
                t.check(b.column("text")[0].as_py())
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = np.append(t.ids(text.as_py()), np.uint32(END)).astype("<u4", copy=False).tobytes()
                n = len(raw) // 4
                first = n % size or size
                starts = [0, *range(first, n, size)]
                for i, a in enumerate(starts):
                    e = starts[i + 1] if i + 1 < len(starts) else n
                    rows.append((doc, i, a, e - a, zlib.crc32(raw[4 * a : 4 * e]), part, int(seen[e - a])))
                    seen[e - a] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return doc_input(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokens: tuple[str, str, str], size: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    rows = staged(pieces(docs, tokens, size), "pieces")
    parts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    # At most `size` rows.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = placed(plan(counts, size))
    span = 1 << 40

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = where.length * span + where.first
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, length * span + rank, side="right") - 1
            r = rank - where.first[i]
            sequence, offset = where.sequence[i] + r // where.copies[i], where.offset[i] + r % where.copies[i] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rows.join(parts.select("part", "length", "base"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
