"""Suffix-array removal of long repeated byte strings.

The suffix array of a text is built by linear grouping (Baier, 2016): suffixes are grouped by first
byte; groups are processed in descending order, each suffix finds its previous smaller one over the
pointers found so far, and what many of a group point to moves behind the rest of its own group; in
the end groups hold suffixes with equal Lyndon prefix, and one ascending sweep emits each group's order
without renaming. Many short texts are sorted at once, each at its own group, so that a step is a few
numpy operations.

A corpus is cut so that equal strings meet: every window of `width` bytes belongs to the place of its
smallest hashed 32 bytes (the leftmost at ties) and to a run of at most `RUN` windows by its distance to
that place. Equal windows lie in equal runs, and all windows of a run share a core. Only cores that occur
more than once matter. Of segments (a run's windows together) that are equal, one is sorted; a group of
unlike segments with an equal core is one text of the suffix array. Suffixes in it that agree over
`width` bytes are neighbours there, and their bytes are compared. Segments are told apart by 128 bits of hash
beside the 64 of their core. A group over `GROUP` segments is dealt anew window by window, which
is the same question for a core as long as the window and needs no sorting; so no group is unbounded.

Null text is empty: nothing removed. A very long text is cut by one task and needs memory in proportion;
its segments are sorted with those of other texts. Repeated rows are documents of their own, so their text repeats.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import doc_input, row_key, staged, unstage

GRAM, RUN, GROUP = 32, 128, 24
#: Low bits of a hash that hold a place.
PLACE = 31
#: Bytes of text that are sorted at once.
BATCH = 1 << 20
#: Rows of a record batch that goes out.
ROWS = 4096


def suffix_arrays(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix arrays of many texts of small positive integers, in one array of places.

    Returns (order, offsets): order[offsets[t]:offsets[t + 1]] are the places of text t (counted in the
    concatenation of all, each with a 0 behind it) in ascending order of suffixes.
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    n = int(offsets[-1])
    if not n:
        return np.empty(0, np.int64), offsets
    if n > np.iinfo(np.int32).max:
        raise ValueError("too much text for one suffix array")
    s = np.zeros(n, np.int32)
    for t, a in zip(texts, offsets[:-1].tolist(), strict=True):
        s[a : a + len(t)] = t
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    key = text * np.int64(int(s.max()) + 1) + s
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).astype(np.int32)
    del key, s
    group, seat, size = np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(n, np.int32)
    group[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    seat[order] = np.arange(n)
    size[heads] = np.diff(np.append(heads, n))
    previous = np.full(n, -1, np.int32)
    begin, top, parents = offsets[:-1], offsets[1:].copy(), np.zeros(n, bool)
    live = np.flatnonzero(top > begin)
    while len(live):
        g = group[order[top[live] - 1]]
        many = top[live] - g
        top[live] = g
        live = live[g > begin[live]]
        # Members of all these groups.
        seats = np.repeat(g - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        member = order[seats]
        mine = np.repeat(g, many)
        first = begin[text[member]]
        j = member - 1
        walk = np.arange(len(member))
        while len(walk):
            at = j[walk]
            ok = at >= first[walk]
            walk, at = walk[ok], at[ok]
            higher = group[at] > mine[walk]
            walk = walk[higher]
            j[walk] = previous[at[higher]]
        j[j < first] = -1
        previous[member] = j
        # Pointers within the group lead on to what those point to.
        while True:
            same = np.flatnonzero(j >= 0)
            same = same[group[j[same]] == mine[same]]
            if not len(same):
                break
            j[same] = previous[j[same]]
            previous[member] = j
        j = j[j >= 0]
        if not len(j):
            continue
        parent, times = np.unique(j, return_counts=True)
        old = group[parent]
        by = np.lexsort((times, old))
        parent, times, old = parent[by], times[by], old[by]
        start = np.concatenate(([True], old[1:] != old[:-1]))
        block = np.cumsum(start) - 1
        count = np.bincount(block)
        head = old[start]
        tail = (head + size[head] - count)[block] + np.arange(len(parent)) - (np.cumsum(count) - count)[block]
        parents[parent] = True
        there = order[tail]
        moved = there[~parents[there]]
        left = seat[parent]
        vacated = np.sort(left[left < (head + size[head] - count)[block]])
        order[vacated], seat[moved] = moved, vacated
        order[tail], seat[parent] = parent, tail
        parents[parent] = False
        begins = start | np.concatenate(([True], times[1:] != times[:-1]))
        names = tail[np.flatnonzero(begins)]
        which = np.cumsum(begins) - 1
        size[head] -= count
        size[names] = np.bincount(which)
        group[parent] = names[which]
    return _emit(group, previous, offsets), offsets


def _emit(group: np.ndarray, previous: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The order of suffixes from their groups and previous smaller suffixes: an ascending sweep puts the
    suffix in front of each place, and its chain of previous ones, next in their groups."""
    n = len(group)
    out, done, free = np.full(n, -1, np.int32), np.zeros(n, bool), np.arange(n, dtype=np.int32)
    begin, end = offsets[:-1], offsets[1:]
    live = np.flatnonzero(end > begin)
    sweep = begin.copy()
    last = end[live] - 1  # the 0 behind each text is its smallest suffix
    out[begin[live]], done[last] = last, True
    free[begin[live]] += 1
    at = last - 1
    while len(live):
        ok = at >= begin[live]
        ok[ok] = ~done[at[ok]]
        put = at[ok]
        g = group[put]
        out[free[g]] = put
        free[g] += 1
        done[put] = True
        at[ok] = previous[put]
        stop = np.flatnonzero(~ok)
        if len(stop):
            texts = live[stop]
            sweep[texts] += 1
            more = sweep[texts] < end[texts]
            at[stop[more]] = out[sweep[texts[more]]] - 1
            if not more.all():
                keep = np.ones(len(live), bool)
                keep[stop[~more]] = False
                live, at = live[keep], at[keep]
    return out


def repeated_windows(groups: list[list[bytes]], width: int) -> list[list[np.ndarray]]:
    """For groups of segments: starts of the windows of each segment that occur elsewhere in its group."""
    texts = [np.frombuffer(b"\0".join(g), np.uint8).astype(np.int32) + 2 for g in groups]
    for t, g in zip(texts, groups, strict=True):
        ends = np.cumsum([len(x) + 1 for x in g])[:-1] - 1
        t[ends] = 1
    order, offsets = suffix_arrays(texts)
    raw = np.concatenate([np.append(t - 2, 0) for t in texts]).clip(0, 255).astype(np.uint8)
    room = np.zeros(len(raw), bool)  # places whose window lies within one segment
    for t, g in zip(offsets[:-1].tolist(), groups, strict=True):
        for x in g:
            room[t : t + max(0, len(x) - width + 1)] = True
            t += len(x) + 1
    hit = np.zeros(len(raw), bool)
    ranked = order[room[order]]
    if len(ranked) > 1:
        view = np.lib.stride_tricks.sliding_window_view(raw, width)
        text = np.searchsorted(offsets, ranked, side="right")
        pairs = np.flatnonzero(text[1:] == text[:-1])
        # Two probes first: few neighbours agree.
        for probe in (width - 1, width // 2):
            pairs = pairs[raw[ranked[pairs] + probe] == raw[ranked[pairs + 1] + probe]]
        for at in range(0, len(pairs), 8192):
            p = pairs[at : at + 8192]
            p = p[(view[ranked[p]] == view[ranked[p + 1]]).all(axis=1)]
            hit[ranked[p]] = hit[ranked[p + 1]] = True
    out = []
    for t, g in zip(offsets[:-1].tolist(), groups, strict=True):
        mine = []
        for x in g:
            mine.append(np.flatnonzero(hit[t : t + max(0, len(x) - width + 1)]))
            t += len(x) + 1
        out.append(mine)
    return out


def runs_of(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of windows of one text: (place of the gram, first window, last window)."""
    n = len(raw) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    b = np.frombuffer(raw + bytes(8), np.uint8)
    lanes = np.lib.stride_tricks.as_strided(b, (len(raw) + 1, 8), (1, 1)).copy().view("<u8")[:, 0]
    m = len(raw) - GRAM + 1
    h = lanes[:m] * np.uint64(0x9E3779B97F4A7C15)
    for i, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(29)
        h += lanes[i : i + m]
        h *= np.uint64(c)
    h ^= h >> np.uint64(32)
    # Sliding minimum over `span` grams, by minima from both ends of blocks. The low bits are the place,
    # so that equal hashes go to the leftmost.
    h = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(m, dtype=np.uint64)
    span = width - GRAM + 1
    grid = np.concatenate((h, np.full(-m % span, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    away = (at - np.arange(n)) // RUN
    cut = np.concatenate(([True], (at[1:] != at[:-1]) | (away[1:] != away[:-1])))
    first = np.flatnonzero(cut)
    return at[first], first, np.append(first[1:], n) - 1


def _items(docs: DataFrame, width: int) -> DataFrame:
    """(doc, key, seg, seg2, first, last) of every run: hashes of its core (64 bits) and of its segment (128)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest
        from xxhash import xxh3_128_digest as long_digest

        for b in batches:
            docs_, keys, segs, firsts, lasts = [], [], [], [], []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes()
                at, first, last = runs_of(raw, width)
                if not len(at):
                    continue
                q = (at - first) // RUN
                begin = at - RUN * q
                core = width - RUN + 1
                keys += [digest(raw[c : c + core], k) for c, k in zip(begin.tolist(), q.tolist(), strict=True)]
                segs += [long_digest(raw[a : e + width]) for a, e in zip(first.tolist(), last.tolist(), strict=True)]
                docs_.append(np.full(len(at), doc, np.int64))
                firsts.append(first)
                lasts.append(last)
            if keys:
                two = np.frombuffer(b"".join(segs), "<i8").reshape(-1, 2)
                cols = (np.concatenate(docs_), np.array(keys, np.uint64).view(np.int64), two[:, 0].copy(), two[:, 1].copy(), np.concatenate(firsts).astype(np.int32), np.concatenate(lasts).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc", "key", "seg", "seg2", "first", "last"])

    return docs.mapInArrow(run, "doc long, key long, seg long, seg2 long, first int, last int")


def _cut_out(asked: DataFrame, width: int) -> DataFrame:
    """Segments of the rows (text, wanted) of documents."""

    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "large", "doc", "first", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text, wanted in zip(b.column("doc").to_pylist(), b.column("text"), b.column("wanted"), strict=True):
                raw = text.as_buffer().to_pybytes()
                for at in range(0, len(wanted.values), ROWS):
                    some = wanted.values.slice(at, ROWS)
                    key, large, first, last = (some.field(c).to_pylist() for c in ("key", "large", "first", "last"))
                    rows += [(k, g, doc, a, raw[a : e + width]) for k, g, a, e in zip(key, large, first, last, strict=True)]
                    if len(rows) >= ROWS:
                        yield out(rows)
                        rows = []
            if rows:
                yield out(rows)

    return asked.select("doc", "text", "wanted").mapInArrow(run, "key long, large boolean, doc long, first int, segment binary")


SPANS = "doc long, begin int, end int"


def _spans(rows: list[tuple[int, np.ndarray]], width: int) -> pa.RecordBatch:
    """Stretches of bytes that windows (document, starts) cover."""
    docs, begins, ends = [], [], []
    for doc, starts in rows:
        if len(starts):
            gap = np.flatnonzero(np.diff(starts) > width)
            a, e = np.append(starts[0], starts[gap + 1]), np.append(starts[gap], starts[-1]) + width
            docs += [doc] * len(a)
            begins += a.tolist()
            ends += e.tolist()
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["doc", "begin", "end"])


def _sorted_groups(segments: DataFrame, width: int) -> DataFrame:
    """Spans of windows that occur elsewhere in their group, by suffix arrays."""

    def solve(held: list[tuple[list[bytes], list[tuple[int, int]]]]) -> Iterator[pa.RecordBatch]:
        # Texts of a like size are sorted together.
        held.sort(key=lambda g: sum(map(len, g[0])))
        at = 0
        while at < len(held):
            end, total = at, 0
            largest = sum(map(len, held[at][0]))
            while end < len(held) and total < BATCH and (end - at < 8 or sum(map(len, held[end][0])) <= 2 * largest):
                total += sum(map(len, held[end][0]))
                end += 1
            found = repeated_windows([g for g, _ in held[at:end]], width)
            yield _spans([(doc, first + w) for (_, refs), ws in zip(held[at:end], found, strict=True) for (doc, first), w in zip(refs, ws, strict=True)], width)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[bytes], list[tuple[int, int]]]] = []
        key, size = None, 0
        for b in batches:
            for k, doc, first, seg in zip(b.column("key").to_pylist(), b.column("doc").to_pylist(), b.column("first").to_pylist(), b.column("segment").to_pylist(), strict=True):
                if k != key:
                    if size > BATCH:
                        yield from solve(held)
                        held, size = [], 0
                    held.append(([], []))
                    key = k
                held[-1][0].append(seg)
                held[-1][1].append((doc, first))
                size += len(seg)
        if held:
            yield from solve(held)

    return segments.select("key", "doc", "first", "segment").repartition("key").sortWithinPartitions("key", "doc", "first").mapInArrow(run, SPANS)


def _dealt_groups(segments: DataFrame, width: int) -> DataFrame:
    """The same for groups over GROUP: windows meet by 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for b in batches:
            windows, docs, begins = [], [], []
            for doc, first, seg in zip(b.column("doc").to_pylist(), b.column("first").to_pylist(), b.column("segment").to_pylist(), strict=True):
                n = len(seg) - width + 1
                windows += [digest(seg[i : i + width]) for i in range(n)]
                docs += [doc] * n
                begins += range(first, first + n)
                if len(windows) >= 4 * ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(docs, pa.int64()), pa.array(begins, pa.int32())], ["window", "doc", "begin"])
                    windows, docs, begins = [], [], []
            if windows:
                yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(docs, pa.int64()), pa.array(begins, pa.int32())], ["window", "doc", "begin"])

    rows = segments.select("doc", "first", "segment").mapInArrow(run, "window binary, doc long, begin int")
    again = rows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return rows.join(again, "window", "left_semi").select("doc", "begin", (F.col("begin") + width).alias("end"))


def repeated_spans(docs: DataFrame, width: int = 400) -> DataFrame:
    """(doc, begin, end) stretches of bytes covered by windows that occur more than once. docs: rows
    (doc, text), where rows of one doc are equal."""
    every = staged(_items(docs, width), "runs")
    # Written first, so that the join below has plain exchanges on both sides and AQE can split a hot core.
    again = staged(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated_keys")
    items = staged(every.join(again, "key", "left_semi"), "repeated_runs")
    unstage(every, again)
    unlike = items.groupBy("key", "seg", "seg2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "last")).alias("r"))
    unlike = staged(unlike, "segments")
    whole = items.join(unlike.where("n > 1").select("key", "seg", "seg2"), ["key", "seg", "seg2"], "left_semi").select("doc", F.col("first").alias("begin"), (F.col("last") + width).alias("end"))
    several = unlike.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    wanted = unlike.join(several, "key").select("r.doc", F.struct("key", (F.col("m") > GROUP).alias("large"), "r.first", "r.last").alias("w")).groupBy("doc").agg(F.collect_list("w").alias("wanted"))
    segments = staged(_cut_out(docs.join(wanted, "doc"), width), "unlike")
    return whole.unionByName(_sorted_groups(segments.where("not large"), width)).unionByName(_dealt_groups(segments.where("large"), width))


def dedup(docs: DataFrame, width: int = 400, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with texts also `kept` (binary) and
    `spans` (array of begin and end)."""
    rows = doc_input(docs).select("doc_id", "text", row_key().alias("doc"))
    spans = repeated_spans(rows.select("doc", "text"), width).groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("s"))
    more = ", kept binary, spans array<struct<begin: long, end: long>>" if texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, s in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("s"), strict=True):
                raw = text.as_buffer().to_pybytes()
                cut = joined(*(s.values.field(c).to_numpy() for c in ("begin", "end"))) if s.is_valid else []
                kept = b"".join(raw[a:e] for a, e in zip([0, *(e for _, e in cut)], [*(a for a, _ in cut), len(raw)], strict=True))
                row = (doc, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, [{"begin": a, "end": e} for a, e in cut]) if texts else row)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

    return rows.join(spans, "doc", "left").select("doc_id", "text", "s").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)


def joined(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """merged() of many spans."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return list(zip(begin[np.append(0, fresh)].tolist(), end[np.append(fresh, len(end)) - 1].tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out
