"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart share a variant at most r bits from each, and two that share
such a variant are at most 2r bits apart. So every distinct fingerprint emits all variants within half
the radius and fingerprints meet on equal variants. A variant's place is decided by some of its bits:
fingerprints are dealt to all places their variants can have (one row for each place instead of one
for each variant), and a place makes the variants that belong to it, sorts them, and links what shares
one to the least fingerprint there. Places grow in number with the table, so that one of them makes
about `place_variants` variants at any size; it makes them in blocks where there are more. A place that gets
`HEAVY` times the mean (a dense family) is dealt again by `MORE` further bits, until none is left. Sending the
variants themselves would take 2081 rows for each fingerprint; a place's share of them is made where it is.

Null, empty and blank texts have fingerprint zero and are linked like any other. Exact copies share
one fingerprint and are never paired; repeated rows get one result row each. An empty table gives an
empty result; extra columns are not read. Very long texts are hashed whole by one task, in memory in proportion.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import components, doc_input, row_key, staged

SEED = 42
#: Load of a place, in mean loads, from which on it is dealt again, and bits for that.
HEAVY, MORE = 4, 6


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and splits at the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, doc, fp) of every row; doc is its key, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc"), pa.array(fps.view(np.int64))], ["doc_id", "doc", "fp"])

    return doc_input(docs).withColumn("doc", row_key()).mapInArrow(run, "doc_id long, doc long, fp long")


def _flips(bits: list[int], most: int) -> list[tuple[int, int]]:
    """(mask, number of flips) for all choices of at most `most` of the bits."""
    out = [(0, 0)]
    for b in bits:
        out += [(m | (1 << b), k + 1) for m, k in out if k < most]
    return out


def _collide(fps: np.ndarray, left: np.ndarray, bits: list[int], radius: int, block: int) -> np.ndarray:
    """Pairs (least, other) of fingerprints that share a variant; each may flip left[i] of the bits."""
    made = sum(math.comb(len(bits), k) * int((left >= k).sum()) for k in range(radius + 1))
    if made > block and bits:
        first, rest, pairs = bits[-1], bits[:-1], []
        mine = (fps >> np.uint64(first)) & np.uint64(1)
        for side in (0, 1):
            off = (mine != side).astype(left.dtype)
            ok = left >= off
            pairs.append(_collide(fps[ok], (left - off)[ok], rest, radius, block))
        return np.unique(np.concatenate(pairs), axis=0)
    flips, values, owners = _flips(bits, radius), [], []
    known = np.uint64(sum(1 << b for b in bits))
    for k in range(radius + 1):
        masks = np.array([m for m, n in flips if n == k], np.uint64)
        who = np.flatnonzero(left >= k)
        values.append(((fps[who] & known)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(who.astype(np.int32), len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    again = np.flatnonzero(value[1:] == value[:-1])
    if not len(again):
        return np.empty((0, 2), np.uint64)
    fresh = np.concatenate(([True], value[1:] != value[:-1]))
    group = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(fps[owner], np.flatnonzero(fresh))
    hit = np.zeros(len(value), bool)
    hit[again], hit[again + 1] = True, True
    a, b = least[group[hit]], fps[owner[hit]]
    return np.unique(np.stack([a, b], axis=1)[a != b], axis=0)


def near_pairs(distinct: DataFrame, radius: int = 2, place_variants: int = 1 << 21) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most 2 * radius bits apart: all that share
    a variant at a place are linked to the least one there, so that reachability is whole while the rows
    stay linear in fingerprints and places. Checked and without repeats."""
    stats = distinct.agg(F.count("*"), *(F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))) for i in range(64))).first()
    n = stats[0]
    ball = sum(math.comb(64, k) for k in range(radius + 1))
    p = min(40, max(4, math.ceil(math.log2(max(1, n * ball / place_variants)))))
    # Bits near one half spread fingerprints over places best.
    by_balance = sorted(range(64), key=lambda i: (abs(2 * (stats[i + 1] or 0) - n), i))
    most = max(1, int(HEAVY * n * len(_flips(by_balance[:p], radius))) >> p)
    rows = distinct.select(F.lit(0).cast("long").alias("place"), "fp", F.lit(radius).cast("byte").alias("left"))
    found, done = [], 0
    while True:
        rows = _deal(rows, by_balance[done : done + p], radius)
        done, p = done + p, min(MORE, 64 - done - p)
        heavy = staged(rows.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > most).select("place"), "heavy_places") if p > 0 else None
        if heavy is None or heavy.isEmpty():
            found.append(_meet(rows, by_balance[done:], radius, place_variants))
            break
        found.append(_meet(rows.join(heavy, "place", "left_anti"), by_balance[done:], radius, place_variants))
        rows = staged(rows.join(heavy, "place", "left_semi"), "heavy_rows")
    met = functools.reduce(DataFrame.unionByName, found).distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * radius)


def _deal(rows: DataFrame, bits: list[int], radius: int) -> DataFrame:
    """Rows (place, fp, left) sent on to all places their variants can have by these bits, too; left: how many
    more bits a variant may differ in."""
    flips = _flips(bits, radius)
    masks, used = np.array([m for m, _ in flips], np.uint64), np.array([k for _, k in flips], np.int8)
    chosen = np.uint64(sum(1 << b for b in bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                fps, held = (some.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "place"))
                left = some.column("left").to_numpy(zero_copy_only=False)[:, None] - used[None, :]
                place = (fps & chosen)[:, None] ^ masks[None, :] | held[:, None]
                ok = left >= 0
                yield pa.RecordBatch.from_arrays([pa.array(place[ok].view(np.int64)), pa.array(np.broadcast_to(fps[:, None], ok.shape)[ok].view(np.int64)), pa.array(left[ok])], ["place", "fp", "left"])

    return rows.mapInArrow(deal, "place long, fp long, left byte")


def _meet(rows: DataFrame, bits: list[int], radius: int, place_variants: int) -> DataFrame:
    """Links of each place, whose variants may differ in these bits."""
    bits = sorted(bits)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = _collide(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["left"].to_numpy(np.int8), bits, radius, 2 * place_variants)
        return pd.DataFrame({"a": pairs[:, 0].astype(np.uint64).view(np.int64), "b": pairs[:, 1].astype(np.uint64).view(np.int64)})

    return rows.groupBy("place").applyInPandas(meet, "a long, b long")


def _rooted(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """clusters() with the row's key (doc) and its component's least fingerprint (root)."""
    rows = staged(fingerprints(docs, width), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_pairs(distinct.select("fp"), radius)
    roots = components(links).select(F.col("node").alias("fp"), "root")
    rooted = staged(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "component_id", "doc", "root")


def clusters(docs: DataFrame, width: int = 4, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id that can be reached
    over fingerprints at most 2 * radius bits apart. Rows with a null doc_id take part in links; a
    component of such rows only has component_id null."""
    return _rooted(docs, width, radius).select("doc_id", "fp", "component_id")


def hex_fp(column: str = "fp") -> "F.Column":
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def representatives(docs: DataFrame, width: int = 4, radius: int = 2) -> DataFrame:
    """The rows of docs (all their columns) that stand for a component: of those with its smallest doc_id
    the one with the least key; of repeated rows one stays. Rows without a doc_id can't be named and stay."""
    keep = _rooted(docs, width, radius).where("doc_id = component_id").groupBy("root").agg(F.min("doc").alias("_doc")).select("_doc")
    keyed = docs.where("doc_id is not null").withColumn("_doc", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    named = keyed.join(keep, "_doc", "left_semi").dropDuplicates(["_doc"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
