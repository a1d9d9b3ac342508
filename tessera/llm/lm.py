"""Language-model scores of documents: a causal self-attention model over subword ids, trained in numpy,
beside an add-one unigram base over words.

What is learned comes from the training rows only, from all of them: counts of words, of subwords, of buckets
after buckets and after the most frequent pairs of buckets, and attention weights from all windows of every
text. Weights are trained at once in parts of about `PART_IDS` ids and averaged by their windows, in integers,
so that the order of tasks does not matter and the session's settings do not either.

The model predicts a subword from the window's ids by attention: first its frequency class, then, by splits in
two (hierarchical softmax), the bucket of ids within the class, and the id within the bucket. Attention adds
to the logs of what the counts give: to those of classes and of splits of buckets after the context, and to
those of splits of ids in their bucket. A context is the pair of buckets before, if it is one of the `CONTEXTS`
most frequent, or else the one bucket before. All of it is trained at once. Windows of `SPAN` ids overlap by `SPAN - STRIDE`; every id is scored
once, in the first window that holds it, by one batched masked attention over the windows of many documents.

Word counts meet documents without gathering a vocabulary anywhere: the most frequent words, at most
`common` of them, are sent to the tasks, rarer ones are joined on the word, and no rare word is a hot key.

Null text counts as empty (one token, the end); a null doc_id has the remainder of the empty string;
repeated rows count and are scored each; very long texts are tokenized whole by one task and scored in
blocks of windows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import doc_input, row_key, staged, unstage
from tessera.llm.packing import tokenizer

SPAN, STRIDE = 16, 14
DIM, CLASSES, BUCKETS = 16, 32, 1024
#: Buckets of one id each (the most frequent ones); the others share the rest by mass.
OWN = 768
#: Weight of a class's own distribution in that after a bucket.
PRIOR = 4.0
#: Pairs of buckets that are contexts, and weight of a bucket's distribution in that after a pair.
CONTEXTS, PAIR_PRIOR = 8192, 12.0
#: Ids that one part trains on, about.
PART_IDS = 8_000_000
#: Ids of the vocabulary, and the id that ends a text.
IDS, STOP = 50_257, 50_256
START = BUCKETS  # embedding row in front of a text
SCALE = 1 << 24
Weights = dict[str, np.ndarray]
SHAPES = {"E": (BUCKETS + 1, DIM), "P": (SPAN, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM), "U": (DIM, CLASSES), "b": (CLASSES,)}


def fresh(seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.0 if k in "bU" else 0.1 if k in "EP" else 1 / math.sqrt(DIM), s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = x[at : at + n].reshape(s).astype(np.float32, copy=False)
        at += n
    return out


MASK = np.triu(np.full((SPAN, SPAN), -1e9, np.float32), 1)


#: Ceiling of attention scores and logits, so that no maximum has to be taken off.
TOP = np.float32(60)
SEEN = np.tril(np.ones((SPAN, SPAN), np.float32))


def times(m: np.ndarray, by: np.ndarray) -> np.ndarray:
    """m @ by with all rows of m in one product."""
    return (m.reshape(-1, m.shape[-1]) @ by).reshape(*m.shape[:-1], by.shape[1])


def passed(w: Weights, x_ids: np.ndarray, context: np.ndarray, prior: np.ndarray) -> dict[str, np.ndarray]:
    """Probabilities e of the next class at every place of windows (n, SPAN) of embedding rows, the logits z,
    and what is on the way. prior: logs of classes after each context, which attention adds to."""
    x = w["E"].take(x_ids, axis=0)
    x += w["P"]
    qkv = times(x, np.concatenate([w["Q"] / np.float32(math.sqrt(DIM)), w["K"], w["V"]], axis=1))
    q, k, v = qkv[..., :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    np.exp(np.minimum(a, TOP, out=a), out=a)
    a *= SEEN
    a /= (a @ np.ones(SPAN, np.float32))[..., None]
    o = np.matmul(a, v)
    h = x + times(o, w["O"])
    z = times(h, w["U"])
    z += w["b"]
    z += prior.take(context, axis=0)
    np.minimum(z, TOP, out=z)
    e = np.exp(z)
    total = e @ np.ones(CLASSES, np.float32)
    e /= total[..., None]
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "o": o, "h": h, "z": z, "e": e, "total": total}


def forward(w: Weights, x_ids: np.ndarray, context: np.ndarray, prior: np.ndarray) -> dict[str, np.ndarray]:
    """passed(), with z the log probabilities."""
    f = passed(w, x_ids, context, prior)
    f["z"] -= np.log(f["total"])[..., None]
    return f


def hidden(w: Weights, x_ids: np.ndarray) -> np.ndarray:
    """What attention makes of windows (n, SPAN) of embedding rows at every place: the h of forward() for scoring,
    with sums as products with ones and no pass that training alone needs."""
    x = w["E"].take(x_ids, axis=0)
    x += w["P"]
    qkv = times(x, np.concatenate([w["Q"] / np.float32(math.sqrt(DIM)), w["K"], w["V"] @ w["O"], np.zeros((DIM, 1), np.float32)], axis=1))
    q, k, v = qkv[..., :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    v[..., -1] = 1
    a = np.matmul(q, k.transpose(0, 2, 1))
    np.exp(np.minimum(a, TOP, out=a), out=a)
    a *= SEEN
    o = np.matmul(a, v)
    x += o[..., :-1] / o[..., -1:]
    return x


def class_logs(w: Weights, x_ids: np.ndarray, context: np.ndarray, classes: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log probability of the given class at every place."""
    return picked_logs(w, hidden(w, x_ids), context, classes, prior)


def picked_logs(w: Weights, h: np.ndarray, context: np.ndarray, classes: np.ndarray, prior: np.ndarray) -> np.ndarray:
    z = times(h, w["U"])
    z += w["b"]
    z += prior.take(context, axis=0)
    np.minimum(z, TOP, out=z)
    picked = np.take_along_axis(z, classes[..., None], -1)[..., 0]
    return picked - np.log(np.exp(z, out=z) @ np.ones(CLASSES, np.float32))


def run_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at `first`, by two columns at once."""
    pairs = np.ascontiguousarray(rows).view(np.complex64 if rows.dtype == np.float32 else np.complex128)
    return np.add.reduceat(pairs, first, axis=0).view(rows.dtype)


def summed(rows: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct values of by, the sums of the rows of each, and how many they are)."""
    order = np.argsort(by.astype(np.int16) if len(by) and by.max() < 1 << 15 else by, kind="stable")
    there = by[order]
    first = np.flatnonzero(np.append(True, there[1:] != there[:-1]))
    return there[first], run_sums(rows.take(order, axis=0), first), np.diff(first, append=len(by))


class Paths(NamedTuple):
    """Splits in two on the way to each leaf: leaf i has those of `start[i]` to `start[i + 1]`; `split` is their
    number and `side` 1 for the right half, -1 for the left."""

    start: np.ndarray
    split: np.ndarray
    side: np.ndarray

    def to(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index into leaves, split, side) of all splits on the way to the leaves, and their number for each."""
        first = self.start[leaves]
        n = self.start[leaves + 1] - first
        of = np.repeat(np.arange(len(leaves), dtype=np.int32), n)
        at = np.arange(len(of)) + np.repeat(first - (np.cumsum(n) - n), n)
        return of, self.split.take(at), self.side.take(at), n


def splits(low: np.ndarray, high: np.ndarray, mass: np.ndarray) -> tuple[Paths, np.ndarray]:
    """Splits of ranges of leaves (from low to before high, one after the other, all leaves in one) down to single
    leaves, in halves by mass; and (low, middle, high) of each split."""
    total, made, rows, count = np.append(0.0, np.cumsum(mass)), [], [], 0
    while True:
        wide = high - low > 1
        low, high = low[wide], high[wide]
        if not len(low):
            break
        half = (total[low] + total[high]) / 2
        middle = np.searchsorted(total, half)
        middle -= half - total[middle - 1] < total[middle] - half
        middle = np.clip(middle, low + 1, high - 1)
        made.append(np.stack([low, middle, high], axis=1))
        row, n = np.full(len(mass), -1), high - low
        leaf = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        row[leaf] = 2 * (count + np.repeat(np.arange(len(low)), n)) + (leaf >= np.repeat(middle, n))
        rows.append(row)
        count += len(low)
        low, high = np.stack([low, middle], axis=1).ravel(), np.stack([middle, high], axis=1).ravel()
    all_rows = np.array(rows, np.int64).reshape(len(rows), len(mass)).T
    way = all_rows[all_rows >= 0]
    start = np.append(0, np.cumsum((all_rows >= 0).sum(axis=1)))
    ends = np.concatenate(made) if made else np.empty((0, 3), np.int64)
    return Paths(start, (way >> 1).astype(np.int32), np.where(way & 1, 1, -1).astype(np.float32)), ends


def gradients(w: Weights, x_ids: np.ndarray, context: np.ndarray, classes: np.ndarray, prior: np.ndarray, within: "Within | None" = None) -> tuple[Weights, float]:
    """Gradients of the mean loss over places with a class (-1: none), and that loss: of classes, and of what is
    `within` them, which adds its part of the gradients of h and keeps those of its own vectors."""
    f = passed(w, x_ids, context, prior)
    there = classes >= 0
    n = max(1, int(there.sum()))
    two = lambda m: m.reshape(-1, m.shape[-1])
    rows, picked = np.arange(classes.size), np.maximum(classes, 0).ravel()
    dz = two(f["e"])
    loss = -float(((two(f["z"])[rows, picked] - np.log(f["total"]).ravel()) * there.ravel()).sum()) / n
    dz[rows, picked] -= 1
    dz *= there.ravel()[:, None] / np.float32(n)
    g: Weights = {"U": two(f["h"]).T @ dz, "b": np.ones(len(dz), np.float32) @ dz}
    dh = (dz @ w["U"].T).reshape(f["h"].shape)
    if within is not None:
        more, part = within.gradients(two(f["h"]), there.ravel(), n)
        dh += more.reshape(dh.shape)
        loss += part
    g["O"] = two(f["o"]).T @ two(dh)
    do = times(dh, w["O"].T)
    ds = np.matmul(do, f["v"].transpose(0, 2, 1))
    dqkv = np.empty((*x_ids.shape, 3 * DIM), f["x"].dtype)
    np.matmul(f["a"].transpose(0, 2, 1), do, out=dqkv[..., 2 * DIM :])
    ds -= ((do * f["o"]) @ np.ones(DIM, np.float32))[..., None]
    ds *= f["a"]
    np.matmul(ds, f["k"], out=dqkv[..., :DIM])
    np.matmul(ds.transpose(0, 2, 1), f["q"], out=dqkv[..., DIM : 2 * DIM])
    dqkv[..., :DIM] *= np.float32(1 / math.sqrt(DIM))
    dx = dh + times(dqkv, np.concatenate([w["Q"], w["K"], w["V"]], axis=1).T)
    g["Q"], g["K"], g["V"] = (np.ascontiguousarray(m) for m in np.split(two(f["x"]).T @ two(dqkv), 3, axis=1))
    g["P"] = dx.sum(axis=0)
    g["E"] = np.zeros_like(w["E"])
    rows, sums, _ = summed(two(dx), x_ids.ravel())
    g["E"][rows] = sums
    return g, loss


def train(w: Weights, x: np.ndarray, context: np.ndarray, classes: np.ndarray, prior: np.ndarray, rate: float = 0.01, batch: int = 96) -> Weights:
    """One pass of Adam over windows (n, SPAN) of embedding rows, contexts and classes (-1: none)."""
    state = Adam(w, rate)
    for at in range(0, len(x), batch):
        part = slice(at, at + batch)
        state.step(gradients(state.w, x[part], context[part], classes[part], prior)[0])
    return state.w


class Adam:
    """Weights under training, in one flat array; the rate falls as steps go by."""

    def __init__(self, w: Weights, rate: float = 0.01):
        self.x, self.rate, self.t = flat(w), rate, 0
        self.m, self.s = np.zeros_like(self.x), np.zeros_like(self.x)
        self.w = unflat(self.x)

    def step(self, g: Weights) -> None:
        d = flat(g)
        self.t += 1
        self.m += np.float32(0.1) * (d - self.m)
        self.s += np.float32(0.01) * (d * d - self.s)
        rate = self.rate / math.sqrt(1 + self.t / 500)
        self.x -= np.float32(rate / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.s * np.float32(1 / (1 - 0.99**self.t))) + np.float32(1e-6))
        self.w = unflat(self.x)


class Within:
    """Vectors of splits under training, by Adagrad on the splits that a step meets."""

    def __init__(self, model: "Model", rate: float = 0.1):
        self.model, self.rate = model, np.float32(rate)
        self.t = model.vectors().copy()
        self.s = np.zeros_like(self.t)
        self.met = np.zeros(len(self.t), np.int64)

    def at(self, ids: np.ndarray, context: np.ndarray) -> "Within":
        """The places of the next step, with any id and context where there is none."""
        self.ids, self.context = ids.ravel(), context.ravel()
        return self

    def gradients(self, h: np.ndarray, there: np.ndarray, n: int) -> tuple[np.ndarray, float]:
        """(gradient of h, loss) of the mean over n places `there`."""
        place = np.flatnonzero(there)
        mine, dh, loss, self.got = h.take(place, axis=0), np.zeros_like(h), 0.0, []
        for of, split, side, many, prior in self.model.ways(self.ids[place], self.context[place]):
            if not len(of):
                continue
            hs, ts = mine.take(of, axis=0), self.t.take(split, axis=0)
            z = (hs * ts) @ np.ones(DIM, h.dtype)
            z += prior
            z *= side
            np.clip(z, -TOP, TOP, out=z)
            e = np.exp(-z)
            loss += float(np.log1p(e).sum()) / n
            d = (side * (-e / (1 + e) / n)).astype(h.dtype, copy=False)[:, None]
            some = many > 0
            ts *= d
            dh[place[some]] += run_sums(ts, (np.cumsum(many) - many)[some])
            hs *= d
            self.got.append(summed(hs, split))
        return dh, loss

    def step(self) -> None:
        for rows, g, n in self.got:
            much = self.s.take(rows, axis=0) + g * g
            self.s[rows] = much
            self.t[rows] -= self.rate * g / (np.sqrt(much) + np.float32(1e-8))
            self.met[rows] += n


class Model:
    """Weights, and what the counts give: each id's bucket, each bucket's class, log10 share of an id in its
    bucket, and of a bucket in its class after each bucket."""

    def __init__(self, counts: np.ndarray, weights: Weights):
        order = np.lexsort((np.arange(IDS), -counts))
        mass = np.cumsum(counts[order] + 1.0)
        rest = (mass - mass[OWN - 1]) / max(mass[-1] - mass[OWN - 1], 1e-300)
        rank = np.arange(IDS)
        shared = OWN + np.minimum((rest * (BUCKETS - OWN)).astype(np.int64), BUCKETS - OWN - 1)
        self.bucket = np.empty(IDS, np.int64)
        self.bucket[order] = np.where(rank < OWN, rank, shared)
        self.mass = np.bincount(self.bucket, weights=counts + 1.0, minlength=BUCKETS)
        before = np.cumsum(self.mass) - self.mass
        self.klass_of = np.minimum((before * CLASSES / mass[-1]).astype(np.int64), CLASSES - 1)
        self.klass = self.klass_of[self.bucket]
        self.share = np.log10((counts + 1.0) / self.mass[self.bucket])
        self.weights = weights
        self.shares = np.bincount(self.klass_of, weights=self.mass, minlength=CLASSES) / self.mass.sum()
        self.own = self.mass / np.maximum(self.mass.sum() * self.shares[self.klass_of], 1e-300)
        self.seat = np.full((BUCKETS + 1) * BUCKETS, -1, np.int32)  # a pair's context
        # Ids by rank are those of buckets one after the other, and these of classes. No split for buckets without ids.
        used = np.flatnonzero(np.bincount(self.bucket, minlength=BUCKETS))
        bounds = lambda of: (first := np.flatnonzero(np.append(True, of[1:] != of[:-1])), np.append(first[1:], len(of)))
        paths, self.halves = splits(*bounds(self.klass_of[used]), self.mass[used])
        self.used, seat = used, np.searchsorted(used, np.arange(BUCKETS))
        self.to_bucket = (paths, seat.astype(np.int32))
        paths, ends = splits(*bounds(self.bucket[order]), counts[order] + 1.0)
        self.to_id = (Paths(paths.start, paths.split + len(self.halves), paths.side), np.argsort(order).astype(np.int32))
        total = np.append(0.0, mass)
        low, middle, high = total[ends].T if len(ends) else np.ones((3, 0))
        self.id_odds = np.log((high - middle) / (middle - low)).astype(np.float32)
        self.follow(np.zeros((BUCKETS + 1, BUCKETS)))

    def light(self, within: bool = True) -> "Model":
        """The model without the tables that only follow() needs, and without what predicts within classes, if
        this is not asked for."""
        out = copy.copy(self)
        out.after = out.share = out.own = out.mass = out.pairs = np.empty(0)
        if not within:
            out.odds, out.to_bucket, out.to_id, out.id_odds = out.odds[:0], None, None, None
        return out

    def __getstate__(self) -> dict:
        """Odds travel packed: in most contexts most are those of the context of one bucket."""
        return self.__dict__ | {"odds": zlib.compress(self.odds.tobytes(), 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.odds = np.frombuffer(zlib.decompress(state["odds"]), np.float32).reshape(-1, max(1, len(self.halves)))

    def _odds(self, after: np.ndarray) -> np.ndarray:
        """Logs of right half to left half of every split of buckets after each context."""
        out = np.zeros((len(after), max(1, len(self.halves))), np.float32)
        order = np.argsort(self.halves[:, 0] * (BUCKETS + 1) + self.halves[:, 2], kind="stable")
        for at in range(0, len(after) if len(order) else 0, 512):
            some = np.zeros((min(512, len(after) - at), len(self.used) + 1))
            some[:, :-1] = 10.0 ** after[at : at + 512][:, self.used]
            sums = lambda a, b: np.add.reduceat(some, np.stack([self.halves[order, a], self.halves[order, b]], axis=1).ravel(), axis=1)[:, ::2]  # noqa: B023, E731
            out[at : at + 512, order] = np.log(np.maximum(sums(1, 2), 1e-300)) - np.log(np.maximum(sums(0, 1), 1e-300))
        return out

    def vectors(self) -> np.ndarray:
        """Vectors of splits: of those of buckets, then of those of ids (zero before training)."""
        return self.weights.get("T", np.zeros((len(self.halves) + len(self.id_odds), DIM), np.float32))

    def ways(self, ids: np.ndarray, context: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(index into ids, split, side, splits for each id, logs from counts) of the splits from each id's class to
        its bucket, and then of those from there to the id."""
        paths, seat = self.to_bucket
        of, split, side, n = paths.to(seat[self.bucket[ids]])
        yield of, split, side, n, self.odds.ravel().take(np.take(context * self.odds.shape[1], of) + split)
        paths, seat = self.to_id
        of, split, side, n = paths.to(seat[ids])
        yield of, split, side, n, self.id_odds[split - len(self.halves)]

    def inner_logs(self, t: np.ndarray, h: np.ndarray, ids: np.ndarray, context: np.ndarray, most: int = 2048) -> np.ndarray:
        """Log probability of each id within its class, where attention makes h."""
        out = np.zeros(len(ids))
        for at in range(0, len(ids), most):
            part, mine = slice(at, at + most), h[at : at + most]
            for of, split, side, _, prior in self.ways(ids[part], context[part]):
                z = (mine.take(of, axis=0) * t.take(split, axis=0)) @ np.ones(DIM, np.float32)
                z += prior
                z *= side
                np.clip(z, -TOP, TOP, out=z)
                out[part] -= np.bincount(of, weights=np.log1p(np.exp(-z)), minlength=len(mine))
        return out

    def _of_classes(self, counts: np.ndarray) -> np.ndarray:
        by = np.zeros((BUCKETS, CLASSES))
        by[np.arange(BUCKETS), self.klass_of] = 1
        return counts @ by

    def follow(self, pairs: np.ndarray) -> None:
        """Takes counts of buckets after buckets (the last row: in front of a text)."""
        total = self._of_classes(pairs)
        self.prior = np.log(np.maximum((total + PRIOR * self.shares) / (total.sum(axis=1, keepdims=True) + PRIOR), 1e-30)).astype(np.float32)
        self.after = np.log10((pairs + PRIOR * self.own) / (total[:, self.klass_of] + PRIOR)).astype(np.float32)
        top = np.argsort(-pairs[:BUCKETS].ravel(), kind="stable")[:CONTEXTS]
        self.odds = self._odds(self.after)
        self.pairs = top[pairs.ravel()[top] > 0]
        self.seat[:] = -1
        self.seat[self.pairs] = np.arange(len(self.pairs))

    def follow_pairs(self, counts: np.ndarray) -> None:
        """Takes counts of buckets after the pairs that are contexts."""
        total, last = self._of_classes(counts), self.pairs % BUCKETS
        prior = np.log(np.maximum((total + PAIR_PRIOR * np.exp(self.prior[last])) / (total.sum(axis=1, keepdims=True) + PAIR_PRIOR), 1e-30))
        after = np.log10((counts + PAIR_PRIOR * 10.0 ** self.after[last]) / (total[:, self.klass_of] + PAIR_PRIOR))
        self.prior = np.concatenate([self.prior[: BUCKETS + 1], prior.astype(np.float32)])
        self.after = np.concatenate([self.after[: BUCKETS + 1], after.astype(np.float32)])
        self.odds = np.concatenate([self.odds[: BUCKETS + 1], self._odds(after)])

    def places(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their buckets, the buckets before them, their contexts) of texts one after the other."""
        ids = np.concatenate(texts) if texts else np.empty(0, np.int64)
        rows = self.bucket[ids]
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        before, two = np.empty_like(rows), np.empty_like(rows)
        before[1:], two[2:] = rows[:-1], rows[:-2]
        before[starts] = START
        two[:2], two[starts] = 0, 0
        two[starts[lengths[lengths > 0] > 1] + 1] = 0
        pair = self.seat[two * BUCKETS + np.minimum(before, BUCKETS - 1)]
        alone = (pair < 0) | (before == START)
        alone[starts] = True
        alone[starts[lengths[lengths > 0] > 1] + 1] = True
        return ids, rows, before, np.where(alone, before, pair + (BUCKETS + 1))

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(embedding rows, contexts, classes) of the windows of texts one after the other, without overlap."""
        x, context, ids, there = self.laid(texts)
        return x, context, np.where(there, self.klass[ids], -1)

    def laid(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(embedding rows, contexts, ids, whether there is one) of windows()."""
        ids, _, before, context = self.places(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        n = -(-lengths // SPAN)
        place = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))[:, None] * SPAN + np.arange(SPAN)
        there = place < np.repeat(lengths, n)[:, None]
        seat = np.where(there, place + np.repeat(np.cumsum(lengths) - lengths, n)[:, None], 0)
        return before[seat], context[seat], ids[seat], there

    def scores(self, texts: list[np.ndarray], batch: int = 1024) -> np.ndarray:
        """log10 probability of each sequence of ids (with its end)."""
        ids, _, before, context = self.places(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        out, t = np.zeros(len(texts)), self.vectors()
        n_windows = 1 + np.maximum(0, -(-(lengths - SPAN) // STRIDE))
        doc = np.repeat(np.arange(len(texts)), n_windows)
        j = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        klass = self.klass[ids]
        places = np.arange(SPAN)
        for at in range(0, len(doc), batch):
            d, first = doc[at : at + batch], j[at : at + batch] * STRIDE
            place = first[:, None] + places  # of the id that is predicted
            there = place < lengths[d][:, None]
            new = there & ((first == 0)[:, None] | (places >= SPAN - STRIDE))
            seat = np.minimum(starts[d][:, None] + place, len(ids) - 1)
            h = hidden(self.weights, before[seat])
            got = picked_logs(self.weights, h, context[seat], klass[seat], self.prior).astype(np.float64)
            got[new] += self.inner_logs(t, h[new], ids[seat[new]], context[seat[new]])
            out += np.bincount(d, weights=(got * new).sum(axis=1) / math.log(10), minlength=len(texts))
        return out


def held(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def words(text: str) -> list[bytes]:
    """Words with A-Z lower-cased: bytes split at the six ASCII spaces."""
    return text.encode().lower().split()


def texts_of(b: pa.RecordBatch, most: int = 256) -> Iterator[list[np.ndarray]]:
    """Ids of the texts of a batch, of `most` texts at once."""
    for at in range(0, b.num_rows, most):
        yield [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in b.column("key").slice(at, most)]


#: Kinds of gathered rows; HELD is a text that is held out.
WORD, ID, TEXT, HELD = 0, 1, 2, 3
END_KEY = b" end"  # no word holds a space


def _gather(docs: DataFrame, tokens: tuple[str, str, str]) -> DataFrame:
    """Rows (kind, key, n): of training texts words and ids with counts; of every text its ids, with the
    row's key as n, so that texts are tokenized once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen, ids_seen, ends, whole = tokenizer(*tokens), Counter(), np.zeros(IDS, np.int64), 0, {TEXT: [], HELD: []}
        learned: list[np.ndarray] = []

        def out(kind: int, keys: list[bytes], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int8()), pa.array(keys, pa.binary()), pa.array(n, pa.int64())], ["kind", "key", "n"])

        for b in batches:
            for doc, row, text in zip(b.column("doc_id").to_pylist(), b.column("doc").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                ids = np.append(t.ids(text).astype(np.int32), np.int32(STOP))
                kind = HELD if held(doc) else TEXT
                whole[kind].append((ids.astype("<u2").tobytes(), row))
                if len(whole[kind]) == 256:
                    yield out(kind, [x for x, _ in whole[kind]], [x for _, x in whole[kind]])
                    whole[kind] = []
                if kind == HELD:
                    continue
                seen.update(words(text))
                ends += 1
                learned.append(ids)
                if len(learned) == 256:
                    ids_seen += np.bincount(np.concatenate(learned), minlength=IDS)
                    learned = []
            if len(seen) > 200_000:
                yield out(WORD, list(seen), list(seen.values()))
                seen.clear()
        for kind, some in whole.items():
            if some:
                yield out(kind, [x for x, _ in some], [x for _, x in some])
        if learned:
            ids_seen += np.bincount(np.concatenate(learned), minlength=IDS)
        if ends:
            yield out(WORD, [*seen, END_KEY], [*seen.values(), ends])
            used = np.flatnonzero(ids_seen)
            yield out(ID, [str(i).encode() for i in used], ids_seen[used].tolist())

    return docs.mapInArrow(run, "kind byte, key binary, n long")


def _average(texts: DataFrame, model: Model, parts: int) -> Weights:
    """Each part trains from the same weights on all of its windows, and weights are averaged by windows, vectors of
    splits by the times that a part met the split."""
    start = model.weights
    sent = texts.sparkSession.sparkContext.broadcast(model.light())
    n_splits = len(model.halves) + len(model.id_odds)

    def packed(block: list[int], x: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(pa.array([zlib.compress(v.astype("<i8").tobytes(), 1) for v in c], pa.binary()) for c in (x, n))], ["block", "x", "n"])

    def raised(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.rint(x.astype(np.float64) * SCALE).astype(np.int64) * n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = sent.value
        state, within, n = Adam(start), Within(small), 0
        for b in batches:
            for some in texts_of(b, 64):
                x, context, ids, there = small.laid(some)
                classes = np.where(there, small.klass[ids], -1)
                n += len(x)
                # Windows of a text stand together; steps mix those of many texts.
                order = np.argsort((np.arange(len(x)) * 2654435761) % (1 << 32), kind="stable")
                for at in range(0, len(x), 96):
                    pick = order[at : at + 96]
                    state.step(gradients(state.w, x[pick], context[pick], classes[pick], small.prior, within.at(ids[pick], context[pick]))[0])
                    within.step()
        if n:
            yield packed([0], [raised(state.x, np.int64(n))], [np.array([n])])
            for at in range(0, n_splits, SPLITS):
                part = slice(at, at + SPLITS)
                yield packed([1 + at // SPLITS], [raised(within.t[part], within.met[part, None])], [within.met[part]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for block, *raw in zip(b.column("block").to_pylist(), b.column("x"), b.column("n"), strict=True):
                got = [np.frombuffer(zlib.decompress(r.as_buffer()), "<i8") for r in raw]
                sums[block] = [u + v for u, v in zip(sums[block], got, strict=True)] if block in sums else got
        if sums:
            yield packed(list(sums), *map(list, zip(*sums.values(), strict=True)))

    # Dealt row by row, as equal texts may be many, and sorted, so that batches are the same in every attempt.
    laid = texts.repartition(parts).sortWithinPartitions("n", "key").select("key")
    schema = "block int, x binary, n binary"
    out, vectors = flat(start), model.vectors().copy()
    # A model of fixed size, in blocks.
    for r in laid.mapInArrow(run, schema).repartition(2 + n_splits // SPLITS, "block").mapInArrow(add, schema).toLocalIterator():
        x, n = (np.frombuffer(zlib.decompress(r[c]), "<i8") for c in ("x", "n"))
        if r["block"] == 0:
            out = (x / n / SCALE).astype(np.float32)
        else:
            at = (r["block"] - 1) * SPLITS
            vectors[at : at + SPLITS] = x.reshape(-1, DIM) / np.maximum(n, 1)[:, None] / SCALE
    sent.destroy()
    return unflat(out) | {"T": vectors}


#: Splits whose vectors travel as one row.
SPLITS = 4096
#: Contexts whose counts travel as one row.
BLOCK = 256


def _followers(texts: DataFrame, model: Model, contexts: int, base: int) -> np.ndarray:
    """Counts of buckets after the contexts numbered from base, over all training texts: a table of fixed
    size, which travels in packed blocks of contexts, each added up before it reaches the driver."""
    if not contexts:
        return np.zeros((0, BUCKETS))
    blocks, small = -(-contexts // BLOCK), model.light(within=False)

    def packed(block: list[int], tables: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([zlib.compress(t.astype("<i8").tobytes(), 1) for t in tables], pa.binary())], ["block", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(blocks * BLOCK * BUCKETS, np.int32 if base else np.int64)
        for b in batches:
            for some in texts_of(b):
                _, rows, before, context = small.places(some)
                x = (context if base else before) - base
                ok = x >= 0
                at, n = np.unique(x[ok] * BUCKETS + rows[ok], return_counts=True)
                seen[at] += n
        tables = seen.reshape(blocks, BLOCK * BUCKETS)
        some = [i for i in range(blocks) if tables[i].any()]
        for i in range(0, len(some), 8):
            yield packed(some[i : i + 8], [tables[j] for j in some[i : i + 8]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
                table = np.frombuffer(zlib.decompress(raw.as_buffer()), "<i8")
                sums[block] = sums[block] + table if block in sums else table
        if sums:
            yield packed(list(sums), list(sums.values()))

    made = texts.select("key").mapInArrow(run, "block int, counts binary").repartition(blocks, "block").mapInArrow(add, "block int, counts binary")
    out = np.zeros((blocks, BLOCK * BUCKETS), np.int64)
    for r in made.toLocalIterator():
        out[r["block"]] += np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return out.reshape(-1, BUCKETS)[:contexts].astype(float)


def _common(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words with their counts: all from a count on that at most `most` words reach. The
    count is taken from a histogram of a few hundred steps, so nothing is sorted and no task sends more."""
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
    reach, cut = 0, None
    for s in sorted(sizes, reverse=True):
        reach += sizes[s]
        if reach > most:
            break
        cut = s
    if cut is None:
        return {}
    got = counts.where(step >= cut).toPandas()
    return dict(zip(map(bytes, got["key"]), got["c"].tolist(), strict=True))


def score(docs: DataFrame, tokens: tuple[str, str, str], common: int = 200_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = doc_input(docs).select("doc_id", "text", row_key().alias("doc"))
    gathered = staged(_gather(rows, tokens), "gathered")
    counts = staged(gathered.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = _common(counts, common)
    id_counts = np.zeros(IDS, np.int64)
    found = gathered.where(F.col("kind") == ID).groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # at most IDS rows
    id_counts[found["key"].map(int).to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    model = Model(id_counts, fresh())
    learned = gathered.where(F.col("kind") == TEXT).select("key", "n")
    model.follow(_followers(learned, model, BUCKETS + 1, 0))
    model.follow_pairs(_followers(learned, model, len(model.pairs), BUCKETS + 1))
    model.weights = _average(learned, model, max(1, int(id_counts.sum()) // PART_IDS))
    norm = math.log10(total + distinct + 1)
    ends = counts.where(F.col("key") == F.lit(END_KEY)).first()
    end = ends["c"] if ends else 0
    context = rows.sparkSession.sparkContext
    sent_words, sent_model = context.broadcast(top), context.broadcast(model.light())

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent_model.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                scores = m.scores([np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in some.column("key")])
                yield pa.RecordBatch.from_arrays([some.column("n"), pa.array(scores)], ["doc", "score"])

    # Rows of equal key have equal texts, and so equal scores.
    modelled = gathered.where(F.col("kind") >= TEXT).select("key", "n").mapInArrow(attend, "doc long, score double").groupBy("doc").agg(F.min("score").alias("score"))
    modelled = staged(modelled, "model_scores")
    unstage(gathered)
    sent_model.destroy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, part, row = sent_words.value, TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                mine, rare = [], []
                for doc_id, doc, text in zip(*(some.column(c).to_pylist() for c in ("doc_id", "doc", "text")), strict=True):
                    n, logs, hits = 1, math.log10(end + 1), int(end > 0)
                    for word, k in Counter(words(text)).items():
                        n += k
                        c = known.get(word)
                        if c is None:
                            rare.append((row, word, k))
                        else:
                            logs += k * math.log10(c + 1)
                            hits += k
                    mine.append((row, doc_id, doc, n, hits, logs))
                    row += 1
                yield _rows(part, mine, rare)

    made = staged(rows.mapInArrow(run, "part int, row int, doc_id long, doc long, n_tokens long, n_known long, logs double, word binary, k long"), "words")
    rare = made.where("word is not null").select("part", "row", "word", "k").join(counts.select(F.col("key").alias("word"), "c"), "word")
    more = rare.groupBy("part", "row").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = made.where("word is null").join(more, ["part", "row"], "left").join(modelled, "doc")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return out.select(
        "doc_id",
        (remainder == 2).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )


def _rows(part: int, mine: list[tuple], rare: list[tuple]) -> pa.RecordBatch:
    """Rows of documents, then rows of their rare words."""
    n, r = len(mine), len(rare)
    pick = lambda i, kind: pa.array([x[i] for x in mine] + [None] * r, kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * (n + r), pa.int32()),
            pa.array([x[0] for x in mine] + [x[0] for x in rare], pa.int32()),
            *(pick(i, k) for i, k in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.float64()))),
            pa.array([None] * n + [x[1] for x in rare], pa.binary()),
            pa.array([None] * n + [x[2] for x in rare], pa.int64()),
        ],
        ["part", "row", "doc_id", "doc", "n_tokens", "n_known", "logs", "word", "k"],
    )
