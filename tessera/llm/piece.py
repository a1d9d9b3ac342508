"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols are merged by an agenda of adjacent pairs: best score first, ties leftmost. No piece spans
the edge in front of a space mark or around a line break, so text is cut there. The unlike new cuts of an
Arrow batch's texts are merged together: each has a row of an agenda table with the scores of its adjacent
pairs, and a step takes the best of every row, joins that pair and looks up the two pairs beside it. Cuts over
`ROW` symbols have an agenda of their own, a heap whose stale entries are dropped when they come up. Merged
cuts are kept by use: in two generations of at most `KEPT` / 2, of which the older one goes when the younger
is full.

Every new cut is encoded and decoded by the sentencepiece library, too, in the Arrow batch that brings it,
and so is the first whole text of each batch; where ids or decoded text differ the library's are taken and
`n_unlike` counts it.

Fits models of BPE type with the identity normaliser (byte fallback or unknown id). Null text counts as
empty (the end id only); very long texts need memory in proportion; repeated rows give a row each; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import doc_input

MARK = "▁"
CUTS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Cuts a worker keeps.
KEPT = 400_000
#: Symbols up to which a cut is merged in the agenda table, and cells of that table.
ROW, CELLS = 24, 1 << 18
Merged = tuple[int, str, str]  # number of ids, ids in decimal, text


def cuts_of(text: str) -> list[str]:
    """The cuts of one text, spaces as marks. Where words are parted by single spaces they are the words of
    its lines; everything else goes through the pattern."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " ":
        return CUTS.findall(MARK + text.replace(" ", MARK))
    out: list[str] = []
    for n, line in enumerate(text.split("\n")):
        words = line.replace(" ", " " + MARK).split(" ")
        if n == 0:
            words[0] = MARK + words[0]
        else:
            out.append("\n")
        if not words[0]:
            del words[0]
        out += words
    return out


class PieceModel:
    """Merge-type SentencePiece model read with the library; merging and decoding are this class's own."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.break_ids = sp.encode("\n")  # ids of a line break in front, which no merge passes
        self.lead = len(self.break_ids)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.cost = {self.pieces[i]: -sp.get_score(i) for i in plain}
        self.unknown, self.eos = sp.unk_id(), sp.eos_id()
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.ids if len(p) > 1):
            raise ValueError("a piece of this vocabulary spans the cuts")
        self.young: dict[str, Merged] = {}
        self.old: dict[str, Merged] = {}
        self.unlike = 0
        self._pairs()

    def _pairs(self) -> None:
        """Tables of symbols (pieces, and single characters of pieces) and of the pairs that make a piece."""
        self.symbol = dict(self.ids)
        n = len(self.pieces)
        for c in sorted({c for p in self.ids for c in p}):
            self.symbol.setdefault(c, n + len(self.symbol))
        self.base = 1 << 20  # above all symbols
        found = {}
        for p, i in self.ids.items():
            for at in range(1, len(p)):
                a, b = self.symbol.get(p[:at]), self.symbol.get(p[at:])
                if a is not None and b is not None:
                    found[a * self.base + b] = i
        self.pair_key = np.array(sorted(found) + [np.iinfo(np.int64).max], np.int64)
        self.pair_makes = np.array([found[k] for k in self.pair_key[:-1].tolist()] + [-1], np.int32)
        cost = np.zeros(n)
        for p, i in self.ids.items():
            cost[i] = self.cost[p]
        self.pair_cost = np.append(cost[self.pair_makes[:-1]], np.inf)
        self.single = {i: self._alone(c) for c, i in self.symbol.items() if c not in self.ids}
        self.of_char = np.full(sys.maxunicode + 1, -1, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.shown = [None if i in self.byte_of else " ⁇ " if i == self.unknown else "" if i in self.silent else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]

    def _alone(self, symbol: str) -> list[int]:
        return [self.bytes[x] for x in symbol.encode()] if self.bytes else [self.unknown]

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, piece) of pairs of symbols; an infinite cost where they make no piece."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair_key, key)
        none = len(self.pair_key) - 1
        at[(self.pair_key[at] != key) | (left < 0) | (right < 0)] = none
        return self.pair_cost[at], self.pair_makes[at]

    def merge_many(self, cuts: list[str]) -> list[list[int]]:
        """Ids of many cuts, each by its row of the agenda table."""
        out: list[list[int] | None] = [None] * len(cuts)
        by_size: dict[int, list[int]] = {}
        for i, c in enumerate(cuts):
            if 1 < len(c) <= ROW:
                by_size.setdefault(len(c), []).append(i)
            else:
                out[i] = self.merge(c)
        for size, who in by_size.items():
            for at in range(0, len(who), max(1, CELLS // size)):
                some = who[at : at + max(1, CELLS // size)]
                chars = np.frombuffer("".join([cuts[i] for i in some]).encode("utf-32-le"), "<u4").reshape(len(some), size)
                laid = self.of_char[chars].astype(np.int64)
                # Characters of no piece are -1 less their place in the cut.
                laid = np.where(laid < 0, ~np.arange(size), laid)
                for i, symbols in zip(some, self._settled(laid), strict=True):
                    if min(symbols) < 0 or max(symbols) >= len(self.pieces):
                        symbols = [y for x in symbols for y in (self._alone(cuts[i][~x]) if x < 0 else self.single.get(x, (x,)))]
                    out[i] = symbols
        return out  # type: ignore[return-value]

    def _settled(self, symbols: np.ndarray) -> list[list[int]]:
        """Rows of symbols after all their merges."""
        done: list[list[int]] = [[]] * len(symbols)
        who, width = np.arange(len(symbols)), symbols.shape[1]
        length = np.full(len(symbols), width)
        cost, makes = self._offers(symbols[:, :-1], symbols[:, 1:])
        places = np.arange(width)
        while len(who):
            at = cost.argmin(axis=1)
            rows = np.arange(len(who))
            stop = np.isinf(cost[rows, at])
            if stop.any():
                for i, row, n in zip(who[stop].tolist(), symbols[stop].tolist(), length[stop].tolist(), strict=True):
                    done[i] = row[:n]
                go = ~stop
                who, symbols, length, cost, makes, at = who[go], symbols[go], length[go], cost[go], makes[go], at[go]
                rows = np.arange(len(who))
                if not len(who):
                    break
            symbols[rows, at] = makes[rows, at]
            # What stands behind the pair moves up by one.
            behind = places[None, :-1] > at[:, None]
            symbols[:, :-1] = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            length -= 1
            moved = behind[:, :-1] | (places[None, : width - 2] == at[:, None])
            cost[:, :-1] = np.where(moved, cost[:, 1:], cost[:, :-1])
            makes[:, :-1] = np.where(moved, makes[:, 1:], makes[:, :-1])
            cost[:, -1] = np.inf
            for j, ok in ((at, at + 1 < length), (at - 1, at > 0)):
                r, k = rows[ok], j[ok]
                cost[r, k], makes[r, k] = self._offers(symbols[r, k], symbols[r, k + 1])
            past = at + 1 >= length
            cost[rows[past], np.minimum(at[past], width - 2)] = np.inf
        return done

    def merge(self, cut: str) -> list[int]:
        """Ids of one cut, by the agenda."""
        if (whole := self.ids.get(cut)) is not None and len(cut) < 3:
            return [whole]
        symbols, n, cost = list(cut), len(cut), self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost.get(cut[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or after[a] != b or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                joined = symbols[a] + symbols[c]
                if (s := cost.get(joined)) is not None:
                    heapq.heappush(agenda, (s, a, c, len(joined)))
            if (p := before[a]) >= 0:
                joined = symbols[p] + symbols[a]
                if (s := cost.get(joined)) is not None:
                    heapq.heappush(agenda, (s, p, a, len(joined)))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                if i is not None:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[x] for x in s.encode()]
                else:
                    out.append(self.unknown)
        return out

    def decode_cut(self, ids: list[int]) -> str:
        """Text of ids, with spaces for marks; the space in front of a whole text is not dropped."""
        try:
            return "".join([self.shown[i] for i in ids])  # type: ignore[misc]
        except TypeError:  # bytes among them
            pass
        out, held = [], bytearray()

        def release() -> None:
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            release()
            out.append(self.shown[i])
        release()
        return "".join(out)

    def _new(self, cuts: list[str]) -> dict[str, Merged]:
        """Merges cuts and checks them, and the text that they give, against the library."""
        said = [x[self.lead :] for x in self.library.encode(["\n" + c.replace(MARK, " ") for c in cuts], num_threads=1)]
        made = {}
        mine = self.merge_many(cuts)
        back = self.library.decode([self.break_ids + x for x in said])
        for c, ids, theirs, text in zip(cuts, mine, said, back, strict=True):
            decoded = self.decode_cut(ids)
            if ids != theirs or decoded != text[1:]:
                self.unlike += 1
                ids, decoded = theirs, text[1:]
            made[c] = (len(ids), " ".join(map(str, ids)), decoded)
        return made

    def _found(self, cuts: list[str]) -> list[Merged | None]:
        """Merged cuts of those that are kept; those of the older generation become young again."""
        got: list[Merged | None] = list(map(self.young.get, cuts))
        if None in got:
            for i, g in enumerate(got):
                if g is None and (held := self.old.get(cuts[i])) is not None:
                    got[i] = self.young[cuts[i]] = held
        return got

    def whole(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """(number of ids, ids in decimal, decoded text, 1 if the library disagreed on it or one of its new
        cuts) of each text, with an end id."""
        every = [cuts_of(t) for t in texts]
        held = [self._found(cuts) for cuts in every]
        missing = {c: 0 for cuts, got in zip(every, held, strict=True) if None in got for c, g in zip(cuts, got, strict=True) if g is None}
        wrong: set[str] = set()
        made: dict[str, Merged] = {}
        if missing:
            names = list(missing)
            for at in range(0, len(names), 1 << 16):
                before, some = self.unlike, self._new(names[at : at + (1 << 16)])
                made |= some
                if self.unlike > before:
                    wrong |= some.keys()
        out = []
        for n, (cuts, got) in enumerate(zip(every, held, strict=True)):
            new = None in got
            if new:
                got = [made[c] if g is None else g for c, g in zip(cuts, got, strict=True)]
            ids = " ".join([g[1] for g in got] + [str(self.eos)])
            row = (sum([g[0] for g in got]) + 1, ids, "".join([g[2] for g in got])[1:])
            unlike = int(bool(wrong) and new and not wrong.isdisjoint(cuts))
            if n == 0:
                said = self.library.encode(texts[0]) + [self.eos]
                theirs = (len(said), " ".join(map(str, said)), self.library.decode(said))
                unlike |= int(row != theirs)
                row = theirs
            out.append((*row, unlike))
        self.young |= made
        if len(self.young) > KEPT // 2:
            self.old, self.young = self.young, {}
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.whole([text])[0][1].split()]


def _utf8(raw: bytes) -> str:
    """Bytes that are no UTF-8 become one replacement character each, as in the library."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker and file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def round_trip(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_unlike) of every row; with texts also `ids`
    (array of int) and `decoded`."""
    more = ", ids array<int>, decoded string" if texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = m.whole(part.column("text").to_pylist())
                cols = [part.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got]), pa.array([hashlib.sha256(g[2].encode()).hexdigest() for g in got]), pa.array([g[3] for g in got], pa.int64())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_unlike"]
                if texts:
                    cols += [pa.array([[int(x) for x in g[1].split()] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return doc_input(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_unlike long" + more)
