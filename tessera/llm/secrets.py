"""Secret scans: patterns find candidates, a random forest removes the false positives among them.

The forest sees a candidate's length and make-up, its character transitions against ordinary words,
how much of it dictionary words cover, the path or source it stands in, and the words beside it. It is
trained on labelled findings: by default `made_findings`, a bounded generated set (its size is a
parameter), with any table of reviewed findings added to it, up to the same bound. Scanning needs no
shuffle.

Null and empty texts have no findings. Very long texts are scanned whole. Repeated rows are scanned
each; an empty table gives an empty result; columns that clash with the result's are not carried.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Findings the forest is trained on at most.
FINDINGS = 6000
CUT = 0.5
MASKED = "[SECRET]"

#: Shapes of well-known credentials, words that stand beside secrets, and words that
#: stand beside harmless look-alikes.
SHAPES = (
    ("aws_key", r"AKIA[0-9A-Z]{16}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("stripe_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("google_key", r"AIza[A-Za-z0-9_-]{35}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
KEY_WORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "access-key", "credential", "auth", "bearer", "private_key")
HARMLESS_WORDS = ("example", "sample", "dummy", "placeholder", "changeme", "your", "test", "commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "isbn", "order", "invoice", "card", "phone", "revision", "integrity", "etag")
PATH_WORDS = ("test", "tests", "example", "examples", "fixture", "fixtures", "docs", "mock", "sample", "vendor", "node_modules")
DICTIONARY = tuple(
    "about account access address after again also another answer because before being below between both build call case change check class close code color come common company could country create data date days default demo different does done down each email end even every example false file find first follow form from function general give good great group hand have header help here high home house image index info input insert into item just keep key kind know large last left letter level life like line list little live local long look made main make many master mean might model more most move much must name need never next night none null number object often only open option order other over page part pass password path people place point press print public query read real release report result right same sample save school second secret section server service set should show side site small some sound source spell start state status still stop string such system table take tell test text than that their them then there these they thing think this those three through time title token true turn type under until update user value version very want water well were what when where which while will with word work world would write year your".split()
)

LONG = re.compile(r"[A-Za-z0-9+/_=.\-]{16,}")
ASSIGNED = re.compile(r"[:=]\s{0,2}[\"'`]?([^\s\"'`,;<>]{8,})")
KNOWN = [(k, re.compile(p)) for k, p in SHAPES]
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----")
KEY_RE = re.compile("|".join(KEY_WORDS), re.I)
HARMLESS_RE = re.compile("|".join(HARMLESS_WORDS), re.I)
PATH_RE = re.compile(r"(?:^|[/\\._-])(?:" + "|".join(PATH_WORDS) + r")(?:$|[/\\._-])", re.I)
SIDE = 48


@dataclass(frozen=True)
class Finding:
    kind: str
    start: int
    end: int
    value: str
    left: str
    right: str
    path: str = ""


def candidates(text: str, path: str = "") -> list[Finding]:
    """What looks like a secret in a text; places are in characters. Overlapping ones: the first, longest."""
    spans: list[tuple[int, int, str]] = []
    if "PRIVATE KEY-----" in text:
        spans += [(m.start(), m.end(), "private_key") for m in BLOCK.finditer(text)]
    for m in ASSIGNED.finditer(text):
        a, e = m.span(1)
        if KEY_RE.search(text, max(0, m.start() - 24), m.start()):
            spans.append((a, e, "assigned"))
    for m in LONG.finditer(text):
        run = m.group()
        a, e = m.span()
        known = [(k, a + x.start(), a + x.end()) for k, p in KNOWN for x in p.finditer(run)]
        if known:
            spans += [(s, t, k) for k, s, t in known]
            continue
        cut = run.rstrip("=.-")
        if "=" in cut:  # key=value in one run is an assignment, found above if its key says so
            a += cut.rindex("=") + 1
            cut = cut[cut.rindex("=") + 1 :]
        if len(cut) >= 16 and any(c.isdigit() for c in cut):
            spans.append((a, a + len(cut), "run"))
    out, end = [], -1
    for a, e, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= end:
            out.append(Finding(kind, a, e, text[a:e], text[max(0, a - SIDE) : a], text[e : e + SIDE], path))
            end = e
    return out


LETTERS = {c: i for i, c in enumerate(string.ascii_lowercase)}


def _transitions() -> np.ndarray:
    """log2 odds of character pairs in dictionary words against even chances; digits and others: their own."""
    seen = np.full((28, 28), 0.5)
    for w in DICTIONARY:
        for a, b in zip(w, w[1:], strict=False):
            seen[LETTERS[a], LETTERS[b]] += 1
    return np.log2(seen / seen.sum(axis=1, keepdims=True) * 28)


TRANSITIONS = _transitions()
_WORDS = sorted(set(DICTIONARY), key=len, reverse=True)
_WORD_RE = re.compile("|".join(w for w in _WORDS if len(w) >= 4))
FEATURES = 20


def features(f: Finding) -> list[float]:
    v = f.value
    n = len(v)
    low = v.lower()
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in v]
    share = {k: kinds.count(k) / n for k in "dluo"}
    codes = [LETTERS.get(c, 26 if c.isdigit() else 27) for c in low]
    pairs = [TRANSITIONS[a, b] for a, b in zip(codes, codes[1:], strict=False)]
    counts = [v.count(c) / n for c in set(v)]
    covered = sum(m.end() - m.start() for m in _WORD_RE.finditer(low)) / n
    near = " ".join(f.left.split()[-3:])
    beside = f"{near} {' '.join(f.right.split()[:2])}"
    before = f.left.rstrip(" \"'`")[-1:]
    return [
        float(min(n, 200)),
        share["d"],
        share["l"],
        share["u"],
        share["o"],
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(np.mean(pairs)) if pairs else 0.0,
        float(np.min(pairs)) if pairs else 0.0,
        -sum(p * math.log2(p) for p in counts),
        covered,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", v))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v))),
        float(v.isdigit()),
        float(bool(re.search(r"[/\\].*[/\\]|\.[a-z]{2,4}$", v))),
        float(bool(KEY_RE.search(near))),
        float(bool(HARMLESS_RE.search(beside)) or bool(re.search(r"example|changeme|placeholder|xxxx|your|dummy|<|\{|\$\(", low))),
        float(bool(PATH_RE.search(f.path))),
        float(before in ("=", ":")),
        float(f.left[-1:] in "\"'`" and f.left != ""),
        float(next((i + 1 for i, (k, _) in enumerate(SHAPES) if k == f.kind), -1 if f.kind == "private_key" else 0)),
    ]


class Forest:
    """Random forest of binary trees over numeric features, grown by Gini gain on sampled columns."""

    def __init__(self, trees: int = 40, depth: int = 10, seed: int = 5):
        self.n_trees, self.depth, self.seed = trees, depth, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Forest":
        rng = np.random.default_rng(self.seed)
        some = max(1, round(math.sqrt(x.shape[1])))
        for _ in range(self.n_trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []  # feature, threshold, left, right, value

            def grow(at: np.ndarray, depth: int) -> int:
                me = len(nodes)
                mean = float(y[at].mean())
                nodes.append([-1, 0.0, 0, 0, mean])
                if depth == 0 or len(at) < 4 or mean in (0.0, 1.0):
                    return me
                best = (1e-9, -1, 0.0)
                for j in rng.permutation(x.shape[1])[:some]:
                    order = np.argsort(x[at, j], kind="stable")
                    v, t = x[at, j][order], y[at][order]
                    cut = np.flatnonzero(v[1:] > v[:-1])
                    if not len(cut):
                        continue
                    left = np.cumsum(t)[cut]
                    n_left, n = cut + 1, len(t)
                    right, n_right = t.sum() - left, n - cut - 1
                    gini = lambda p, m: p * (m - p) / m
                    gain = gini(t.sum(), n) - gini(left, n_left) - gini(right, n_right)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), int(j), float((v[cut[i]] + v[cut[i] + 1]) / 2))
                if best[1] < 0:
                    return me
                low = x[at, best[1]] <= best[2]
                nodes[me][:2] = [best[1], best[2]]
                nodes[me][2] = grow(at[low], depth - 1)
                nodes[me][3] = grow(at[~low], depth - 1)
                return me

            grow(rows, self.depth)
            t = np.array(nodes)
            self.trees.append((t[:, 0].astype(np.int32), t[:, 1], t[:, 2].astype(np.int32), t[:, 3].astype(np.int32), t[:, 4]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves reached."""
        out = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int32)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                n = at[inner]
                low = x[inner, feature[n]] <= threshold[n]
                at[inner] = np.where(low, left[n], right[n])
            out += value[at]
        return out / max(1, len(self.trees))


def made_findings(n: int = 4000, seed: int = 3) -> tuple[list[Finding], np.ndarray]:
    """Labelled findings: secrets of many shapes in ordinary surroundings, and what is mistaken for them."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    some = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    hexes, upper, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    syllables = [w[:k] for w in DICTIONARY for k in (2, 3)]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    words = lambda k: " ".join(word() for _ in range(k))

    def secret() -> tuple[str, str, str, str]:
        kind = int(rng.integers(7))
        key = pick(KEY_WORDS)
        sign = pick(("=", " = ", ": ", ":"))
        quote = pick(("", '"', "'"))
        if kind == 0:
            return f"{words(3)} ", "AKIA" + some(upper, 16), f" {words(2)}", "aws_key"
        if kind <= 2:
            return f"{words(3)} {key}{sign}{quote}", some(hexes, int(rng.integers(12, 65))), f"{quote} {words(2)}", "assigned"
        if kind == 3:
            return f"{words(3)} {key}{sign}{quote}", some(mixed + "+/_-!@", int(rng.integers(10, 60))), f"{quote} {words(2)}", "assigned"
        if kind == 4:
            return f"{words(3)} ", "ghp_" + some(mixed, 36), f" {words(2)}", "github_token"
        if kind == 5:
            return f"{words(2)} {key} ", some(mixed, int(rng.integers(24, 50))), f" {words(2)}", "run"
        name = pick([k for k, _ in SHAPES[2:]])
        value = {"slack_token": "xoxb-" + some(string.digits, 12) + "-" + some(mixed, 24), "stripe_key": "sk_live_" + some(mixed, 24), "google_key": "AIza" + some(mixed, 35), "jwt": f"eyJ{some(mixed, 20)}.eyJ{some(mixed, 40)}.{some(mixed, 43)}"}[name]
        return f"{words(3)} {pick(('', quote))}", value, f" {words(2)}", name

    def harmless() -> tuple[str, str, str, str]:
        kind = int(rng.integers(10))
        beside = pick(HARMLESS_WORDS)
        plain = f"{words(3)} "
        if kind == 0:
            return plain, some(string.digits, int(rng.integers(13, 20))), f" {words(2)}", "run"
        if kind == 1:
            return f"{words(2)} {beside} ", some(hexes, pick((32, 40, 64))), f" {words(2)}", "run"
        if kind == 2:
            return plain, "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), f" {words(2)}", "run"
        if kind == 3:
            return f"{words(2)} {pick(KEY_WORDS)}{pick(('=', ' = ', ': '))}", pick(("changeme", "your_token_here", "placeholder", "password123", "xxxxxxxxxxxx", "example-secret", "<password>", "${TOKEN_VALUE}", "os.environ.get", "required_field")) + pick(("", "1", word())), f" {words(2)}", "assigned"
        if kind == 4:
            return plain, "/".join(word() for _ in range(4)) + f"/{some(string.digits, 3)}.html", f" {words(2)}", "run"
        if kind == 5:
            return plain, f"{word()}.{some(string.digits, 2)}.mail{some(string.digits, 1)}.{word()}.com", f" {words(2)}", "run"
        if kind == 6:
            return f"{words(2)} {pick(KEY_WORDS)}: ", "".join(word() for _ in range(4)), f" {words(2)}", "assigned"
        if kind == 7:
            return plain, "AKIA" + some(upper, 9) + "EXAMPLE", " in the docs", "aws_key"
        if kind == 8:
            return plain, f"{word()}{word()}_{word()}-{some(string.digits, int(rng.integers(1, 5)))}", f" {words(2)}", "run"
        return plain, "-".join(some(string.digits, k) for k in (4, 2, 2)) + f"_{some(string.digits, 6)}_{word()}", f" {words(2)}", "run"

    found, labels = [], []
    for i in range(min(n, FINDINGS)):
        good = i % 2 == 0
        left, value, right, kind = secret() if good else harmless()
        path = f"{word()}/{pick(PATH_WORDS)}/{word()}.py" if rng.random() < (0.03 if good else 0.3) else pick(("", f"src/{word()}.py", f"src{int(rng.integers(30))}"))
        found.append(Finding(kind, len(left), len(left) + len(value), value, left[-SIDE:], right[:SIDE], path))
        labels.append(int(good))
    return found, np.array(labels)


def trained(reviewed: DataFrame | None = None, n: int = 4000) -> Forest:
    """The forest for generated findings and, where given, reviewed ones: rows (kind, value, left, right,
    path, secret), of which at most FINDINGS are taken, by the hash of their value."""
    found, y = made_findings(n)
    if reviewed is not None:
        rows = reviewed.where("value is not null and secret is not null and value != ''").orderBy(F.xxhash64("value"), "value").limit(FINDINGS).collect()
        found = found + [Finding(r["kind"] or "run", 0, len(r["value"]), r["value"], (r["left"] or "")[-SIDE:], (r["right"] or "")[:SIDE], r["path"] or "") for r in rows]
        y = np.concatenate([y, np.array([int(r["secret"]) for r in rows], np.int64)])
    return Forest().fit(np.array([features(f) for f in found]), y)


def judged(text: str, path: str, forest: Forest) -> list[tuple[Finding, float]]:
    found = candidates(text, path)
    return list(zip(found, forest.predict(np.array([features(f) for f in found])).tolist(), strict=True)) if found else []


FOUND = "doc_id long, kind string, start int, end int, value_sha256 string, probability double, is_secret boolean"


def scan(docs: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """(doc_id, kind, start, end, value_sha256, probability, is_secret) of every candidate; places in
    characters. The values themselves are not in the result."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for doc, text, p in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("path").to_pylist(), strict=True):
                new = candidates(text.as_py(), p)
                ids += [doc] * len(new)
                found += new
            if found:
                p = forest.predict(np.array([features(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([f.kind for f in found]), pa.array([f.start for f in found], pa.int32()), pa.array([f.end for f in found], pa.int32()), pa.array([hashlib.sha256(f.value.encode()).hexdigest() for f in found]), pa.array(p), pa.array(p >= CUT)],
                    [c.split()[0] for c in FOUND.split(", ")],
                )

    return rows.mapInArrow(run, FOUND)


def redacted(docs: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """docs with every secret of `text` replaced by MASKED; all other columns and rows as they are."""
    schema, at = docs.schema, docs.columns.index("text")
    place = docs.columns.index(path) if path in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            paths = b.column(place).to_pylist() if place is not None else [""] * b.num_rows
            for text, p in zip(b.column(at), paths, strict=True):
                text = text.as_py()
                cut = [f for f, q in judged(text, str(p or ""), forest) if q >= CUT] if text else []
                if cut:
                    parts, end = [], 0
                    for f in cut:
                        parts += [text[end : f.start], MASKED]
                        end = f.end
                    text = "".join([*parts, text[end:]])
                texts.append(text)
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)
