"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags words as begin, inside or outside.

The field scores a word by its shape, how often its characters change their kind, its neighbours' shapes and features of
its file (document); label pairs have weights too. It is fitted on the driver by gradient ascent on the likelihood
(forward-backward) over windows from a bounded sample of documents, labelled by the patterns. What the patterns themselves
look at (keywords, operators, the shapes of keys) is hidden in a second copy of each window: there only the change of kinds
tells secrets from words, so the field also finds secrets that no pattern names. Weights are small tables that every task
gets. Documents are then tagged in one pass without a shuffle: shapes are found once per distinct word, and Viterbi runs only where a word
is not certainly outside. A word whose lead for outside exceeds what its two label pairs can ever win back is outside
on the best path, so cutting there gives the path of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import discard, materialize, slices

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # the runs of HEX that are long enough
HEX_BYTES = re.compile(rb"[0-9a-f]{24}")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = (b"passw", b"secret", b"token", b"api", b"key", b"pwd", b"auth", b"credential", b"bearer")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_EDGES = b"\"'`.,;:!?()[]{}<>"
LENGTHS = (8, 12, 20, 32)
#: Classes of a word: 9 kinds of characters by 5 lengths, then a keyword, a keyword with a value, and an operator.
KEYWORD, VALUED, OPERATOR, N_SHAPES = 45, 46, 47, 48
#: In place of a shape: no word there; a word whose shape is hidden.
NOTHING, HIDDEN = N_SHAPES, N_SHAPES + 1
N_FILES = 6
#: Changes of the kind of characters (lower, upper, digit), by 3 lengths, and no word.
CHANGES, MIX_LENGTHS, N_MIXES = (3, 6, 10), (12, 20), 12
_KIND = bytes(1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 0 for c in range(256))


def shape(word: bytes) -> int:
    rest = word.translate(None, _LETTERS)
    core = word.strip(_EDGES)
    n = len(core)
    size = bisect_right(LENGTHS, n)
    if not rest or not rest.strip(_EDGES + b"-"):
        low = word.lower()
        if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low or low.strip(_EDGES) in KEYWORDS:
            return KEYWORD
        if not core:
            return OPERATOR if word in (b":", b"=", b":=", b"=>") else 7 * 5
        inner = core[1:]
        return (6 if inner != inner.lower() and inner != inner.upper() else 0) * 5 + size
    if word in (b"=", b":=", b"=>", b"=="):
        return OPERATOR
    head, mark, tail = core.partition(b"=")
    if mark and tail and any(k in head.lower() for k in KEYWORDS):
        return VALUED
    if b"@" in core or b"://" in core:
        return 8 * 5 + size
    digits = core.translate(None, b"0123456789")
    if not digits.strip(b"+-.,/()%$"):
        return 1 * 5 + size
    if len(digits) < n:
        if not core.translate(None, b"0123456789abcdef"):
            return 2 * 5 + size
        if not core.translate(None, b"0123456789ABCDEF"):
            return 3 * 5 + size
        if core.isalnum() and not core.translate(None, bytes(range(128))):
            return 4 * 5 + size
        if not core.translate(None, b"0123456789_+/=.-" + bytes(range(65, 91)) + bytes(range(97, 123))):
            return 5 * 5 + size
    return 7 * 5 + size


def mix(word: bytes) -> int:
    """How often the characters of a word, or of the value that it gives a key, change their kind; 0 for ordinary words."""
    core = word.strip(_EDGES)
    head, mark, tail = core.partition(b"=")
    if mark and tail and head.isascii() and head.replace(b"_", b"").replace(b"-", b"").isalpha():
        core = tail.strip(_EDGES)
    if b"@" in core or b"://" in core:
        return 0
    kinds = np.frombuffer(core.translate(_KIND), np.uint8)
    changes = np.count_nonzero((kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)) if len(kinds) > 3 else 0
    level = bisect_right(CHANGES, changes)
    return 3 * level + bisect_right(MIX_LENGTHS, len(core)) if level else 0


def features(words: list[bytes], known: dict[bytes, tuple[int, int, bool]]) -> np.ndarray:
    """Shape, mix and whether a pattern may match (columns), of each word; known keeps them, up to a bound."""
    if len(known) > 300_000:
        known.clear()
    out = []
    for w in words:
        f = known.get(w)
        if f is None:
            plain = w.isalpha() and (len(w) < 2 or w[1:].islower())
            f = known[w] = (shape(w), 0 if plain else mix(w), _may_match(w))
        out.append(f)
    return np.array(out, np.int64).reshape(-1, 3)


def file_class(shapes: np.ndarray) -> int:
    """How many of a document's words have digits (none, few, many), and whether a keyword stands in it."""
    kind = shapes // 5
    dotted = np.count_nonzero((kind >= 1) & (kind <= 5))
    return 2 * (0 if dotted == 0 else 1 if 20 * dotted < len(shapes) else 2) + bool((shapes >= KEYWORD).any())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping per kind; failing ones dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def _may_match(word: bytes) -> bool:
    low = word.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"apikey" in low or b"api_key" in low:
        return True
    return len(word) >= 20 and (b"AKIA" in word or HEX_BYTES.search(word) is not None)


class Field:
    """Weights: own, before, after (shapes x 3), mix (mixes x 3), file (classes x 3) and pair (3 x 3); labels 0 outside, 1 begin, 2 inside."""

    def __init__(self):
        self.own, self.before, self.after = (np.zeros((N_SHAPES + 2, 3)) for _ in range(3))
        self.mix, self.file, self.pair = np.zeros((N_MIXES + 1, 3)), np.zeros((N_FILES, 3)), np.zeros((3, 3))

    def tables(self):
        return self.own, self.before, self.after, self.mix, self.file, self.pair

    def scores(self, shapes: np.ndarray, before: np.ndarray, after: np.ndarray, mixes: np.ndarray, files: np.ndarray) -> np.ndarray:
        return self.own[shapes] + self.before[before] + self.after[after] + self.mix[mixes] + self.file[files]

    def fit(self, shapes: np.ndarray, mixes: np.ndarray, files: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """shapes, mixes, labels: windows x words (shape NOTHING, mix N_MIXES: no word there, label 0); files: windows. AdaGrad on the mean log-likelihood.

        Each window counts twice: as it is, and with all shapes and the file's keyword hidden.
        """
        words = shapes != NOTHING
        shapes = np.vstack([shapes, np.where(words, HIDDEN, NOTHING)])
        mixes, labels, files = np.vstack([mixes, mixes]), np.vstack([labels, labels]), np.concatenate([files, files & ~1])
        n, length = shapes.shape
        pad = np.full((n, 1), NOTHING)
        before, after = np.hstack([pad, shapes[:, :-1]]), np.hstack([shapes[:, 1:], pad])
        f = np.repeat(files[:, None], length, 1)
        square = [np.full_like(t, 1e-6) for t in self.tables()]
        for _ in range(rounds):
            e = self.scores(shapes, before, after, mixes, f)
            a, b = np.zeros((n, length, 3)), np.zeros((n, length, 3))
            add = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
            a[:, 0] = e[:, 0]
            for t in range(1, length):
                a[:, t] = e[:, t] + add(a[:, t - 1, :, None] + self.pair, 1)
            for t in range(length - 2, -1, -1):
                b[:, t] = add(self.pair + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            z = add(a[:, -1], 1)
            node = np.exp(a + b - z[:, None, None])
            grads = [np.zeros_like(t) for t in self.tables()]
            truth = np.eye(3)[labels] - node
            for g, where in zip(grads, (shapes, before, after, mixes, f), strict=False):
                for y in range(3):
                    g[:, y] = np.bincount(where.ravel(), weights=truth[:, :, y].ravel(), minlength=len(g))
            edges = np.exp(a[:, :-1, :, None] + self.pair + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
            grads[5] += np.bincount((3 * labels[:, :-1] + labels[:, 1:]).ravel(), minlength=9).reshape(3, 3) - edges.sum((0, 1))
            for t, g, s in zip(self.tables(), grads, square, strict=True):
                g = g / n - decay * t
                s += g * g
                t += rate * g / np.sqrt(s)
        return self

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Labels of the best path (Viterbi) through words x 3 scores, with outside before and after."""
        n = len(scores)
        best, back = scores[0] + self.pair[0], np.zeros((n, 3), np.int64)
        for t in range(1, n):
            to = best[:, None] + self.pair
            back[t] = to.argmax(0)
            best = to.max(0) + scores[t]
        path = [int((best + self.pair[:, 0]).argmax())]
        for t in range(n - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return np.array(path[::-1])

    def tag(self, shapes: np.ndarray, mixes: np.ndarray, files: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and labels of the words of many texts (words at[i]:at[i+1]) that are not outside."""
        n = len(shapes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before, after = np.full(n, NOTHING), np.full(n, NOTHING)
        before[1:], after[:-1] = shapes[:-1], shapes[1:]
        edges = at[:-1][np.diff(at) > 0]
        before[edges] = NOTHING
        after[edges[1:] - 1] = NOTHING
        e = self.scores(shapes, before, after, mixes, np.repeat(files, np.diff(at)))
        lead = e[:, 0] - e[:, 1:].max(1)
        # whatever its neighbours' labels, a word with a larger lead gains by being outside
        most = max((self.pair[:, y] - self.pair[:, 0]).max() + (self.pair[y] - self.pair[0]).max() for y in (1, 2))
        open_ = np.flatnonzero(lead <= most)
        doc = np.searchsorted(at, open_, side="right")
        cuts = np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc) > 0)) + 1
        places, labels = [], []
        for part in np.split(open_, cuts):
            if len(part):
                path = self.decode(e[part])
                places.append(part[path > 0])
                labels.append(path[path > 0])
        return (np.concatenate(places), np.concatenate(labels)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _split(texts: list) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    ids: dict[bytes, int] = {}
    out, at = [], [0]
    for text in texts:
        out += [ids.setdefault(w, len(ids)) for w in (text or "").encode().split()]
        at.append(len(out))
    return list(ids), np.array(out, np.int64), np.array(at)


def _labels(text: str, spans) -> list[int]:
    """A label for each word: the words with the secret itself (of assign, its value) are begin and inside."""
    secret = sorted([(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] + [(a, b) for a, k, b in spans if k])
    out, last, i = [], None, 0
    for m in WORDS.finditer(text):
        while i < len(secret) and secret[i][1] <= m.start():
            i += 1
        hit = secret[i] if i < len(secret) and secret[i][0] < m.end() else None
        out.append(0 if hit is None else 2 if hit == last else 1)
        last = hit
    return out


def _windows(reach: int, per_doc: int):
    """Windows of words for fitting: around up to per_doc labelled words and as many odd ones (with digits or keywords), spread over the document, and one elsewhere."""
    def spread(places):
        return places if len(places) <= per_doc else places[np.linspace(0, len(places) - 1, per_doc).astype(int)]

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            rows, known = [], {}  # type: ignore[var-annotated]
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or "").encode().split()
                if not words:
                    continue
                shapes, mixes, flagged = features(words, known).T
                spans = base_spans(text) if flagged.any() else []
                labels = np.array(_labels(text, spans)) if spans else np.zeros(len(words), np.int64)
                spots = np.flatnonzero(labels)
                odd = np.flatnonzero((shapes % 45 >= 5) | (shapes >= 45))
                centres = [*spread(spots), *spread(odd), int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) % len(words)]
                for c in centres:
                    s, x, y = np.full(2 * reach + 1, NOTHING), np.full(2 * reach + 1, N_MIXES), np.zeros(2 * reach + 1, np.int64)
                    a, b = max(0, c - reach), min(len(words), c + reach + 1)
                    for to, of in ((s, shapes), (x, mixes), (y, labels)):
                        to[a - c + reach : b - c + reach] = of[a:b]
                    rows.append((d, bool(len(spots)), file_class(shapes), s.tolist(), x.tolist(), y.tolist()))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], ["doc_id", "positive", "file", "shapes", "mixes", "labels"])
    return run


def fit(docs: DataFrame, sample_docs: int = 20_000, max_windows: int = 1_500, reach: int = 6, per_doc: int = 8) -> Field:
    """A field fitted on at most max_windows windows with and as many without secrets, from a seeded sample of about sample_docs documents with up to 2 * per_doc + 1 windows each."""
    total = docs.count()
    part = docs if total <= sample_docs else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_docs / total))
    rows = part.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_windows(reach, per_doc), "doc_id long, positive boolean, file long, shapes array<long>, mixes array<long>, labels array<long>")
    key = F.xxhash64("doc_id", "shapes")
    rows = materialize(rows, "windows")
    got = [r for want in (True, False) for r in rows.where(F.col("positive") == want).orderBy(key, "shapes", "labels").limit(max_windows).collect()]
    discard(rows)
    field = Field()
    field.pair[0, 2] = -4.0  # inside follows begin or inside
    if got:
        field.fit(np.array([r.shapes for r in got]), np.array([r.mixes for r in got]), np.array([r.file for r in got]), np.array([r.labels for r in got]))
    else:
        field.own[:, 0] = 20.0
    return field


def spans_of(texts: list, field: Field, known: dict | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, sorted; the field's spans do not touch the patterns' ones. known: features of words, kept between calls."""
    distinct, ids, at = _split(texts)
    if not len(ids):
        return [[] for _ in texts]
    by_word = features(distinct, {} if known is None else known)
    shapes, mixes, flagged = by_word[ids].T
    files = np.array([file_class(shapes[at[i] : at[i + 1]]) for i in range(len(texts))])
    hit = np.add.reduceat(np.append(flagged, 0), np.minimum(at[:-1], len(ids))) * (np.diff(at) > 0)
    out = [base_spans(t) if h else [] for t, h in zip(texts, hit, strict=True)]
    places, labels = field.tag(shapes, mixes, files, at)
    for i in np.unique(np.searchsorted(at, places, side="right") - 1):
        own = slice(*np.searchsorted(places, at[i : i + 2]))
        words = [m.span() for m in WORDS.finditer(texts[i])]
        found: list[list[int]] = []
        last = -2
        for p, label in zip((places[own] - at[i]).tolist(), labels[own].tolist(), strict=True):
            a, b = words[p]
            word = texts[i][a:b]
            a, b = a + len(word) - len(word.lstrip("\"'`.,;:!?()[]{}<>")), b - len(word) + len(word.rstrip("\"'`.,;:!?()[]{}<>"))
            if label == 2 and last == p - 1 and found:
                found[-1][1] = b
            else:
                found.append([a, b])
            last = p
        ends, last = [], 0  # the furthest end of the patterns' spans up to each
        for _, _, e in out[i]:
            last = max(last, e)
            ends.append(last)
        before = [bisect_left(out[i], (b,)) for _, b in found]
        out[i] = sorted(out[i] + [(a, 3, b) for (a, b), n in zip(found, before, strict=True) if a < b and (not n or ends[n - 1] <= a)])
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(field):
    def run(batches):
        import pyarrow as pa

        known: dict = {}
        for batch in slices(batches):
            found = spans_of(batch.column("text").to_pylist(), field.value, known)
            base = [[s for s in x if s[1] < 3] for x in found]
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(3)]
            shas = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, shas, pa.array([joined(x) for x in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each of docs (doc_id, text).

    A null or empty text has no spans; null ids and rows that repeat stay rows; an empty table gives none. Spans are
    kind:start:end in code points, end exclusive, by start and then kind.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs) if field is None else field)  # a few hundred numbers
    return docs.mapInArrow(_scan(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact(field, columns: list[str], mark: str):
    def run(batches):
        import pyarrow as pa

        known: dict = {}
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(spans_of(texts, field.value, known)):
                end, parts = 0, []
                for a, _, b in spans:
                    if b > end:
                        parts += [texts[i][end : max(a, end)], mark if a >= end else ""]
                        end = b
                if parts:
                    texts[i] = "".join(parts) + texts[i][end:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)
    return run


def redact(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark (overlapping spans by one); all rows stay, and n_chars, if there, follows the text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs) if field is None else field)
    out = docs.mapInArrow(_redact(model, docs.columns, mark), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
