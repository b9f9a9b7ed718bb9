"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features describe its characters and
words and those of the lines before and after; a chain links the states of
neighbouring lines.  Lines of a labelled document carry its label.  The
forward-backward marginals of the lines, weighted by line length, make a
document's mean; a logistic curve, fitted on documents left out of the
chain's training, turns it into the score.

The chain is fitted on the driver on ``SAMPLE_DOCS`` labelled documents at
most (the first by a hash of the id), of which a long one gives
``WINDOWS`` evenly spaced windows of ``WINDOW_LINES`` lines; scoring covers
every line of every document.  Labels, language, source and id are never
features.

Defined cases: null text is the empty text, which is one empty line and
gets a score like any other; without labels of both kinds the score is the
one label there is, or 1 without any; a document with several labels has
its least; documents of a null id are scored and not held out; equal texts
have equal scores; an empty table gives an empty result; other columns
pass by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tavolo.llm.common import text_of
from tavolo.llm.words import batches_of, find_words, mix, word_hashes

SAMPLE_DOCS = 6000
WINDOWS, WINDOW_LINES = 4, 64
CALIBRATION_SHARE = 0.25
STEPS, RATE, RIDGE = 300, 0.05, 1e-3
GOOD_FROM = 0.7            # score from which a document is predicted good
HELD_OUT = 2               # crc32(id) mod 4 of rows that are never learned from

SCORES = "doc_id long, score double"


def _class_sums(raw: np.ndarray, member: np.ndarray, start, end) -> np.ndarray:
    total = np.r_[0, np.cumsum(member[raw], dtype=np.int64)]
    return total[end] - total[start]


def _table(chars) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


UPPER, LOWER, DIGIT = _table(range(65, 91)), _table(range(97, 123)), _table(range(48, 58))
CLASSES = {"upper": UPPER, "lower": LOWER, "digit": DIGIT, "high": _table(range(0xC0, 256)), "pipe": _table(b"|"),
           "sign": _table(b"#*$%&<>{}[]=_~^\\@"), "bang": _table(b"!"), "stop": _table(b".,;:?"), "tail": _table(range(0x80, 0xC0))}


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, the index of its text, and its length in characters."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    end = np.flatnonzero(raw == 10)
    start = np.r_[0, end[:-1] + 1]
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    c = {k: _class_sums(raw, t, start, end) for k, t in CLASSES.items()}
    chars = (end - start) - c["tail"]
    w = find_words(texts)
    h = word_hashes(w, lower=True)
    line = np.searchsorted(end, w.start)
    n = len(end)
    words = np.bincount(line, minlength=n)
    same = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])] if len(h) else np.empty(0, bool)
    repeats = np.bincount(line[same], minlength=n)
    pairs = np.unique(mix(h + mix(line.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(line[pairs], minlength=n)
    # words the text holds more than once, by line
    _, inverse, count = np.unique(mix(h + mix(w.doc.astype(np.uint64) + np.uint64(9))), return_inverse=True, return_counts=True)
    often = np.bincount(line, weights=np.minimum(count[inverse] - 1, 20) / 20, minlength=n) if len(h) else np.zeros(n)
    per = np.maximum(chars, 1)
    letters = np.maximum(c["upper"] + c["lower"], 1)
    each = np.maximum(words, 1)
    own = np.stack([
        c["upper"] / letters, c["lower"] / per, np.minimum(c["digit"] / per, 0.5) * 2, c["high"] / per,
        np.minimum(c["pipe"] / each, 1), np.minimum(c["sign"] / each, 3) / 3, np.minimum(c["bang"] / each, 2) / 2,
        np.minimum(c["stop"] / each, 1), repeats / each, 1 - distinct / each, often / each,
        (c["pipe"] > 0), (c["sign"] > 2), (c["bang"] > 2), (c["upper"] > 0.8 * letters) & (letters > 8),
        np.minimum(per / each, 15) / 15, np.log1p(chars) / 8, np.log1p(words) / 6, (words == 0), (words == 1), (words > 100),
    ], axis=1).astype(np.float64)
    near = own[:, [0, 4, 5, 6, 8, 9, 10, 16]]
    first = np.r_[True, doc[1:] != doc[:-1]]
    last = np.r_[first[1:], True]
    before = np.where(first[:, None], 0, np.roll(near, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(near, -1, axis=0))
    ends = np.stack([first, last, first & last, np.ones(n)], axis=1)
    return np.concatenate([own, before, after, ends], axis=1), doc, chars


@dataclass
class Chain:
    """Weights of the good state's features, of staying and of starting, and the logistic curve."""
    weights: np.ndarray
    moves: np.ndarray        # 2 x 2, from state to state
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def _padded(rows: np.ndarray, doc: np.ndarray, n: int):
    """Lines by text, filled up to the longest: (texts, lines, ...) and the mask."""
    count = np.bincount(doc, minlength=n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros((n, max(int(count.max(initial=1)), 1), *rows.shape[1:]))
    mask = np.zeros(out.shape[:2], dtype=bool)
    out[doc, at] = rows
    mask[doc, at] = True
    return out, mask, at


def forward_backward(score: np.ndarray, mask: np.ndarray, moves: np.ndarray):
    """Marginals of the good state, expected moves, and the log partition of every chain.

    ``score``: (texts, lines) log weight of good against bad.
    """
    b, t = score.shape
    alpha = np.zeros((b, t, 2))
    alpha[:, 0, 1] = score[:, 0]
    for i in range(1, t):
        step = np.logaddexp(alpha[:, i - 1, :1] + moves[0], alpha[:, i - 1, 1:] + moves[1])
        step[:, 1] += score[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    beta = np.zeros((b, t, 2))
    for i in range(t - 2, -1, -1):
        ahead = beta[:, i + 1].copy()
        ahead[:, 1] += score[:, i + 1]
        step = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
        beta[:, i] = np.where(mask[:, i + 1, None], step, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    good = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None]) * mask
    pair = np.zeros((2, 2))
    for i in range(1, t):
        m = mask[:, i]
        for p in (0, 1):
            for q in (0, 1):
                e = alpha[m, i - 1, p] + moves[p, q] + beta[m, i, q] + (score[m, i] if q else 0) - z[m]
                pair[p, q] += np.exp(e).sum()
    return good, pair, z


def fit_chain(rows: np.ndarray, doc: np.ndarray, label: np.ndarray) -> Chain:
    """Penalised maximum likelihood of the labels, by Adam over all chains at once.

    A chain counts by the inverse of its number of lines, so that long texts do not rule.
    """
    n = len(label)
    x, mask, _ = _padded(rows, doc, n)
    lines = mask.sum(axis=1)
    weights, moves = np.zeros(rows.shape[1]), np.zeros((2, 2))
    y = mask * label[:, None]
    weight = (1 / np.maximum(lines, 1))[:, None]
    m = [np.zeros_like(weights), np.zeros_like(moves)]
    v = [np.zeros_like(weights), np.zeros_like(moves)]
    true_pair = np.zeros((2, 2))
    true_pair[0, 0] = np.maximum(lines - 1, 0)[label == 0].sum()
    true_pair[1, 1] = np.maximum(lines - 1, 0)[label == 1].sum()
    total = max(lines.sum(), 1)
    for step in range(1, STEPS + 1):
        good, pair, _ = forward_backward(x @ weights, mask, moves)
        slope = [np.einsum("bt,btf->f", (y - good) * weight, x) / n - RIDGE * weights,
                 (true_pair - pair) / total - RIDGE * moves]
        for i, (g, p) in enumerate(zip(slope, (weights, moves))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p += RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return Chain(weights, moves)


def document_means(chain: Chain, rows: np.ndarray, doc: np.ndarray, chars: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the lines' good marginals, as a log odds."""
    score = rows @ chain.weights
    count = np.bincount(doc, minlength=n)
    out = np.zeros(n)
    start = np.cumsum(count) - count
    order = np.argsort(count, kind="stable")
    at = 0
    while at < n:  # texts of like length share a padded block of bounded size
        end = at + 1
        while end < n and (end - at + 1) * count[order[end]] <= 200_000:
            end += 1
        part = order[at:end]
        lines = np.concatenate([np.arange(start[i], start[i] + count[i]) for i in part])
        owner = np.repeat(np.arange(len(part)), count[part])
        s, mask, _ = _padded(score[lines], owner, len(part))
        w, _, _ = _padded(chars[lines] + 1.0, owner, len(part))
        good, _, _ = forward_backward(s, mask, chain.moves)
        p = (good * w).sum(axis=1) / w.sum(axis=1)
        out[part] = np.log(np.clip(p, 1e-6, 1)) - np.log(np.clip(1 - p, 1e-6, 1))
        at = end
    return out


def fit_curve(mean: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the labels, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * mean + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((label - p) * mean).sum() - 0.01 * (a - 1), (label - p).sum() - 0.01 * b])
        h = np.array([[(w * mean * mean).sum() + 0.01, (w * mean).sum()], [(w * mean).sum(), w.sum() + 0.01]])
        da, db = np.linalg.solve(h, g)
        a, b = max(a + np.clip(da, -1, 1), 1e-3), b + np.clip(db, -1, 1)
    return float(a), float(b)


def _features(batches):
    for b in batches:
        ids, labels = b.column("doc_id").to_pylist(), b.column("label").to_pylist()
        texts = [(t or "").encode() for t in b.column("text").to_pylist()]
        for i, j in batches_of(texts):
            rows, doc, chars = line_features(texts[i:j])
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            for k in range(j - i):
                a, z = cut[k], cut[k + 1]
                if z - a > WINDOWS * WINDOW_LINES:
                    spans = [(int(s), int(s) + WINDOW_LINES) for s in np.linspace(a, z - WINDOW_LINES, WINDOWS)]
                else:
                    spans = [(s, min(s + WINDOW_LINES, z)) for s in range(a, z, WINDOW_LINES)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[i + k]] * len(spans), pa.int64()),
                    "label": pa.array([labels[i + k]] * len(spans), pa.int32()),
                    "part": pa.array([s for s, _ in spans], pa.int64()),
                    "rows": pa.array([rows[s:e].astype("<f4").tobytes() for s, e in spans], pa.binary()),
                    "chars": pa.array([chars[s:e].astype("<i8").tobytes() for s, e in spans], pa.binary())})


SAMPLE = "doc_id long, label int, part long, rows binary, chars binary"


def held_out(id_col) -> F.Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Chain:
    """Fit a chain on a bounded sample of the labelled rows that are not held out."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("label").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    # at most sample_docs ids
    found = text_of(docs).join(F.broadcast(known), "doc_id").mapInArrow(_features, SAMPLE).collect()
    found = sorted(found, key=lambda r: (r["doc_id"], r["part"]))
    kinds = {r["label"] for r in found}
    if len(kinds) < 2:
        return Chain(np.zeros(1), np.zeros((2, 2)), constant=float(kinds.pop()) if kinds else 1.0)
    width = line_features([b""])[0].shape[1]
    rows = [np.frombuffer(r["rows"], "<f4").reshape(-1, width).astype(float) for r in found]
    chars = [np.frombuffer(r["chars"], "<i8") for r in found]
    ids = sorted({r["doc_id"] for r in found})
    label = dict((r["doc_id"], r["label"]) for r in found)
    late = {d for i, d in enumerate(ids) if (i * 7919) % 100 < 100 * CALIBRATION_SHARE}
    learn = [i for i, r in enumerate(found) if r["doc_id"] not in late]
    if len({found[i]["label"] for i in learn}) < 2:
        learn, late = list(range(len(found))), set(ids)
    seq = np.repeat(np.arange(len(learn)), [len(rows[i]) for i in learn])
    chain = fit_chain(np.concatenate([rows[i] for i in learn]), seq, np.array([found[i]["label"] for i in learn]))
    rest = [i for i, r in enumerate(found) if r["doc_id"] in late]
    place = {d: k for k, d in enumerate(sorted(late))}
    seq = np.repeat([place[found[i]["doc_id"]] for i in rest], [len(rows[i]) for i in rest])
    mean = document_means(chain, np.concatenate([rows[i] for i in rest]), seq, np.concatenate([chars[i] for i in rest]), len(place))
    chain.slope, chain.shift = fit_curve(mean, np.array([label[d] for d in sorted(late)]))
    return chain


def score_texts(chain: Chain, texts: list[bytes]) -> np.ndarray:
    """Scores of a batch of texts."""
    if chain.constant is not None:
        return np.full(len(texts), chain.constant)
    out = []
    for i, j in batches_of(texts):
        rows, doc, chars = line_features(texts[i:j])
        mean = document_means(chain, rows, doc, chars, j - i)
        out.append(1 / (1 + np.exp(-np.clip(chain.slope * mean + chain.shift, -30, 30))))
    return np.concatenate(out) if out else np.empty(0)


def score_documents(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score_texts(chain, texts))],
                                             names=["doc_id", "score"])
    scored = text_of(docs, id_col, text_col).mapInArrow(run, SCORES)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns untouched, whose text scores as good."""
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(text_col).cast(pa.string()).to_pylist()]
            yield b.filter(pa.array(score_texts(chain, texts) >= GOOD_FROM, pa.bool_()))
    return docs.mapInArrow(run, schema)
