"""Quality rules with suffix-array repetition.

Base statistics count word characters, signs, repeated lines and words in
repeated 3-word windows.  The method sorts each text's word suffixes (the
suffix arrays of a batch of texts together, by prefix doubling; a text's
number is part of its word codes, so suffixes of two texts never tie).  The longest
common prefixes of neighbours in that order give the LCP intervals of the
maximal repeated substrings; their spans are united.  A text fails when
repeats of at least ``REPEAT_WORDS`` words cover too large a share of its
words, or when the longest repeat is too long.

Defined cases: null or blank text has no words and fails the base rules;
equal texts are judged alike; a text of any length is sorted whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tavolo.llm.common import text_of
from tavolo.llm.words import batches_of, find_words, mix, word_hashes

SYMBOLS = b"#*$%&|<>"      # fixed values of the base rule
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WORDS = 4           # shortest repeat that counts as covered
MAX_COVERED = 0.30         # of a text's words
MAX_LONGEST = 0.20         # longest repeat, of a text's words

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, repeat_covered double, longest_repeat long")


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """For each entry of sorted keys, the index of the first equal one."""
    i = np.arange(len(sorted_keys))
    return np.maximum.accumulate(np.where(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]], i, 0))


def longest_repeats(word: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position, the words of its suffix that also start elsewhere in its text.

    ``word``: codes that differ between texts; ``end``: one past the last
    position of each position's text.  A rank is the place of a suffix's
    group in the suffix array; prefix doubling refines groups of more than
    one.  The LCP of neighbours is read off the ranks of the doublings,
    longest first; the larger of the two LCPs beside a suffix is the
    depth of the deepest LCP interval it lies in.
    """
    n = len(word)
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    order = np.argsort(word, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group_starts(word[order])
    live = np.arange(n)
    levels, tied, width = [], None, 1
    while True:
        live = live[np.bincount(rank[live], minlength=n)[rank[live]] > 1]
        if tied is None:
            tied = live
        if not len(live):
            break
        levels.append((width, rank))
        after = live + width
        second = np.where(after < end[live], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[live] * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        place = live[order]
        group = rank[place]
        rank = rank.copy()
        rank[place] = group + group_starts(key[order]) - group_starts(group)
        width *= 2
    if not levels:
        return best
    sa = tied[np.argsort(rank[tied], kind="stable")]
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(a), dtype=np.int64)
    for width, r in reversed(levels):
        # a suffix that is used up stands on another text's first word or past the array
        same = (a < n) & (b < n)
        same[same] = r[a[same]] == r[b[same]]
        lcp += same * width
        a += same * width
        b += same * width
    np.maximum.at(best, sa[:-1], lcp)
    np.maximum.at(best, sa[1:], lcp)
    return best


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's words."""
    total = np.r_[0, np.cumsum(values)]
    return total[first[1:]] - total[first[:-1]]


def _covered(lengths: np.ndarray) -> np.ndarray:
    """Positions inside the union of the spans [i, i + lengths[i])."""
    n = len(lengths)
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(lengths)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths[at], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of a batch of texts (UTF-8)."""
    w = find_words(texts)
    n_texts, n = len(texts), len(w.start)
    # code points: bytes that are not UTF-8 continuations
    points = np.r_[0, np.cumsum((w.raw & 0xC0) != 0x80)]
    signs = np.zeros(256, dtype=bool)
    signs[list(SYMBOLS)] = True
    sign_sum = np.r_[0, np.cumsum(signs[w.raw])]
    bounds = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, n_texts) + 1)]
    h = word_hashes(w)
    end = np.repeat(w.first[1:], np.diff(w.first))
    own = h + mix(w.doc.astype(np.uint64) + np.uint64(1))
    # words in 3-word windows that the text holds twice or more
    repeat = np.zeros(n, dtype=bool)
    if n >= 3:
        tri = mix(mix(mix(own[:-2]) + own[1:-1]) + own[2:])
        at = np.flatnonzero(np.arange(n - 2) + 3 <= end[:-2])
        _, inverse, count = np.unique(tri[at], return_inverse=True, return_counts=True)
        at = at[count[inverse] > 1]
        for j in range(3):
            repeat[at + j] = True
    depth = longest_repeats(mix(own), end)
    covered = _covered(np.where(depth >= REPEAT_WORDS, depth, 0))
    longest = np.zeros(n_texts, dtype=np.int64)
    np.maximum.at(longest, w.doc, depth)
    dup = np.zeros(n_texts, dtype=np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        dup[i] = len(lines) - len(set(lines))
    words = np.diff(w.first)
    return {"n_words": words, "word_chars": _per_text(points[w.end] - points[w.start], w.first),
            "n_symbols": sign_sum[bounds[1:]] - sign_sum[bounds[:-1]], "n_dup_lines": dup,
            "n_repeat_words": _per_text(repeat.astype(np.int64), w.first),
            "covered": _per_text(covered.astype(np.int64), w.first) / np.maximum(words, 1), "longest": longest}


def _run(batches):
    for b in batches:
        texts = [(t or "").encode() for t in b.column("text").to_pylist()]
        parts = [measure(texts[i:j]) for i, j in batches_of(texts)]
        if not parts:
            continue
        m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        # a repeat counts against a text from REPEAT_WORDS words on
        long_ = np.where(m["longest"] >= REPEAT_WORDS, m["longest"], 0)
        kept = ~failed & (m["covered"] <= MAX_COVERED) & (long_ <= MAX_LONGEST * m["n_words"])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(m[k].astype(np.int64)) for k in
                                   ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
             pa.array(failed), pa.array(kept), pa.array(m["covered"]), pa.array(m["longest"])],
            names=[c.split()[0] for c in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every whole text."""
    return text_of(docs, id_col, text_col).mapInArrow(_run, SCHEMA)
