"""Suffix dedup: passages that very many texts share, null and repeated ids, whole slices in bounded batches."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tavolo.llm import suffix


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode(errors="replace")))
    return out


@pytest.mark.parametrize("limit", [4, 64, 100_000])
def test_a_passage_in_very_many_texts(spark, monkeypatch, limit):
    """Shared passages just under, at and over the length, with other words around: far more contents than a slice."""
    monkeypatch.setattr(suffix, "SLICE_CONTENTS", limit)
    rng = random.Random(limit)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(n) for n in (90, 99, 100, 112, 160)]
    texts = [noise(rng.randrange(150)) + rng.choice(passages) + noise(rng.randrange(150)) for _ in range(300)]
    texts += [None, "", noise(50), texts[3], texts[3], "é" * 90, "é" * 90]
    ids = [rng.choice([None, 7, *range(400)]) for _ in texts]
    df = spark.createDataFrame([(i, t, "x", b"r", 1) for i, t in zip(ids, texts)],
                               "doc_id long, text string, row string, packed binary, key int")
    got = sorted((tuple(r) for r in suffix.remove_repeats(df, 100).collect()), key=str)
    assert got == sorted(((i, *r) for i, r in zip(ids, brute(texts, 100))), key=str)
    assert suffix.remove_repeats(df.where("false"), 100).collect() == []


def test_pieces_of_equal_windows_share_their_key():
    rng = random.Random(9)
    shared = bytes(rng.choice(b"abc") for _ in range(300))
    data, place, want = [], [], collections.defaultdict(set)
    for _ in range(40):
        left, right = rng.randrange(60), rng.randrange(60)
        cut = rng.randrange(80)
        body = bytes(rng.choice(b"xyz") for _ in range(left)) + shared[cut:cut + 130] + bytes(
            rng.choice(b"xyz") for _ in range(right))
        data.append(body)
        place.append(-(left + 90 - cut))        # the anchor is byte 90 of the passage
    windows = np.array([len(d) - 100 + 1 for d in data])
    ok = windows > 0
    data = [d for d, k in zip(data, ok) if k]
    place, windows = np.array(place)[ok], windows[ok]
    for step in (50, 10, 1):
        seg, begin, n, key, content = suffix.split_pieces(data, np.zeros(len(data), np.int64), windows, place, 100, step)
        assert sorted(zip(seg, begin)) == sorted(set(zip(seg, begin)))
        assert np.bincount(seg, n).tolist() == windows.tolist()     # every window is in one piece
        keys = collections.defaultdict(set)
        for s, b, m, k in zip(seg.tolist(), begin.tolist(), n.tolist(), key.tolist()):
            for w in range(b, b + m):
                keys[data[s][w:w + 100], place[s] + w].add(k)
        assert all(len(k) == 1 for k in keys.values())


def test_slices_hold_the_open_slice_alone():
    rng = np.random.default_rng(5)
    slices, spans, held = suffix.Slices(20), [], []
    rows = []
    for key in range(200):
        n = 200 if key == 50 else rng.integers(1, 6)                # one slice goes over many batches
        rows += [(key, bytes(rng.integers(97, 99, 40).astype(np.uint8)), f"{key}-{i}".encode(), 0) for i in range(n)]
    for at in range(0, len(rows), 37):
        part = rows[at:at + 37]
        key = np.array([r[0] for r in part])
        if slices.rows and slices.key != key[0]:
            spans += slices.close()
        slices.batch(key, [r[1] for r in part], [r[2] for r in part], np.zeros(len(part), np.int64),
                     np.full(len(part), 21), np.ones(len(part), bool))
        spans += slices.close(key[-1])
        held.append(len(slices.family.raw))
    spans += slices.close()
    count = collections.Counter((k, d[i:i + 20]) for k, d, _, _ in rows for i in range(21))
    want = set()
    for k, d, name, _ in rows:
        want |= {(name, i) for i in range(21) if count[k, d[i:i + 20]] > 1}
    assert {(n, i) for n, a, z in spans for i in range(a, z - 19)} == want
    assert held[0] < 40 * 10 and held[-1] < 40 * 10
