"""The training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tavolo.llm import bpe, lines, minhash, packing, pii, quality, rules, suffix, topk, urls
from tavolo.sources import Tables

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   \n\t", "a", "Hello<|endoftext|>World <|startoftext|>", "ΣΑΣ don't WE'LL", "a\x1cb c\x85d\xa0e",
       "½² 12 3a", "ab" * 3000, "!!!???...'s't can't", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +1 (555) 123-4567",
       "4111 1111 1111 1111", "x " * 500, "same text\nsame text\nsame text", "same text\nsame text\nsame text", "日本 🙂 é"]


def documents(spark, texts):
    """A table of documents with columns that clash with names used inside."""
    rows = [(i, t, f"s{i % 3}", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key int, spans string")


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    return Tables(spark, small_dir).documents


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_bpe_equals_the_library(spark, odd, docs, texts):
    library = Tokenizer.from_file(VOCABULARY)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in [*enumerate(ODD)]}
    for r in bpe.encode_documents(odd, VOCABULARY).collect():
        assert list(r.ids) == want[r.doc_id]
        assert r.decoded == library.decode(want[r.doc_id], skip_special_tokens=False)
    for r in bpe.encode_digests(docs, VOCABULARY).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_merge_rounds_take_one_occurrence_where_order_matters():
    tables = bpe.load_tables(VOCABULARY)
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    words = ["".join(rng.choice("aeinst") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    got = [bpe.numbers(b) for b in bpe.encode_words(tables, [w.encode() for w in words])]
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(i for i in texts if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_equal_all_pairs(spark, docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_one_family_and_edges(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    some = []
    for _ in range(60):  # copies with ever more changed words: links, chains and near misses
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        some.append(" ".join(w))
    some += ODD
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, some)).collect()}
    assert got == brute_components(dict(enumerate(some)))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for rank, (kind, p) in enumerate(zip(pii.BASE, plain)):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(2)
    some = ODD + ["".join(rng.choice("0123456789+.-() @aB_%\n'é🙂") for _ in range(rng.randrange(90))) for _ in range(300)]
    some += ["1" * 3000, "a" * 50000, "+" + "1" * 20000, "x@y." * 700, "1.1.1.1 " * 600]
    for r in pii.span_digests(documents(spark, some)).collect():
        want = base_spans(some[r.doc_id])
        said = ",".join(f"{k}:{a}:{z}" for a, _, z, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in want) for k in pii.BASE)
        assert not want or all(s in r.spans.split(",") for s in said.split(","))


def test_redaction_cuts_exactly_the_spans(spark):
    rows = documents(spark, ["mail a@b.cd now 10.0.0.1!", "clean text", None])
    got = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert got == {0: "mail [EMAIL] now [IP]!", 1: "clean text", 2: None}
    assert pii.redact(rows).columns == rows.columns


def test_secrets_are_added_and_distractors_left(spark):
    rng = random.Random(7)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1" for _ in range(60)]
    some = [f'here token = "{h}" end' for h in hexes] + [f"count 4000000000000{i:03d} ok" for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.span_digests(documents(spark, some)).collect()}
    assert all(got[i].startswith("secret:14:54") for i in range(60))
    assert all("secret" not in got[i] for i in range(60, 120))


def test_secrets_stay_found_beside_quoted_hashes(spark):
    rng = random.Random(8)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1" for _ in range(90)]
    # a third of the rows holds quoted hashes of the shape of the secrets, more than the secrets themselves
    some = [f'here token = "{h}" end' for h in hexes[:20]] + [f'the sum is "{h}" end' for h in hexes[20:60]]
    some += [f"plain text {i} of no interest" for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.span_digests(documents(spark, some)).collect()}
    assert all(got[i] == "secret:14:54" for i in range(20))
    assert all(got[i] == "" for i in range(20, 120))
    clean = {r.doc_id: r.text for r in pii.redact(documents(spark, some)).collect()}
    assert all(clean[i] == 'here token = "[SECRET]" end' for i in range(20))
    assert all(clean[i] == some[i] for i in range(20, 120))


def test_a_text_has_the_same_secrets_in_tables_of_any_size(spark):
    rng = random.Random(9)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1" for _ in range(60)]
    some = [f'here token = "{h}" end' for h in hexes]
    for n in (1, 3, 60):
        got = {r.doc_id: r.spans for r in pii.span_digests(documents(spark, some[:n])).collect()}
        assert got == {i: "secret:14:54" for i in range(n)}
    for n in (1, 3, 60):  # the threshold asks for no number of candidates either
        assert pii.boost([((1, 1), n, n)], [2, 2])[1] < float("inf")
    assert pii.boost([((1, 1), 3, 2)], [2, 2])[1] == float("inf")
    assert pii.boost([((0, 0), 3, 3), ((0, 1), 1, 0)], [1, 1])[1] == float("inf")  # equal scores pass together


def test_the_trees_decide_on_assigned_runs(spark):
    """Assigned words are no secrets, assigned random runs are: without the trees both or neither would be added."""
    rng = random.Random(12)
    words = ["installation_guide_page_2", "internationalization-of-the-menu7", "configurationdirectory0"]
    some = [f"the token: {w}, see" for w in words * 20]
    some += [f"the token: {''.join(rng.choice('0123456789abcdef') for _ in range(40))}, see" for _ in range(5)]
    frame = documents(spark, some)
    got = {r.doc_id: r.spans for r in pii.span_digests(frame).collect()}
    assert all(got[i] == "" for i in range(60)) and all(got[i] == "secret:11:51" for i in range(60, 65))
    found = pii.find_spans(frame.select("doc_id", "text"))
    models = pii.train(found)
    models["secret"] = ([], models["secret"][1])
    none = {r.doc_id: r.n for r in pii.detect(frame.select("doc_id", "text"), {
        "number": models["number"], "secret": ([("leaf", 0.0)], models["secret"][1])}).selectExpr(
        "doc_id", "size(spans) as n").collect()}
    assert sum(none.values()) != 5


def test_cards_with_other_separators_are_added(spark):
    some = ["card 4111.1111.1111.1111 here", "card 5500.0000.0000.0004 here", "code 1234.5678.1234.5678 x"]
    some += [f"code 12{i:02d}.5678.1234.5671 x" for i in range(10, 40) if not luhn(f"12{i:02d}567812345671")]
    got = {r.doc_id: r.spans for r in pii.span_digests(documents(spark, some)).collect()}
    assert got[0] == "number:5:24" and got[1] == "number:5:24"
    assert all("number" not in got[i] for i in range(2, len(some)))


def test_long_runs_are_candidates_too(spark):
    rng = random.Random(10)
    runs = ["".join(rng.choice("abcdefXYZ_-") for _ in range(a)) + "7" + "".join(rng.choice("abcXYZ019") for _ in range(b))
            for a, b in ((0, 255), (0, 256), (0, 341), (41, 20), (300, 2000), (5, 200000))]
    got = {r.doc_id: r.spans for r in pii.span_digests(documents(spark, [f'a token = "{s}" end' for s in runs])).collect()}
    assert got == {i: f"secret:11:{11 + len(s)}" for i, s in enumerate(runs)}
    digits = {"1" * 24: 1, "1" * 25: 1, "1" * 90: 1, "12 " + "3" * 30: 1, "1" * 25 + "x": 0, "1-" * 20000 + "1": None,
              ("1" * 25 + "-") * 8000 + "a": None}
    d = documents(spark, list(digits)).withColumn("text", F.coalesce("text", F.lit("")))
    many = {r.doc_id: r.n for r in pii.find_spans(d.select("doc_id", "text")).select(
        "doc_id", F.expr("size(filter(more, m -> m.kind = 'number'))").alias("n")).collect()}
    assert all(want is None or many[i] == want for i, want in enumerate(digits.values()))
    assert many[6] == 8000


def test_topk_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 9)) * rng.uniform(0.2, 3, size=(400, 1))
    x[100:140] = x[0]  # ties
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    rows += [(400, None, "x"), (401, [1.0, None], "x"), (402, [float("nan")], "x"), (403, [float("inf")], "x"), (404, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm string")
    got = collections.defaultdict(list)
    for r in topk.top_inner_products(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(256 * x).astype(np.int64)
    q = np.vstack([q, np.zeros((1, 9), np.int64)])
    ids = np.r_[np.arange(400), 404]
    for i in range(0, 400, 50):
        s = q @ q[i]
        order = sorted((j for j in range(401) if j != i), key=lambda j: (-s[j], ids[j]))[:5]
        assert got[i] == [(int(ids[j]), int(s[j])) for j in order]
    assert len(got) == 8
    assert topk.top_inner_products(df.where("false")).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(i, f"own text {i} here\nAll rights reserved.", f"s{i}", i, 7, 8, [1], "x", "y") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __doc int, __n_lines int, __n_cut int, "
                                     "__cut array<int>, `all` string, line string")
    got = lines.cut_lines(df)
    assert got.columns == [*df.columns, "___n_lines", "___n_cut"]
    out = {r.doc_id: tuple(r) for r in got.collect()}
    assert out[0][1].endswith("reserved.") and out[5][1] == "own text 5 here"
    assert out[5][3:] == (5, 7, 8, [1], "x", "y", 2, 1)


def test_line_dedup_edges(spark):
    line = "All rights reserved."
    rows = [(i, f"own text {i} here\n {line}\r", f"site{i}", "z") for i in range(12)]
    rows += [(12, None, "site1", "z"), (13, "", "site1", "z"), (None, line, "site2", "z"), (14, "short\nshort", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, line string")
    got = [(r.doc_id, r.text, r["__n_cut"]) for r in lines.cut_lines(df).collect()]
    assert (0, rows[0][1], 0) in got
    assert all((i, f"own text {i} here", 1) in got for i in range(1, 12))
    assert (12, None, 0) in got and (13, "", 0) in got and (None, line, 0) in got and (14, "short\nshort", 0) in got
    assert lines.cut_lines(df.where("false")).count() == 0


def test_quality_on_held_out_rows(spark, small_dir):
    t = Tables(spark, "/root/testdata/sf0.01")
    chain = quality.train(t.documents, t.labels)
    r = quality.score_documents(t.documents, chain).join(t.labels, "doc_id").where("held_out").toPandas()
    assert (r.predicted == r.quality).mean() >= 0.9
    assert r.predicted[r.quality == 1].mean() >= 0.97
    assert r.score.between(0, 1).all()


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = quality.train(odd, labels)
    assert {r.score for r in quality.score_documents(odd, chain).collect()} == {1.0}
    chain = quality.Chain(np.full(quality.line_features([b""])[0].shape[1], 0.1), np.zeros((2, 2)))
    scored = {r.doc_id: r.score for r in quality.score_documents(odd, chain).collect()}
    assert len(scored) == len(ODD) and scored[0] == scored[1] and scored[13] == scored[14]
    assert quality.score_documents(none, chain).count() == 0
    assert quality.keep_good(odd, quality.Chain(np.zeros(1), np.zeros((2, 2)), constant=1.0)).columns == odd.columns


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    score, moves = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for bits in range(32):
        y = [(bits >> i) & 1 for i in range(5)]
        w = np.exp(sum(score[0, i] for i in range(5) if y[i]) + sum(moves[y[i], y[i + 1]] for i in range(4)))
        total += w
        good += w * np.array(y)
    got, _, z = quality.forward_backward(score, np.ones((1, 5), bool), moves)
    assert np.allclose(got[0], good / total) and np.allclose(z, np.log(total))


def test_rules_equal_brute_force(spark):
    rng = random.Random(3)
    some = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randrange(70))) for _ in range(120)] + ["x y " * 80]
    for r in rules.quality_rules(documents(spark, some)).collect():
        t = some[r.doc_id] or ""
        w = WORD.findall(t)
        n = len(w)
        count = collections.Counter(tuple(w[k:k + 3]) for k in range(n - 2))
        repeat = {k + j for k in range(n - 2) if count[tuple(w[k:k + 3])] > 1 for j in range(3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        failed = n < 50 or 100 * len(repeat) > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(repeat), failed)
        if n <= 200:
            def common(a, b):
                k = 0
                while max(a, b) + k < n and w[a + k] == w[b + k]:
                    k += 1
                return k
            depth = [max([common(a, b) for b in range(n) if b != a], default=0) for a in range(n)]
            covered = {a + j for a in range(n) if depth[a] >= rules.REPEAT_WORDS for j in range(depth[a])}
            assert r.longest_repeat == max(depth, default=0)
            assert r.repeat_covered == pytest.approx(len(covered) / max(n, 1))
        assert not (r.base_failed and r.kept)


def brute_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        left = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("length", [10, 60])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(suffix, "SLICE_CONTENTS", 3)  # keys are split down to single windows
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(3)]
    some = list(ODD)
    for _ in range(150):
        a, b = rng.randrange(200), rng.choice(base)
        some.append("".join(rng.choice("abcd ") for _ in range(rng.randrange(60))) + b[a:a + rng.randrange(160)]
                    + "".join(rng.choice("abcd ") for _ in range(rng.randrange(60))))
    got = {r.doc_id: tuple(r)[1:5] for r in suffix.remove_repeats(documents(spark, some), length).collect()}
    assert [got[i] for i in range(len(some))] == brute_removal(some, length)


def test_index_family_levels_grow_geometrically():
    rng = np.random.default_rng(2)
    family, seen, length = suffix.IndexFamily(6), collections.Counter(), 6
    raws = [rng.integers(97, 100, 60).astype(np.uint8) for _ in range(50)]
    for i, raw in enumerate(raws):
        start = np.arange(55)
        family.add(raw, start, start % 2)       # windows under two keys match inside a key alone
        seen.update((k % 2, raw[k:k + length].tobytes()) for k in start)
    sizes = [len(p) for p, _ in family.levels]
    assert len(sizes) < 8 and sizes == sorted(sizes, reverse=True)
    want = [seen[k % 2, raw[k:k + length].tobytes()] > 1 for raw in raws for k in range(55)]
    assert family.matched.tolist() == want
    family.forget(54 * 50)
    assert len(family.raw) <= 60 and len(family.start) == len(family.matched) == 50


def test_packing_is_gapless_and_tight(spark, docs, odd, none, texts, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 40)  # several partitions and rounds
    library = Tokenizer.from_file(VOCABULARY)
    r = packing.pack_documents(docs, VOCABULARY).toPandas().sort_values(["sequence_id", "offset"])
    for _, x in r.groupby("sequence_id"):
        ends = (x.offset + x.length).tolist()
        assert x.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= packing.SEQUENCE_TOKENS
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for p in r[r.doc_id == i].itertuples():
            assert zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        assert r[r.doc_id == i].length.sum() == len(ids)
    bound = -(-r.length.sum() // packing.SEQUENCE_TOKENS)
    assert r.sequence_id.nunique() <= 1.05 * bound + 1
    assert packing.pack_documents(odd, VOCABULARY).count() >= len(ODD)
    assert packing.pack_documents(none, VOCABULARY).count() == 0


def test_urls_edges(spark):
    rows = [(1, "http://A.ORG/x", None), (2, "https://www.example.org/es/1", ""), (3, "x.com/fr/", None), (4, None, None),
            (5, "http://b.com/de/", '<a href="http://good.net/">'), (6, "http://b.com/en", "<a>"), (7, "http://lone.net", ""),
            (8, "http://example.org", ""), (9, "http://bad.net/", '<a href="http://b.com/x">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow")
    assert got[2] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][3] == "block" and got[7] == ("lone.net", "", None, "allow")
    assert got[8] == ("example.org", "", None, "block") or got[8][2] is None
    assert got[9][3] == "block"  # points at a blocked host
    assert urls.judge_urls(df.where("false")).count() == 0


def test_empty_tables(none):
    assert bpe.encode_digests(none, VOCABULARY).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert pii.span_digests(none).count() == 0
    assert rules.quality_rules(none).count() == 0
    assert suffix.remove_repeats(none).count() == 0


def test_pipeline_stages(spark, small_dir):
    import corpus_pipeline as cp
    docs = Tables(spark, small_dir).documents
    n = docs.count()
    assert [f.__name__ for _, f in cp.STAGES] == ["good_documents", "without_boilerplate", "one_of_each_group",
                                                  "without_personal_data", "packed"]
    out = cp.run(spark, small_dir).toPandas()
    assert 0 < out.doc_id.nunique() <= n and set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    stage = cp.one_of_each_group(spark, docs, small_dir)
    kept_ids = {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in stage.collect()} == kept_ids and stage.columns == docs.columns
    clean = cp.without_personal_data(spark, docs, small_dir)
    assert clean.count() == n and clean.where(F.col("text").rlike(r"@mail[0-9]\.example\.com")).count() == 0
