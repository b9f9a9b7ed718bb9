"""The pipeline's stages against plain versions, each on what the one before kept, and on odd tables."""

import os
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tavolo.llm import lines, packing, quality
from tavolo.sources import Tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


@pytest.fixture(scope="module")
def stages(spark, small_dir):
    """Rows before the first stage and after every stage."""
    docs = Tables(spark, small_dir).documents
    out, folder = [docs.select(*cp.COLUMNS).collect()], tempfile.mkdtemp(prefix="tavolo-pipe-")
    for i, (_, stage) in enumerate(cp.STAGES):
        path = os.path.join(folder, str(i))
        stage(spark, docs, small_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_quality_keeps_what_the_classifier_accepts(spark, small_dir, stages):
    t = Tables(spark, small_dir)
    score = {r.doc_id: r.predicted for r in
             quality.score_documents(t.documents, quality.train(t.documents, t.labels)).collect()}
    assert sorted(map(tuple, stages[1])) == sorted(tuple(r) for r in stages[0] if score[r.doc_id])
    good = {r.doc_id for r in t.labels.where("quality = 1").collect()}
    left = {r.doc_id for r in stages[1]}
    assert len(good & left) >= 0.97 * len(good)


def test_line_dedup_cuts_lines_of_many_sites(stages):
    sites, first = {}, {}
    for r in stages[1]:
        for pos, raw in enumerate((r.text or "").split("\n") if r.text is not None else []):
            line = raw.strip(" \t\r")
            if len(line) >= lines.MIN_CHARS:
                sites.setdefault(line, set()).add(r.source)
                first[line] = min(first.get(line, (r.doc_id, pos)), (r.doc_id, pos))
    want = {}
    for r in stages[1]:
        keep = [raw for pos, raw in enumerate(r.text.split("\n"))
                if len(sites.get(raw.strip(" \t\r"), ())) < lines.MIN_SITES or first[raw.strip(" \t\r")] == (r.doc_id, pos)]
        want[r.doc_id] = "\n".join(keep)
    assert {r.doc_id: r.text for r in stages[2]} == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_dedup_keeps_one_of_each_group(stages):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in stages[2]:
        w = WORD.findall(r.text.translate(table))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(map(tuple, stages[3])) == sorted(tuple(r) for r in stages[2] if find(r.doc_id) == r.doc_id)


def test_personal_data_goes_and_the_rest_stays(stages):
    assert [r.doc_id for r in sorted(stages[4])] == [r.doc_id for r in sorted(stages[3])]
    before = {r.doc_id: r.text for r in stages[3]}
    marked = 0
    for r in stages[4]:
        assert not re.search(EMAIL, r.text)
        # what stands between the marks is the text as it was, in order
        at = 0
        for part in re.split(r"\[(?:EMAIL|IP|CARD|PHONE|NUMBER|SECRET)\]", r.text):
            at = before[r.doc_id].index(part, at) + len(part)
        marked += r.text != before[r.doc_id]
    assert 0 < marked < len(stages[4])


def test_packing_holds_every_token_once(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for p in stages[5]:
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == {r.doc_id for r in stages[4]}
    for r in stages[4]:
        ids = library.encode(r.text, add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.piece):
            assert p.start == at
            assert zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    ends = {}
    for p in sorted(stages[5], key=lambda p: p.offset):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= packing.SEQUENCE_TOKENS


def test_odd_tables(spark, small_dir):
    """Null and empty texts, null ids, repeated rows, other columns, and no rows at all."""
    folder = tempfile.mkdtemp(prefix="tavolo-odd-")
    t = Tables(spark, small_dir)
    some = t.documents.select(*cp.COLUMNS).withColumn("row", F.lit(1))
    odd = spark.createDataFrame([(900_001, None, "en", "s", None, 2), (900_002, "", None, None, 0, 2), (None, "a b", "en", "s", 3, 2),
                                 (900_003, "mail me@x.org " * 40, "en", "s", 1, 2), (900_003, "mail me@x.org " * 40, "en", "s", 1, 2)],
                                some.schema)
    some.unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    t.labels.write.parquet(f"{folder}/labels.parquet")
    out = cp.run(spark, folder)
    assert out.count() > 0 and out.columns[:3] == ["doc_id", "piece", "start"]
    empty = tempfile.mkdtemp(prefix="tavolo-none-")
    some.where("false").write.parquet(f"{empty}/documents.parquet")
    t.labels.where("false").write.parquet(f"{empty}/labels.parquet")
    assert cp.run(spark, empty).count() == 0
