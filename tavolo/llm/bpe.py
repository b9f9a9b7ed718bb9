"""BPE encoding and decoding in batched numpy merge rounds.

The vocabulary file is the ``tokenizers`` JSON layout: a BPE model over
byte symbols with a word-end mark, a normalizer of NFC and lower case, a
split into runs of letters, single numbers, runs of signs and the English
contractions, and special tokens matched in the raw text.  White space
never enters a token, so Arrow cuts a group of texts at ASCII blanks and
numbers the distinct chunks; each is encoded once and the texts' ids are
gathered from the chunks' by numpy.  Words met before are remembered.

``merge_words`` is the core: the symbols of many words lie in one flat
array.  Each round looks up every adjacent pair by binary search in the
sorted pair keys, takes each word's lowest rank and merges its
occurrences, left to right without overlap, for all words at once.

Defined cases: null text is the empty text; the empty text has no tokens,
the digest of the empty string and decodes to the empty text; repeated
rows are encoded each on its own; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tavolo.llm.common import broadcast_once, text_of

WORD_END = "</w>"
# Entries of a cache generation (results do not depend on it).
CACHE_WORDS = 200_000
# Bytes of text that are encoded together (a longer text is a group of its own).
GROUP_BYTES = 1 << 23
# Symbols merged together in one flat array (a longer word is an array of its own).
BATCH_SYMBOLS = 1 << 19
NO_RANK = np.int32(2**31 - 1)
# Texts of these characters need no Unicode tables: NFC leaves them as they are, and
# lower case stays among them.  Fixed value: the vocabulary file's split, for such texts.
SIMPLE = re.compile("[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")
SIMPLE_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \t-\ra-zß-öø-ſ0-9]+"
# The same over chunks that each end with a line feed.
SIMPLE_LINES = re.compile(SIMPLE_WORDS + "|\n")
# Ends the ids of a chunk; no id is as large.
MARK = 2**32 - 1


def byte_symbols() -> list[str]:
    """The printable stand-in character of each byte value (the byte-level alphabet)."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return [out[b] for b in range(256)]


@dataclass
class BpeTables:
    """What encoding needs of a vocabulary file; size fixed by the vocabulary."""
    tokens: list[str]            # id -> token text
    first: np.ndarray            # byte -> id inside a word
    last: np.ndarray             # byte -> id at a word's end
    pair_keys: np.ndarray        # sorted left * size + right
    pair_ranks: np.ndarray
    rank_product: np.ndarray     # rank -> id of the merged symbol
    rank_single: np.ndarray      # rank -> True: merge one occurrence a round
    specials: dict[str, int]
    rules: str                   # normalizer and split of the file, as a vocabulary-free file

    @property
    def size(self) -> int:
        return len(self.tokens)


def load_tables(path: str) -> BpeTables:
    """Read a vocabulary file (on the driver; the tables are broadcast)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab = dict(model["vocab"])
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *specials.values()]) + 1
    tokens = [""] * size
    for t, i in [*vocab.items(), *specials.items()]:
        tokens[i] = t
    sym = byte_symbols()
    first = np.array([vocab[s] for s in sym], dtype=np.int64)
    last = np.array([vocab[s + WORD_END] for s in sym], dtype=np.int64)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
    product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    ranks = np.arange(len(pairs), dtype=np.int32)
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    # A product that takes part in an earlier merge must be merged onward before
    # the next occurrence of its pair: such merges go one occurrence a round.
    earliest = np.full(size, len(pairs), dtype=np.int64)
    np.minimum.at(earliest, left, ranks)
    np.minimum.at(earliest, right, ranks)
    rules = json.dumps(spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
    return BpeTables(tokens, first, last, keys[order], ranks[order], product,
                     earliest[product] < ranks, specials, rules)


def _ranks(tables: BpeTables, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of the pair that starts at each of the positions ``at`` (``NO_RANK`` where none)."""
    right = np.minimum(at + 1, len(sym) - 1)
    keys = sym[at] * tables.size + sym[right]
    found = np.searchsorted(tables.pair_keys, keys)
    found[found == len(tables.pair_keys)] = 0
    hit = (tables.pair_keys[found] == keys) & (word[at] == word[right]) & (at < len(sym) - 1)
    return np.where(hit, tables.pair_ranks[found], NO_RANK)


def merge_words(tables: BpeTables, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of many words (``word`` ascending) until no pair is left.

    Returns the final symbols and their words, in the same order.  Only
    pairs beside a merged symbol are looked up again in the next round.
    """
    done_sym, done_word = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rank = _ranks(tables, sym, word, np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        low = np.repeat(lowest, np.diff(np.r_[starts, len(sym)]))
        finished = low == NO_RANK
        if finished.any():
            done_sym.append(sym[finished])
            done_word.append(word[finished])
            go = ~finished
            sym, word, rank, low = sym[go], word[go], rank[go], low[go]
            if not len(sym):
                break
        at = np.flatnonzero(rank == low)
        # neighbours both picked are runs of one symbol: take every second, from the left
        step = np.r_[True, np.diff(at) > 1]
        run = np.maximum.accumulate(np.where(step, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        single = tables.rank_single[rank[at]]
        if single.any():
            again = np.r_[False, word[at[1:]] == word[at[:-1]]]
            at = at[~(single & again)]
        sym[at] = tables.rank_product[rank[at]]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        sym, word, rank = sym[keep], word[keep], rank[keep]
        at -= np.arange(len(at))
        rank[at] = _ranks(tables, sym, word, at)
        before = at[at > 0] - 1
        rank[before] = _ranks(tables, sym, word, before)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def encode_words(tables: BpeTables, words: list[bytes]) -> list[bytes]:
    """Ids of each non-empty word (its UTF-8 bytes) as little-endian 32-bit numbers, in batches of bounded symbols."""
    out: list[bytes] = []
    at = 0
    while at < len(words):
        n, end = 0, at
        while end < len(words) and (end == at or n + len(words[end]) <= BATCH_SYMBOLS):
            n += len(words[end])
            end += 1
        part = words[at:end]
        size = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        raw = np.frombuffer(b"".join(part), dtype=np.uint8)
        sym = tables.first[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = tables.last[raw[ends]]
        sym, word = merge_words(tables, sym, np.repeat(np.arange(len(part)), size))
        flat = sym.astype("<u4").tobytes()
        stop = (4 * np.cumsum(np.bincount(word, minlength=len(part)))).tolist()
        out += [flat[i:j] for i, j in zip([0, *stop], stop)]
        at = end
    return out


def numbers(ids: bytes) -> list[int]:
    """The ids in a string of little-endian 32-bit numbers."""
    return np.frombuffer(ids, "<u4").tolist()


class Encoder:
    """Encodes texts; remembers the words seen by one task.

    The cache has two generations of ``CACHE_WORDS`` entries: when the
    young one is full it becomes the old one, and words met again move
    back, so frequent words stay and memory is bounded.
    """

    def __init__(self, tables: BpeTables):
        self.tables = tables
        self.rules = Tokenizer.from_str(tables.rules)
        self.special = re.compile("|".join(map(re.escape, sorted(tables.specials, key=len, reverse=True)))) \
            if tables.specials else None
        self.to_bytes = {ord(c): b for b, c in enumerate(byte_symbols())}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pretokens(self, chunk: str) -> list:
        """Words (text) and special ids of a chunk, in order."""
        if self.special is None or "<" not in chunk:
            return self._plain(chunk)
        out: list = []
        at = 0
        for m in self.special.finditer(chunk):
            out += self._plain(chunk[at:m.start()])
            out.append(self.tables.specials[m[0]])
            at = m.end()
        return out + self._plain(chunk[at:])

    def _plain(self, text: str) -> list[str]:
        # the file's own normalizer and split, with the library's Unicode tables
        pieces = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
        return [p.translate(self.to_bytes).encode("latin-1").decode() for p, _ in pieces]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The cache's young generation, with every one of ``words``; unknown ones are encoded together."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        new = words - self.young.keys()
        met = new & self.old.keys()
        self.young.update(zip(met, map(self.old.__getitem__, met)))
        new = list(new - met)
        self.young.update(zip(new, encode_words(self.tables, [w.encode() for w in new])))
        return self.young

    def chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunks in one flat array, and the start and the length of each chunk's there."""
        simple = [i for i, c in enumerate(chunks) if "<" not in c and SIMPLE.fullmatch(c)]
        other = sorted(set(range(len(chunks))).difference(simple))
        parts = SIMPLE_LINES.findall("".join([f"{chunks[i]}\n" for i in simple]).lower())
        for i in other:
            parts += self.pretokens(chunks[i])
            parts.append("\n")
        distinct = set(parts) - {"\n"}
        words = {w for w in distinct if isinstance(w, str)}
        known = self.learn(words)
        ids = dict(zip(words, map(known.__getitem__, words)))
        ids.update((i, i.to_bytes(4, "little")) for i in distinct - words)
        ids["\n"] = MARK.to_bytes(4, "little")
        flat = np.frombuffer(b"".join(map(ids.__getitem__, parts)), "<u4")
        ends = np.flatnonzero(flat == MARK)
        begins = np.r_[0, ends + 1][:-1]
        start, size = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        at = np.array(simple + other, dtype=np.int64)
        start[at], size[at] = begins, ends - begins
        return flat, start, size

    def groups(self, texts: pa.Array):
        """``(first text, ids, offsets)`` of groups of texts of bounded length; offsets has a text more than the group."""
        texts = pc.fill_null(texts, "")
        size = np.asarray(pc.binary_length(texts)).tolist()
        at = 0
        while at < len(texts):
            n, end = 0, at
            while end < len(texts) and (end == at or n + size[end] <= GROUP_BYTES):
                n += size[end]
                end += 1
            lists = pc.ascii_split_whitespace(texts.slice(at, end - at))
            chunks = lists.flatten().dictionary_encode()
            flat, start, length = self.chunk_ids(chunks.dictionary.to_pylist())
            code = np.asarray(chunks.indices)
            length = length[code]
            stop = np.r_[0, np.cumsum(length)]
            take = np.repeat(start[code] - stop[:-1], length)
            take += np.arange(len(take))
            yield at, flat[take], stop[np.asarray(lists.offsets)]
            at = end

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return next(self.groups(pa.array([text])))[1].tolist()


def decode(tokens: list[str], ids) -> str:
    """Tokens joined by one space, special ones included (the file has no decoder)."""
    return " ".join([tokens[i] for i in ids])


def _joined(names: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For each text, the names of its ids joined by one space (``decode`` of a group of texts)."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(ids))),
                          pa.scalar(" ", pa.large_string()))


ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _mapper(tables, make):
    def run(batches):
        gc.disable()  # many live objects and no cycles: a collection finds nothing
        enc = Encoder(tables.value)
        names = pa.array(enc.tables.tokens, pa.large_string())
        for b in batches:
            for at, ids, offsets in enc.groups(b.column("text")):
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(at, len(offsets) - 1),
                                                  **make(names, ids, offsets)})
    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text: ``doc_id, ids, decoded``."""
    def make(names, ids, offsets):
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))),
                "decoded": _joined(names, ids, offsets).cast(pa.string())}
    tables = broadcast_once(docs, load_tables, path)
    return text_of(docs, id_col, text_col).mapInArrow(_mapper(tables, make), ENCODED)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of ids and decoded text, without shipping either out of the task."""
    def sha(strings):
        return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in strings], pa.string())

    def make(names, ids, offsets):
        digits = pa.array([str(i) for i in range(len(names))], pa.large_string())
        return {"n_tokens": pa.array(np.diff(offsets), pa.int64()),
                "ids_sha256": sha(_joined(digits, ids, offsets)), "decoded_sha256": sha(_joined(names, ids, offsets))}
    tables = broadcast_once(docs, load_tables, path)
    return text_of(docs, id_col, text_col).mapInArrow(_mapper(tables, make), DIGESTS)
