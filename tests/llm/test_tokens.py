import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import awkward_rows
from tilewright.llm import bpe, huffman, token_count, word_bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
WORD = token_count.read_definition(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    made = bpe.PerfectHash.build(keys)
    assert sorted(made.keys) == sorted(keys)
    assert sorted(made.slot(k) for k in keys) == list(range(5000))
    assert made.slot(b"stranger") == -1 and bpe.PerfectHash.build([]).slot(b"a") == -1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 'srt\n\t\x1c\x85\xa0²Σ_.,19"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_bpe_as_the_library(text):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = codec.encode(text)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(RANKS), special_tokens={}) if not hasattr(test_bpe_as_the_library, "e") else test_bpe_as_the_library.e
    test_bpe_as_the_library.e = own
    assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_runs_of_a_long_text(monkeypatch, reference):
    monkeypatch.setattr(bpe, "RUN", 7)
    text = " ".join(r[1] or "" for r in awkward_rows()[:12])
    codec = bpe.Codec(bpe.parse_ranks(RANKS), public_tokenizers.PATTERN, bpe.PerfectHash.build(list(bpe.parse_ranks(RANKS))))
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_operator(awkward, nothing, reference):
    out = bpe.encode_decode(awkward, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "lang", "ids"))
    assert out.columns == ["doc_id", "lang", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]
    got = Counter((r.doc_id, bytes(r.ids), r.n_tokens, r.ids_sha256, bytes(r.decoded), r.decoded_sha256) for r in out.collect())
    want = Counter()
    for r in awkward_rows():
        ids = reference.encode_ordinary(r[1] or "")
        raw = (r[1] or "").encode()
        want[(r[0], np.asarray(ids, "<u4").tobytes(), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), raw, hashlib.sha256(raw).hexdigest())] += 1
    assert got == want
    assert bpe.encode_decode(nothing, RANKS, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abAB 'st.,\n\x1c\x85\xa0ΣİẞǺ²1<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_ids_as_the_library(text):
    made = word_bpe.encoder(WORD)
    assert made.by_chunk
    assert made.encode([text])[0] == np.asarray(made.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_word_ids_when_the_table_is_full(monkeypatch, library):
    monkeypatch.setattr(word_bpe, "KEPT", 20)
    made = word_bpe.Encoder(WORD)
    texts = [r[1] for r in awkward_rows()]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (200, 10), (64, 4)])
def test_token_counts(awkward, nothing, library, chunk, overlap):
    got = Counter(map(tuple, token_count.count_tokens(awkward, WORD, limit=100, chunk=chunk, overlap=overlap).collect()))
    want = Counter()
    for r in awkward_rows():
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 100)] += 1
    assert got == want
    assert token_count.count_tokens(nothing, WORD, chunk=chunk, overlap=overlap).collect() == []


def test_places_inside_a_token_are_no_splices():
    class Across:  # takes "c d" for one token
        by_chunk = True

        def encode(self, texts=None, add_special_tokens=True):
            if isinstance(texts, list):
                return [b"    " * len(t.split()) for t in texts]
            self.offsets = [(0, 1), (2, 3), (4, 7), (8, 9)]
            return self

    e = Across()
    e.tokenizer = e
    got = token_count._one(e, "a b c d e", 100, 9, False, False)
    assert got == {"total": 4, "left": [(101, 1), (103, 2), (107, 3)], "right": [(101, 1), (103, 2), (107, 3)]}


def test_spans_overlap_and_cover():
    for n in (0, 1, 99, 100, 101, 190, 191, 1000):
        parts = token_count.spans(n, 100, 10)
        assert parts[0][0] == 0 and parts[-1][1] == n
        assert all(a[1] - b[0] == 10 for a, b in zip(parts, parts[1:], strict=False))


def test_code_lengths_are_optimal_and_bounded():
    rng = random.Random(3)
    for n in (1, 2, 3, 10, 300):
        counts = np.asarray([0] + [rng.randint(1, 10**rng.randint(1, 6)) for _ in range(n)])
        lengths = huffman.code_lengths(counts, 10)
        used = lengths[lengths > 0]
        assert len(used) == n and lengths[0] == 0 and used.max() <= 10
        assert n == 1 or sum(2.0**-x for x in used.tolist()) == 1
    skewed = np.asarray([2**i for i in range(20)])
    assert huffman.code_lengths(skewed, 30).tolist() == [19, 19, 18, 17, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1]
    assert huffman.code_lengths(skewed, 8).max() == 8


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = (rng.pareto(0.7, n) * 3).astype(np.int64) % 4000
        counts = np.bincount(ids, minlength=4000) + (np.arange(4000) < 2)
        lengths = huffman.code_lengths(counts)
        codes, table = huffman.canonical(lengths)
        bits, marks = huffman.pack(ids, codes, lengths)
        assert huffman.unpack(bits, np.asarray(marks, np.int64), n, table).tolist() == ids.tolist()


def test_token_files(awkward, nothing, library):
    got = huffman.round_trip(awkward, WORD, end_id=1).collect()
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {r[1]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(ids[r[1]]), zlib.crc32(np.asarray(ids[r[1]], "<u4").tobytes())) for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # in ascending order of ids, without gaps
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert huffman.round_trip(nothing, WORD, end_id=1).collect() == []
