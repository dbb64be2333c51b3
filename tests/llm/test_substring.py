import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import awkward_rows
from tilewright.llm import kernel, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    least = {}
    lists = [(r[0] if r[0] is not None else 1 << 63, WORD.findall(r[1] or "")) for r in rows]
    for i, w in lists:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(i, least.get(key, i))
    out = Counter()
    for (i, w), r in zip(lists, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        spans = tuple((m.start(), m.end() - 1) for m in re.finditer("1+", "".join("01"[g] for g in gone)))
        out[(r[0], len(w), sum(gone), spans, kept, hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("width", [13, 3, 1])
def test_repeats(awkward, nothing, monkeypatch, width):
    monkeypatch.setattr(substring, "SIZE", 2000)  # many batches
    got = substring.remove_repeats(awkward, width).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, tuple((x.first, x.last) for x in r.removed), r.kept, r.kept_sha256) for r in got) == brute(awkward_rows(), width)
    assert substring.remove_repeats(nothing, width).collect() == []


def test_hash_blocks_agree(monkeypatch):
    import pyarrow as pa

    texts = pa.array([r[1] for r in awkward_rows()])
    whole = kernel.words(texts)
    grams = kernel.windows(whole.hash, 5)
    monkeypatch.setattr(kernel, "BLOCK", 50)
    parts = kernel.words(texts)
    assert (whole.hash == parts.hash).all() and (grams == kernel.windows(parts.hash, 5)).all()
    by_text = {}
    for i in range(len(whole.hash)):
        by_text.setdefault(whole.text(i), set()).add(int(whole.hash[i]))
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) == len(np.unique(whole.hash))
    assert [whole.text(i).decode() for i in range(len(whole.start))] == [x for r in awkward_rows() for x in WORD.findall(r[1] or "")]


def test_one_hash_of_different_windows(monkeypatch):
    import pyarrow as pa

    plain, calls = kernel.windows, []

    def clash(hashes, width):
        calls.append(1)
        out = plain(hashes, width)
        return out & kernel.U(7) if len(calls) % 2 else out  # the first hash of a batch agrees all the time

    monkeypatch.setattr(substring, "windows", clash)
    texts = [" ".join(f"w{k}x{i}" for k in range(40)) for i in range(30)]
    b = substring._Batch(pa.array([*range(30), 99]), pa.array([*texts, texts[3]]), 3, 1000)
    assert len(b.hash) == 30 * 38 and (b.least[b.kind] < b.ids[b.of]).sum() == 38
    bucket = np.repeat(b.full, np.diff(b.begin))
    assert max(Counter(zip(b.hash[b.by_bucket].tolist(), bucket.tolist(), strict=True)).values()) < 8


def test_words_that_agree_under_any_polynomial(spark):
    """A Thue-Morse word and its complement have the same polynomial modulo 2**64 for every base."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    tail = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join([one, *tail])), (2, " ".join([other, *tail])), (3, " ".join([one, *tail]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}


def test_batches_and_buckets_of_any_size(spark, monkeypatch):
    """Many batches, many buckets, and rows that send a few hashes at once give the same rows."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join([*(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))), *([passage] if i % 3 == 0 else [])])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(substring.remove_repeats(docs).collect())
    for name, value in (("SIZE", 1024), ("BUCKET", 256), ("SENT", 64)):
        monkeypatch.setattr(substring, name, value)
    assert sorted(substring.remove_repeats(docs).collect()) == want
