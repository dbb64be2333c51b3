import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import awkward_rows, prose
from tilewright.llm import components, dart, near_dup

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def bag(text):
    w = WORD.findall((text or "").lower().encode())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(rows, least=0.8):
    """Class of each (id, text) by comparing all pairs."""
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= least:
                a, b = sorted((top(i), top(j)), key=lambda x: rows[x][0])
                up[b] = a
    return Counter((rows[i][0], rows[top(i)][0]) for i in range(len(rows)))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(7)
    g = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = rng.integers(0, 4, 300) * 1.0, rng.integers(0, 4, 300) * 1.0
    b[:250] = a[:250]
    a[5] = 2.5
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    rows = [np.flatnonzero(x) for x in (a, b)]
    s = dart.signatures(np.concatenate([g[r] for r in rows]), np.repeat([0, 1], [len(r) for r in rows]), np.concatenate([x[r] for x, r in zip((a, b), rows, strict=True)]), 3, 2000)
    assert abs((s[0] == s[1]).mean() - true) < 0.05
    assert (s[2] == np.uint64(2**64 - 1)).all() and not (s[:2] == np.uint64(2**64 - 1)).any()


def test_signatures_of_parts_agree(monkeypatch):
    rng = np.random.default_rng(8)
    g, d = rng.integers(0, 2**63, 500, dtype=np.uint64), np.sort(rng.integers(0, 40, 500))
    w = rng.integers(1, 5, 500) * 1.0
    whole = dart.signatures(g, d, w, 40, 130)
    monkeypatch.setattr(dart, "CELLS", 1000)
    assert (whole == dart.signatures(g, d, w, 40, 130)).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    up = {}
    for a, b in edges:
        if a != b:
            x, y = {up.get(a, a)}, {up.get(b, b)}
            low = min(x | y)
            gone = x | y
            for k in [*up, a, b]:
                if up.get(k, k) in gone:
                    up[k] = low
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == up


def variants(n_groups, n_each):
    rng = random.Random(11)
    rows = []
    for _ in range(n_groups):
        words = [prose(rng, 1) + str(rng.randint(0, 999)) for _ in range(150)]
        for _ in range(n_each):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = str(rng.random())
            rows.append((len(rows), " ".join(w)))
    return rows


def test_classes_against_all_pairs(spark):
    rows = variants(12, 8) + [(1000 + i, t) for i, (_, t) in enumerate(variants(2, 3))]
    got = Counter(map(tuple, near_dup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize("heads", [2, 1, 0])
def test_strangers_meet(spark, monkeypatch, heads):
    """Buckets with several classes, compared by heads, in blocks, or by blocks only: still every link."""
    rows = variants(6, 10)
    monkeypatch.setattr(near_dup, "HEADS", heads)
    monkeypatch.setattr(near_dup, "SHINGLES", 450)
    got = Counter(map(tuple, near_dup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), least=0.93).collect()))
    assert got == brute(rows, 0.93)


def test_awkward(awkward, nothing):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    # an id with two texts: each row by its own words
    got = Counter(map(tuple, near_dup.classes(awkward).collect()))
    want = brute([r for r in rows if r[0] is not None])
    want[(None, None)] += 2
    assert got == want
    assert near_dup.classes(nothing).collect() == []


def test_keep_one(awkward, nothing):
    kept = near_dup.keep_one(awkward)
    assert kept.columns == awkward.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(got.values()) == 1
    assert sum(1 for i, _ in got if i is None) == 2
    classes = {r.doc_id: r.class_id for r in near_dup.classes(awkward).collect() if r.doc_id not in (None, 3)}
    assert {i for i, _ in got if i not in (None, 3)} == {c for i, c in classes.items() if i == c}
    assert near_dup.keep_one(nothing).collect() == []


def test_one_row_of_each_class_stays(spark):
    """Rows that share an id, rows of one id and text, and rows that are equal in all."""
    rng = random.Random(9)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(3, a, "x"), (3, b, "x"), (1, b, "y"), (2, a + " tail", "z"), (4, c, "x"), (4, c, "y"), (4, c, "y"), (5, c + " tail", "x"), (6, None, "x"), (6, None, "x"), (7, "!", "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, more string").repartition(3)
    got = Counter(map(tuple, near_dup.keep_one(docs).collect()))
    fours = [r for r in got if r[0] == 4]
    assert len(fours) == 1 and got.pop(fours[0]) == 1 and fours[0][1] == c
    assert got == Counter([(1, b, "y"), (2, a + " tail", "z"), *rows[8:]])
    assert near_dup.keep_one(docs.repartition(1)).where("doc_id = 4").first() == fours[0]
    assert Counter(map(tuple, near_dup.classes(docs).where("doc_id IS NOT NULL").collect())) == brute([r[:2] for r in rows if r[0] is not None])


@pytest.mark.parametrize("heads", [2, 0])
def test_ids_with_many_texts(spark, monkeypatch, heads):
    """Near copies whose ids all repeat: each row by its own words, in rounds of heads and in blocks."""
    monkeypatch.setattr(near_dup, "HEADS", heads)
    rows = [(i % 7, t) for i, t in variants(5, 8)]
    got = Counter(map(tuple, near_dup.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize("words", [1, 2, 4, 5])
def test_short(spark, words):
    text = " ".join("abcdefg"[:words])
    rows = [(1, text), (2, text.upper() + "!"), (3, text + " zz")]
    got = Counter(map(tuple, near_dup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == brute(rows)
