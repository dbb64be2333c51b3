import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import awkward_rows, prose
from tilewright.llm import decontaminate

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def brute(docs, items, least=0.8):
    out = Counter()
    wd = lambda x: WORD.findall((x or "").lower().encode())
    for d, t in docs:
        w = wd(t)
        for i, s in items:
            it = wd(s)
            n = min(5, len(it))
            if not it:
                continue
            grams = lambda x, n=n: Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
            own, best = grams(it), (0, 0)
            for k in range(len(w) - len(it) + 1):
                c = grams(w[k : k + len(it)])
                m = sum((c & own).values())
                best = max(best, (m / (2 * sum(own.values()) - m), -k))
            if best[0] >= least:
                out[(d, i, -best[1], len(it), round(best[0], 9))] += 1
    return out


def test_against_all_windows(spark, awkward, nothing):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 4, 5, 6, 12, 30, 30, 45])]
    items += [(20, items[6][1]), (21, items[6][1].upper() + "!"), (22, ""), (23, None), (None, items[7][1]), (24, "word " * 12)]
    docs = [(100 + k, prose(rng, 40) + " " + t.replace(" ", ", ") + ". " + prose(rng, 30)) for k, (_, t) in enumerate(items) if t]
    long = items[8][1].split()
    docs += [(200, " ".join(long[2:]) + " tail end"), (201, " ".join(long[:20] + ["other"] + long[21:])), (202, " ".join(long[6:])), (203, items[6][1] + " " + items[6][1]), docs[0]]
    docs += [(r[0], r[1]) for r in awkward_rows()]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in got) == brute(docs, items)
    assert max(r.distance for r in got) <= decontaminate.RADIUS
    bad = {(d, t) for d, t in docs if any(k[0] == d for k in brute([(d, t)], items))}
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in docs if x not in bad)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(awkward, none).collect() == [] and decontaminate.clean(awkward, none).count() == awkward.count()
    some = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.contaminated(nothing, some).collect() == [] and decontaminate.clean(nothing, some).collect() == []
    assert decontaminate.clean(awkward, some).columns == awkward.columns


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    rng = random.Random(9)
    items = [(i, prose(rng, 20)) for i in range(5)]
    docs = [(i, prose(rng, 9) + " " + t) for i, t in items] + [(99, prose(rng, 50))]
    some = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, some).collect()} == {(i, i) for i in range(5)}
    assert [r.doc_id for r in decontaminate.clean(frame, some).collect()] == [99]


@pytest.mark.parametrize("held,pairs", [(1 << 21, 1 << 21), (40, 100)])
def test_blocks_miss_nothing_within_the_radius(monkeypatch, held, pairs):
    monkeypatch.setattr(decontaminate, "HELD", held)
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    index = decontaminate.Index(list(range(50)), [prose(random.Random(i), 24) for i in range(50)])
    known = index.lengths[24].prints
    probes = known[rng.integers(0, 50, 400)].copy()
    bits = np.unpackbits(probes.view(np.uint8), axis=1)
    for row in bits:
        row[rng.choice(128, rng.integers(0, 45), replace=False)] ^= 1
    probes = np.packbits(bits, axis=1).view(np.uint16)
    window, item, distance = index.candidates(24, probes)
    full = np.asarray([[bin(int.from_bytes((p ^ k).tobytes(), "little")).count("1") for k in known] for p in probes])
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*np.nonzero(full <= decontaminate.RADIUS), strict=True))
    assert (full[window, item] == distance).all()


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(10,2)", "double", "boolean", "date", "timestamp", "timestamp_ntz", "binary", "string"])
def test_item_ids_of_any_type(spark, kind):
    values = {"boolean": "true", "date": "DATE'2024-02-29'", "timestamp": "TIMESTAMP'2024-02-29 01:02:03.456789'", "timestamp_ntz": "TIMESTAMP_NTZ'2024-02-29 01:02:03'", "binary": "X'00FF10'", "string": "'x''y'"}
    text = "one two three four five six seven"
    items = spark.sql(f"SELECT CAST({values.get(kind, '7')} AS {kind}) AS item_id, '{text}' AS text UNION ALL SELECT NULL, 'nothing of that kind here at all'")
    docs = spark.createDataFrame([("d", f"so {text} it is")], "doc_id string, text string")
    got = decontaminate.contaminated(docs, items)
    assert got.schema["item_id"].dataType.simpleString() == kind
    assert got.join(items.where("item_id IS NOT NULL"), "item_id").count() == got.count() == 1


def test_repeated_shingles_are_judged_by_their_count(spark):
    rng = random.Random(5)
    masked = " ".join(["mask"] * 15)
    items, docs = [], []
    for i in range(12):
        words = prose(rng, 104).split()
        items.append((i, " ".join(words)))
        at = rng.randint(10, 80)
        docs.append((i, prose(rng, 20) + " " + " ".join(words[:at] + masked.split()[:9] + words[at + 9 :]) + " tail"))
        # the other way round: the item holds the run
        items.append((100 + i, " ".join(words[::-1][:50] + masked.split() + words[:39])))
        docs.append((100 + i, " ".join(words[::-1][:50] + prose(rng, 3).split() + masked.split()[3:] + words[:39])))
        # a run at an end costs fewer shingles
        items.append((200 + i, " ".join(rng.choice("abcdefgh") * 3 + str(k) for k in range(104))))
        docs.append((200 + i, " ".join(items[-1][1].split()[:93] + ["mask"] * 11)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute(docs, items)
    assert Counter((r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in got) == want
    assert sum(d >= 200 for d, *_ in want) == 12
