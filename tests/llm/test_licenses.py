"""Whole licence texts in other clothes, and near misses, against a plain Python look-up."""

import hashlib
import random
import textwrap
from collections import Counter

from tests.llm.conftest import awkward_rows
from tests.llm.test_native import canonical
from tilewright.llm import licenses


def dressed(rng, text):
    """The text in another case, wrapped anew, with other punctuation, a copyright line, a comment's margin, and British spellings."""
    for a, b in rng.sample(licenses.SPELLINGS, 6):
        text = text.replace(b, a)
    text = rng.choice([str.upper, str.lower, str.title, str])(text)
    if rng.random() < 0.5:
        lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, rng.choice([40, 72, 100]), break_long_words=False, break_on_hyphens=False), ""]]
        # a line that begins like a copyright line would be taken for one: such texts are left as they were wrapped
        if canonical("\n".join(lines)) == canonical(text):
            text = "\n".join(lines)
    margin = rng.choice(["", " * ", "# ", "// "])
    text = "\n".join(margin + x for x in text.split("\n"))
    return rng.choice(["", "Copyright (c) 2001-2024 The Authors <a@b.example>\nAll rights reserved.\n\n", "© 1999 Somebody\n"]) + text.replace(",", rng.choice([",", " ,", ";"]))


def shortened(text):
    """The text without one word of its middle."""
    at = [i for i, w in enumerate(text.split(" ")) if w.isalpha()]
    return " ".join(w for i, w in enumerate(text.split(" ")) if i != at[len(at) // 2])


def brute(docs):
    known = {}
    for k, t in sorted(licenses.known(), reverse=True):
        known[canonical(t)] = k
    out = Counter()
    for i, t in docs:
        c = canonical(t)
        hits = [known[x] for x in map(canonical, (t or "").split("\n")) if x in known]
        out[(i, hashlib.sha256(c.encode()).hexdigest() if c else None, known.get(c) if c else None, tuple(sorted(set(hits))), len(hits))] += 1
    return out


def found(docs, table):
    return Counter((r.doc_id, r.digest, r.license, tuple(r.notices), r.n_notice_lines) for r in licenses.scan(docs, table).collect())


def test_planted(spark):
    rng = random.Random(12)
    full = [(k, t) for k, t in licenses.known() if len(t) > 500]
    assert {k for k, _ in full} >= {"Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "MIT", "ISC", "CC0-1.0", "Zlib", "BSL-1.0", "Unlicense"}
    docs = [(i, dressed(rng, t)) for i, (_, t) in enumerate(full)]
    near = [(1000 + i, shortened(t)) for i, (_, t) in enumerate(full)]
    near += [(2000 + i, f"{t}\n\nmore") for i, (_, t) in enumerate(full)] + [(3000 + i, t) for i, (_, t) in enumerate(licenses.known()) if len(t) <= 500]
    frame = spark.createDataFrame([*docs, *docs[:3], *near], "doc_id bigint, text string").repartition(5)
    got = found(frame, licenses.known_table(spark))
    assert got == brute([*docs, *docs[:3], *near])
    by = {r[0]: r[2] for r in got}
    assert [by[i] for i in range(len(full))] == [k for k, _ in full]
    assert not any(by[i] for i in by if 1000 <= i < 3000)


def test_awkward(spark, awkward, nothing):
    table = licenses.known_table(spark)
    assert found(awkward, table) == brute([(r[0], r[1]) for r in awkward_rows()])
    assert licenses.scan(nothing, table).collect() == []
    got = licenses.scan(awkward, table)
    assert got.columns == [*[c for c in awkward.columns if c not in ("text", "digest")], "digest", "license", "notices", "n_notice_lines"]
    assert Counter(r.row for r in got.collect()) == Counter(r[5] for r in awkward_rows())


def test_a_folder_of_texts(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Own  Licence,\nterms.")
    (tmp_path / "notes.md").write_text("other")
    table = licenses.from_folder(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "OWN LICENSE\nterms"), (2, "other")], "doc_id bigint, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs, table).collect()} == {1: "Own-1.0", 2: None}


def test_known_table_is_broadcast(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = licenses.scan(docs, licenses.known_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2
