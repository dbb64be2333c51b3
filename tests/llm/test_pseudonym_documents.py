"""Pseudonyms over whole documents, against a plain Python scanner with its own patterns and its own permutations."""

import datetime
import random
import re
from collections import Counter

from tests.llm.conftest import SCHEMA, awkward_rows, prose
from tests.llm.test_native import KEY, feistel, letters, luhn, mod97
from tilewright.llm import pseudonym, queries

START = datetime.date(1900, 1, 1)


def email(m):
    name, host = m.split("@")
    head, top = host.rsplit(".", 1)
    return letters("name", name) + "@" + letters("host", head) + "." + top


def refilled(form, value, kind=str.isdigit):
    it = iter(value)
    return "".join(next(it) if kind(c) else c for c in form)


def card(m):
    d = re.sub("[^0-9]", "", m)
    if not luhn(d):
        return m
    body = letters("card", d[:-1])
    return refilled(m, body + next(c for c in "0123456789" if luhn(body + c)))


def iban(m):
    v = m.replace(" ", "")
    if mod97(v) != 1:
        return m
    account = letters("iban", v[4:])
    check = next(f"{c:02}" for c in range(2, 99) if mod97(f"{v[:2]}{c:02}{account}") == 1)
    return refilled(m, v[:2] + check + account, str.isalnum)


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return m
    a, b = feistel("ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{a + 1 + (a >= 665):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


def ip(m):
    o = list(map(int, m.split(".")))
    if max(o) > 255:
        return m
    a, b = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def phone(m):
    d = re.sub("[^0-9]", "", m)
    code, ten = d[:-10], d[-10:]
    area, rest = int(ten[:3]), int(ten[3:])
    if area >= 200 and rest >= 2_000_000:
        a, b = feistel("phone", area - 200, rest - 2_000_000, 800, 8_000_000)
        return refilled(m, f"{code}{a + 200}{b + 2_000_000}")
    x = letters("phone8", ten[1:3] + ten[4:])
    return refilled(m, code + ten[0] + x[:2] + ten[3] + x[2:])


def moved(day):
    l, r = divmod((day - START).days, 4297)
    while True:
        l, r = feistel("date", l, r, 17, 4297)
        new = START + datetime.timedelta(days=l * 4297 + r)
        if (new.day > 12) == (day.day > 12):
            return new


def date(m):
    for form in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y"):
        try:
            return format(moved(datetime.datetime.strptime(m, form).date()), form)
        except ValueError:
            pass
    return m


def secret(m):
    head, value = re.match("""(?i)(token = |password=|secret: )(.*)""", m).groups()
    return head + ('"' + letters("secret", value[1:-1]) + '"' if value[0] == '"' else letters("secret", value))


#: The forms that the documents and this test write, each simple by itself.
FORMS = [
    (r"[A-Za-z0-9][A-Za-z0-9._]*@[a-z0-9]+(?:\.[a-z]+)+", email),
    (r"""(?i:token = "[^"\n]*"|password=\w+|secret: \w+)""", secret),
    (r"AKIA[0-9A-Z]{16}", lambda m: "AKIA" + letters("key", m[4:])),
    (r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){4}(?: [0-9]{2})?", iban),
    (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", ip),
    (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", ssn),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}", date),
    (r"[0-9]{4}(?:[ -]?[0-9]{4}){3}", card),
    (r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}", phone),
]


def scanned(text):
    """The text with all finds replaced, left to right, and how many changed."""
    if text is None:
        return None, 0
    out, at, n = [], 0, 0
    for m in re.finditer("(?<![A-Za-z0-9])(?:" + "|".join(f"({p})" for p, _ in FORMS) + ")(?![0-9])", text):
        new = FORMS[m.lastindex - 1][1](m.group())
        out += [text[at : m.start()], new]
        at, n = m.end(), n + (new != m.group())
    return "".join([*out, text[at:]]), n


def test_query_against_a_plain_scanner(spark, sf, monkeypatch):
    monkeypatch.setattr("tests.llm.test_native.KEY", queries.PSEUDONYM_KEY)
    for folder in (sf, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        got = queries.op8_pseudonyms(spark, folder).collect()
        assert Counter(map(tuple, got)) == Counter((r.doc_id, *scanned(r.text)) for r in docs)
        assert sum(r.n_replaced for r in got) > 10


def values(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    day = START + datetime.timedelta(days=rng.randrange(73049))
    body = digits(15)
    account = "".join(rng.choice("ABCDEFGHJ0123456789") for _ in range(16))
    good = f"DE{next(c for c in (f'{c:02}' for c in range(2, 99)) if mod97(f'DE{c}{account}') == 1)}{account}"
    grouped = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
    number = body + next(c for c in "0123456789" if luhn(body + c))
    return [
        f"{rng.choice(['ann', 'Bo.7', 'x_y'])}@{rng.choice(['mail', 'm2'])}.example.com", f'token = "{digits(9)}ab"', f'TOKEN = "{digits(4)}XY"', f"password=a{digits(5)}Z", f"Secret: q{digits(3)}",
        f"AKIA{account[:16].upper()}", grouped(good), good[:-1] + str((int(good[-1], 36) + 1) % 10), f"{rng.randrange(256)}.{rng.randrange(300)}.{rng.randrange(256)}.{rng.randrange(256)}",
        f"{rng.choice(['666', '000', '901', '123', '899', '665', '667'])}-{rng.choice(['00', '01', '99'])}-{digits(4)}", f"{day:%Y-%m-%d}", f"{day:%m/%d/%Y}", f"{day:%d/%m/%Y}", f"{day:%d.%m.%Y}", "2023-02-30", "31/31/2001",
        number, grouped(number), number[:4] + "-" + number[4:8] + "-" + number[8:12] + "-" + number[12:], number[:-1] + str((int(number[-1]) + 1) % 10), f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}",
    ]


def planted(rng, n):
    """Texts of words and values, a word after each value, so that any scanner tells where each ends."""
    out = []
    for _ in range(n):
        parts = []
        for v in rng.sample(values(rng), rng.randrange(8)):
            parts += [prose(rng, rng.randint(0, 6)), v + rng.choice(["", ".", ",", ")"]), "and"]
        out.append(rng.choice([" ", "\n"]).join(x for x in parts if x))
    return out


def test_planted(spark):
    rng = random.Random(21)
    texts = planted(rng, 250)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.text, r.n) for r in pseudonym.pseudonymise(docs, KEY, count="n").collect()}
    for i, t in enumerate(texts):
        assert got[i] == scanned(t), t
    assert sum(n for _, n in got.values()) > 500


def test_dates_of_all_forms_stay_apart_and_linked(spark):
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(days=i) for i in range(430)]
    forms = [f"{d:{f}}" for d in days for f in ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y")] + [f"{d:%d/%m/%Y}" for d in days if d.day > 12]
    docs = spark.createDataFrame([(x, x) for x in forms], "old string, text string").repartition(4)
    got = {r.old: r.text for r in pseudonym.pseudonymise(docs, KEY).collect()}
    assert len(set(got.values())) == len(got) == len(set(forms))
    for d in days:
        new = datetime.date.fromisoformat(got[f"{d:%Y-%m-%d}"])
        assert new == moved(d) and got[f"{d:%m/%d/%Y}"] == f"{new:%m/%d/%Y}" and got.get(f"{d:%d/%m/%Y}") in (got.get(f"{d:%d/%m/%Y}") if d.day <= 12 else f"{new:%d/%m/%Y}",)


def test_finds_in_awkward_rows(spark):
    """Nulls, repeated rows and clashing names, where every text holds something to replace."""
    rows = [(r[0], None if r[1] is None else f"{r[1]} jane@mail.example.com 10.0.0.1", *r[2:]) for r in awkward_rows()]
    out = pseudonym.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY, count="n_words")
    got = Counter((r.doc_id, r.text, r.n_words, r.lang, r.row, r.batch) for r in out.collect())
    want = Counter((r[0], None if r[1] is None else r[1][: -len("jane@mail.example.com 10.0.0.1")] + email("jane@mail.example.com") + " " + ip("10.0.0.1"), 0 if r[1] is None else 2, r[2], r[5], r[10]) for r in rows)
    assert got == want
