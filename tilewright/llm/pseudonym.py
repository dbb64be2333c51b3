"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

What is found and validated is permuted within its format, so that the result is again a
valid value of the kind, equal values get equal pseudonyms in all documents however they
are written (spaces and hyphens don't count), and different ones stay different:

========== ============================== ==========================================
kind       valid if                       permuted
========== ============================== ==========================================
card       13 to 19 digits, Luhn sum      all digits but the check digit, which is made anew
iban       remainder 1 modulo 97          letters and digits of the account; check digits anew
ssn        area, group, serial in range   898 x (99 x 9999) numbers
ip         four octets up to 255          2**16 x 2**16 addresses
phone      ten digits, or + and 8 to 15   800 x 8,000,000 numbers; others keep leading digits
date       a day of 1900 to 2099          17 x 4297 days, among those up to the 12th or those after
email      name@host.domain               name, and host names, by character class
key        AKIA and 16 characters         those 16, by character class
secret     password=..., Token: "...",    the value, by character class
           in any case, and the like
========== ============================== ==========================================

A numeric permutation is an alternating Feistel network over a pair of residues (rounds
add a keyed SHA-256 value of one half to the other, modulo its size), so domains needn't
be powers. A string is a Feistel network whose halves are characters, each shifted in
its own class (digit, capital, small letter); other characters stay.

Dates with slashes are read month first where that is a day, else day first. So that no two of them
meet, days up to the 12th of a month, which may be read either way, are permuted among
themselves, and so are the others: a step that leaves its own is followed by another one
(128 at most, which a day in 1e28 would need).

DataFrame operations only, row by row, without a shuffle. Cases: a null text stays null, an
empty one empty; what looks like a number but isn't valid stays as it is; numbers beside
others, joined by a space or hyphen, are told apart by their groups (``RUN``); texts of any
length are cut at the finds and put together once; equal rows get equal results; an empty
table gives an empty table; other columns stay as they are, but for one of the name given for the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_DAY = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
#: What goes before a secret's value: a name in any case, perhaps quoted, and = or :, perhaps with space and a quote.
_NAMED = r"""(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?[ \t]*+[=:][=>]?[ \t]*+"""
#: Numbers of several groups are their own kind's even after such a name; what stands in quotes is a secret as a whole.
_UNQUOTED = r"""["']?(?!\+?(?=(?:[ -]?[0-9]){10})[0-9-]++ [0-9]|[A-Z]{2}[0-9]{2} [A-Z0-9]{4} [A-Z0-9]{4})[A-Za-z0-9_/+.@!#$%^*~-]*[A-Za-z0-9]"""

#: Kinds by precedence where two could begin at one place. Java's possessive quantifiers keep each linear.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": rf"""{_NAMED}(?:"[^"\r\n]*[A-Za-z0-9][^"\r\n]*"|'[^'\r\n]*[A-Za-z0-9][^'\r\n]*'|{_UNQUOTED})""",
    "key": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "date": rf"{_DAY}(?![0-9]|[-./](?!{_DAY}(?![0-9]))[0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?|1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){2,5}(?![0-9])",
}
#: A find begins neither within a word nor within a number; a date may follow another one, as in an interval.
BEFORE = r"(?<![A-Za-z0-9])(?<![0-9]\.)"
_BEFORE = {"ssn": r"(?<![0-9]-)", "date": rf"(?:(?<![0-9][./-])|(?<=[0-9]/)(?=[0-9]{{4}}-|[0-9]{{2}}\.)|(?<=(?<![0-9]){_DAY}[./-]))", "phone": r"(?<![0-9]-)"}
#: What may follow a run of groups and begin with digits, but holds other characters too.
_NEXT = rf"{PATTERNS['email']}|{PATTERNS['secret']}|{PATTERNS['key']}|{PATTERNS['ip']}|(?=[0-9]{{2}}[./]){PATTERNS['date']}|[0-9]{{3}}(?:\.[0-9]{{3}}[ .-]|[ -][0-9]{{3}}\.)[0-9]{{4}}(?![0-9])"
#: Cards, IBANs and international phones are found as whole runs of groups, however many: where the run isn't one number, its parts are tried.
RUN = {
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2}})[A-Z0-9]++(?![a-z])(?:[ -](?!{_NEXT})[A-Z0-9]++(?![a-z]))*+",
    "card": rf"(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{_NEXT})[0-9]++)*+",
    "phone": rf"(?=\+[0-9]{{1,3}}(?:[ -]?[0-9]{{2,4}}){{2}})\+[0-9]++(?:[ -](?!{_NEXT})[0-9]++)*+",
}
#: Cards as they are customarily grouped, and IBANs, go before other kinds, and those before cards in other groups.
LAYOUT = r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:(?<=[ -][0-9]{4})\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}"
#: The most groups that one number has.
GROUPS = 19
#: A quick look first: every find has one of these.
HINT = r"[0-9@=:]"


def any_kind() -> str:
    # phones and brackets may follow anything that isn't a letter or digit
    ways = {**PATTERNS, "iban": RUN["iban"], "card": RUN["card"], "phone": f"(?:{PATTERNS['phone'].rsplit('|', 1)[0]}|{RUN['phone']})"}
    return BEFORE + "(?:" + "|".join(_BEFORE.get(kind, "") + p for kind, p in ways.items()) + ")"


def _int(x: Column) -> Column:
    return x.cast("bigint")


def _keyed(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits that depend on the key and all parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def residues(key: str, label: str, left: Column, right: Column, m: int, n: int) -> Column:
    """A keyed permutation of pairs (left modulo m, right modulo n), as a struct (l, r)."""

    def shift(i: Column, other: Column, size: int) -> Column:
        return _int(F.conv(F.substring(_keyed(key, F.lit(label), i, other), 1, 15), 16, 10)) % size

    def step(a: Column, i: Column) -> Column:
        l, r = a["l"], a["r"]  # noqa: E741
        return F.when(i % 2 == 0, F.struct(((l + shift(i, r, m)) % m).alias("l"), r.alias("r"))).otherwise(F.struct(l.alias("l"), ((r + shift(i, l, n)) % n).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_int(left).alias("l"), _int(right).alias("r")), step)


def characters(key: str, label: str, value: Column) -> Column:
    """A keyed permutation of strings of one form: digits stay digits, capitals capitals, small letters small."""

    def moved(half: Column, other: Column, i: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            amount = _int(F.conv(F.substring(_keyed(key, F.lit(label), i, other, F.floor(j / 16)), F.lit(1) + 4 * (j % 16), F.lit(4)), 16, 10))
            turn = lambda base, size: F.chr(F.lit(base) + (F.ascii(c) - base + amount) % size)
            return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[A-Z]$"), turn(65, 26)).when(c.rlike("^[a-z]$"), turn(97, 26)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    half = _int(F.floor(F.char_length(value) / 2)).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1).alias("r"))
    step = lambda a, i: F.when(i % 2 == 0, F.struct(moved(a["l"], a["r"], i).alias("l"), a["r"].alias("r"))).otherwise(F.struct(a["l"].alias("l"), moved(a["r"], a["l"], i).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda a: F.concat(a["l"], a["r"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(form: Column, value: Column, chars: str) -> Column:
    """``form`` with its characters of a class replaced by those of ``value``, in order."""

    def one(c: Column, j: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substr(form, F.lit(1), j + 1), f"[^{chars}]", ""))
        return F.when(c.rlike(f"^[{chars}]$"), F.substr(value, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(form, ""), lambda c: c != ""), one), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits to which a check digit 0 is added."""
    n = F.char_length(digits)

    def one(c: Column, j: Column) -> Column:
        d = c.cast("int") * F.when((n - j) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), one), F.lit(0), lambda a, x: a + x)


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn(digits) % 10) % 10).cast("string")


def _card(key: str, m: Column) -> Column:
    def made(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.char_length(d) - 1)
        new = lambda b: F.concat(b, _check_digit(b))
        return F.when(_check_digit(body) == F.substr(d, F.char_length(d), F.lit(1)), _refill(m, _let(characters(key, "card", body), new), "0-9"))

    return _let(_digits(m), made)


def _mod97(x: Column) -> Column:
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _iban(key: str, m: Column) -> Column:
    def made(v: Column) -> Column:
        country, check, account = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(3), F.lit(2)), F.substr(v, F.lit(5))
        new = lambda a: F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)
        return F.when(_mod97(F.concat(account, country, check)) == 1, _refill(m, _let(characters(key, "iban", account), new), "A-Z0-9"))

    return _let(F.regexp_replace(m, " ", ""), made)


def _ssn(key: str, m: Column) -> Column:
    part = lambda a, n: _int(F.substr(m, F.lit(a), F.lit(n)))
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def made(p: Column) -> Column:
        a = F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1)
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lit("-"), F.lpad((_int(F.floor(p["r"] / 9999)) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))

    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, _let(residues(key, "ssn", place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999), made))


def _ip(key: str, m: Column) -> Column:
    o = lambda i: _int(F.split_part(m, F.lit("."), F.lit(i)))
    valid = (o(1) < 256) & (o(2) < 256) & (o(3) < 256) & (o(4) < 256)
    made = lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(p["l"], 8), p["l"] % 256, F.shiftright(p["r"], 8), p["r"] % 256)])
    return F.when(valid, _let(residues(key, "ip", o(1) * 256 + o(2), o(3) * 256 + o(4), 65536, 65536), made))


def _phone(key: str, m: Column) -> Column:
    def made(d: Column) -> Column:
        n = F.char_length(d)
        ten = F.substr(d, n - 9)
        code = F.substr(d, F.lit(1), n - 10)
        area, rest = _int(F.substr(ten, F.lit(1), F.lit(3))), _int(F.substr(ten, F.lit(4)))
        north = lambda p: F.concat(code, (p["l"] + 200).cast("string"), F.lpad((p["r"] + 2_000_000).cast("string"), 7, "0"))
        # a number outside that plan keeps the digits that say so
        other = lambda x: F.concat(code, F.substr(ten, F.lit(1), F.lit(1)), F.substr(x, F.lit(1), F.lit(2)), F.substr(ten, F.lit(4), F.lit(1)), F.substr(x, F.lit(3)))
        rest8 = F.concat(F.substr(ten, F.lit(2), F.lit(2)), F.substr(ten, F.lit(5)))
        long = F.when((area >= 200) & (rest >= 2_000_000), _let(residues(key, "phone", area - 200, rest - 2_000_000, 800, 8_000_000), north)).otherwise(_let(characters(key, "phone8", rest8), other))
        short = F.concat(F.substr(d, F.lit(1), F.lit(2)), characters(key, "phone-", F.substr(d, F.lit(3))))
        return F.when((n < 8) | (n > 15), F.lit(None)).otherwise(_refill(m, F.when(n >= 10, long).otherwise(short), "0-9"))

    return _let(_digits(m), made)


def _date(key: str, m: Column) -> Column:
    first, second, last = (F.substr(m, F.lit(a), F.lit(n)) for a, n in ((1, 2), (4, 2), (7, 4)))
    iso = m.rlike("^[0-9]{4}-")
    dotted = m.contains(".")
    swap = ~iso & ~dotted & (_int(first) <= 12)  # month first where it can be
    year = F.when(iso, F.substr(m, F.lit(1), F.lit(4))).otherwise(last)
    month = F.when(iso, F.substr(m, F.lit(6), F.lit(2))).when(swap, first).otherwise(second)
    day = F.when(iso, F.substr(m, F.lit(9), F.lit(2))).when(swap, second).otherwise(first)

    zero = F.lit("1900-01-01").cast("date")
    as_date = lambda r: F.date_add(zero, (r["l"] * 4297 + r["r"]).cast("int"))
    turned = lambda r: residues(key, "date", r["l"], r["r"], 17, 4297)

    def checked(p: Column) -> Column:
        start = F.make_date(p["y"], p["m"], F.lit(1))
        real = F.when(p["y"].between(1900, 2099) & p["m"].between(1, 12), (p["d"] >= 1) & (p["d"] <= F.dayofmonth(F.last_day(start)))).otherwise(False)
        number = _int(F.datediff(F.make_date(p["y"], p["m"], p["d"]), zero))

        def made(r: Column) -> Column:
            new = as_date(r)
            return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(dotted, F.date_format(new, "dd.MM.yyyy")).when(swap, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))

        own = lambda r: (F.dayofmonth(as_date(r)) > 12) == (p["d"] > 12)
        first = turned(F.struct(_int(F.floor(number / 4297)).alias("l"), (number % 4297).alias("r")))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(127)), first, lambda r, _: F.when(own(r), r).otherwise(turned(r)))
        return F.when(real, _let(walked, made))

    return _let(F.struct(year.cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d")), checked)


def _email(key: str, m: Column) -> Column:
    name, host = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    top = F.regexp_extract(host, r"\.[^.]*$", 0)
    return F.concat(characters(key, "name", name), F.lit("@"), characters(key, "host", F.substr(host, F.lit(1), F.char_length(host) - F.char_length(top))), top)


def _secret(key: str, m: Column) -> Column:
    def made(head: Column) -> Column:
        rest, quote = F.substr(m, F.char_length(head) + 1), F.regexp_extract(head, "[\"']$", 0)
        tail = F.when((quote != "") & F.endswith(rest, quote), quote).otherwise(F.lit(""))
        return F.concat(head, characters(key, "secret", F.substr(rest, F.lit(1), F.char_length(rest) - F.char_length(tail))), tail)

    return _let(F.regexp_extract(m, f"^{_NAMED}[\"']?", 0), made)


_MADE = {
    "email": _email,
    "secret": _secret,
    "key": lambda key, m: F.concat(F.lit("AKIA"), characters(key, "key", F.substr(m, F.lit(5)))),
    "iban": _iban,
    "ip": _ip,
    "ssn": _ssn,
    "date": _date,
    "card": _card,
    "phone": _phone,
}


def pseudonym(key: str, found: Column, kinds: tuple[str, ...] = tuple(_MADE)) -> Column:
    """The pseudonym of what a pattern found: of the first kind that it is wholly and validly, else null."""
    return F.coalesce(*[F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), _MADE[kind](key, found)) for kind in kinds])


def _replaced(key: str, found: Column) -> Column:
    """A find with its pseudonym, or those of its parts, and how many places changed."""
    out = lambda text, n: F.struct(text.alias("text"), n.cast("int").alias("n"))
    whole = lambda new: F.when(new.isNotNull(), out(new, new != found)).when(found.rlike("[0-9A-Z][ -][0-9A-Z]"), _parts(key, found)).otherwise(out(found, F.lit(0)))
    return _let(pseudonym(key, found), whole)


def _parts(key: str, run: Column) -> Column:
    """As _replaced(), for a run of groups that isn't one number: from the left, at each group the best and longest number that begins there, but for one that runs into a better one."""
    kinds = ("iban", "ssn", "date", "card", "phone")

    def over(groups: Column) -> Column:  # each group but the first with what joins it to the one before
        last = F.size(groups) - 1
        number = lambda i, j: F.regexp_replace(F.array_join(F.slice(groups, i + 1, j - i + 1), ""), "^[ -]", "")

        def option(i: Column, j: Column) -> Column:
            rank = lambda s: F.when(s.rlike(f"^(?:{LAYOUT}|{PATTERNS['iban']})$"), 1).when(s.rlike(f"^(?:{PATTERNS['card']})$"), 3).otherwise(2)
            made = lambda s: F.struct(rank(s).alias("rank"), (-j).alias("j"), pseudonym(key, s, kinds).alias("new"), s.alias("old"))
            return _let(number(i, j), made)

        def best(_: Column, i: Column) -> Column:
            options = F.transform(F.sequence(i, F.least(i + GROUPS - 1, last)), lambda j: option(i, j))
            return F.array_min(F.filter(options, lambda x: x["new"].isNotNull()))

        def walk(bests: Column) -> Column:
            def step(a: Column, i: Column) -> Column:
                def taken(b: Column) -> Column:
                    better = F.exists(F.slice(bests, i + 2, F.coalesce(-b["j"], i) - i), lambda x: F.coalesce(x["rank"], F.lit(9)) < b["rank"])
                    joint = F.regexp_extract(F.get(groups, i), "^[ -]?", 0)
                    yes = F.struct((1 - b["j"]).alias("next"), F.concat(a["text"], joint, b["new"]).alias("text"), (a["n"] + (b["new"] != b["old"]).cast("int")).alias("n"))
                    no = F.struct((i + 1).alias("next"), F.concat(a["text"], F.get(groups, i)).alias("text"), a["n"].alias("n"))
                    return F.when(b.isNotNull() & ~better, yes).otherwise(no)

                return F.when(i < a["next"], a).otherwise(_let(F.get(bests, i), taken))

            start = F.struct(F.lit(0).alias("next"), F.lit("").alias("text"), F.lit(0).alias("n"))
            return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda a: F.struct(a["text"].alias("text"), a["n"].alias("n")))

        return _let(F.transform(groups, best), walk)

    return _let(F.split(run, "(?=[ -])"), over)


def kind_of(found: Column) -> Column:
    return F.coalesce(*[F.when(found.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()])


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the personal data in a text column replaced; ``count`` names a column for how many places changed."""
    t = F.col(text).cast("string")
    pattern = any_kind()
    names = {c.lower() for c in docs.columns}
    free = lambda n: n if n.lower() not in names else free("_" + n)
    finds, news = free("_finds"), free("_news")
    found = docs.withColumn(finds, F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    made = found.withColumn(news, F.when(F.size(finds) > 0, F.transform(F.col(finds), lambda m: _replaced(key, m))))
    parts = F.split(t, pattern, -1)
    whole = F.array_join(F.flatten(F.zip_with(parts, F.col(news), lambda p, m: F.array(p, F.coalesce(m["text"], F.lit(""))))), "")
    changed = F.aggregate(F.col(news), F.lit(0).cast("bigint"), lambda a, m: a + m["n"])
    columns = [F.when(F.size(news) > 0, whole).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count]
    return made.select(*columns, *([F.when(F.size(news) > 0, changed).otherwise(0).alias(count)] if count else []))
