import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept int, n_words string, ids string, keys int, batch string, digest int, _text string"
WORDS = ["alpha", "beta", "gamma", "delta", "naïve", "Straße", "über", "of", "the", "and", "ion", "ré", "x1"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties and repeated rows; more columns with names that operators use."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    passage = prose(rng, 60)
    texts = [
        *base,
        base[0],
        base[0],
        base[1] + " tail",
        passage + "\n" + prose(rng, 80),
        prose(rng, 70) + "\n" + passage,
        "intro " + passage,
        "",
        None,
        " \t\n\x0b\f\r ",
        "one",
        "two words",
        "!!! ... ***",
        "a" * 3000,
        "line\nline\nline\n\nline " * 40,
        prose(rng, 4000),
        "\x1c \x85 \xa0   　 mixed​ spaces ² ½ Σ ΟΔΟΣ İ",
        "日本語のテキスト。 한국어 عربى 👩‍👩‍👧 é",
        "<|endoftext|> <|startoftext|> don't it's",
        "word " * 300,
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base[3], None, None, None), (None, None, None, None, None), (3, base[5], "en", "a", 1)]
    return [(*r, "r", 1, "w", None, None, "b", 7, "t") for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
