from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they at be this from".split()


def prose(rng: random.Random, n: int, line: int = 12) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "ing", "er", "ly", str(rng.randint(0, 99))]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def cases() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, ties, repeated rows, copies, near copies and one long text."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(25)]
    passage = prose(rng, 60)
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)]  # copies
    rows += [(110 + i, base[i].replace(" ", "  ") + "\n") for i in range(5)]  # other white space
    rows += [(120 + i, base[i + 5] + " " + passage + "\n" + prose(rng, 20)) for i in range(6)]
    rows += [(130 + i, passage + "\n" + base[i + 9]) for i in range(4)]
    rows += [(140, None), (141, ""), (142, " \n\t "), (143, None), (144, "Wher. " * 90), (145, "x")]
    rows += [(150, base[3]), (150, base[3]), (151, base[4]), (151, base[6] + " tail")]  # repeated ids
    rows += [(None, base[7]), (None, prose(rng, 40)), (160, "é日本🦆 ß " * 40), (161, "\n\n\n\n\n")]
    rows += [(170, prose(rng, 40_000))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The cases with extra columns whose names could clash with those of an operator."""
    data = [(i, t, "en", "s", 1, "a", "b", 2.0, 0, True) for i, t in rows]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, digest string,"
        " row_key string, score double, _fp long, kept boolean"
    )
    return spark.createDataFrame(data, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")
