import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, `key` long, label int, fp string, n int, gone string"


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def rows_of(pairs):
    return [(i, t, "en", "src0", None if t is None else len(t), "r", 7, 1, "f", 3, "g") for i, t in pairs]


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and very long texts, ties, repeated rows, near and exact copies, shared passages."""
    rng = random.Random(3)
    shared = prose(rng, 70)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(12)]
    out = [(0, None), (1, ""), (2, " \t\r\n\x0b\x0c "), (3, base[0]), (4, base[0]), (5, base[0].replace(" ", "  ")), (6, base[0] + "\n"), (6, base[0] + "\n"), (None, base[1]), (None, None)]
    out += [(10 + i, b) for i, b in enumerate(base[1:])]
    out += [(30 + i, f"{prose(rng, 30)} {shared} {prose(rng, 25)}") for i in range(4)]
    out += [(40, prose(rng, 60_000)), (41, "a" * 150_000), (42, "x"), (43, "Ünï çødé 日本   <|endoftext|> don't 12.5"), (44, "the " * 300)]
    out += [(50 + i, "\n".join(f"line {j} {'same' if j < 6 else i}" for j in range(12))) for i in range(3)]
    words = base[2].split()
    out += [(60 + i, " ".join(words[:i] + ["changed"] + words[i + 1 :])) for i in (5, 50)]
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_pairs):
    return spark.createDataFrame(rows_of(odd_pairs), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
