"""Small tables of documents with the awkward cases every operator has to take."""

import random

import pytest

AWKWARD = [
    (1, None, None, None), (2, "", "en", ""), (3, "a", "en", "s"), (4, "   \n\t\n", None, "s"), (5, "Ünï cödé ☃ 𝒳 é", "de", "s"),
    (6, "x" * 5000, "en", "s"), (7, "long words " * 3000, "en", "s"), (8, "long words " * 3000, "en", "s"), (9, "a\nb\n\nb\na\n", "fr", "s"),
    (9, "a\nb\n\nb\na\n", "fr", "s"), (9, "another text under the same id, somewhat longer than fifty bytes", "fr", "s"),
    (None, "a document without id", "en", "s"), (None, None, None, None), (10, "12 km 3.5 kg 1,000 $5 <|endoftext|> #@! \x00 \x1f \x85", "en", "s")]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def prose(rng, n, vocabulary=300):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary):x}{rng.choice(['', ',', '.'])}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in AWKWARD], SCHEMA + ", bucket string, row int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def copies():
    """(doc_id, text) with exact copies, near copies, shared passages and unrelated texts."""
    rng = random.Random(7)
    texts, passage = [], prose(rng, 70)
    for _ in range(12):
        base = prose(rng, rng.randrange(3, 160))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            words = base.split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
        texts.append(prose(rng, 40) + " " + passage + " " + prose(rng, 30))
    rng.shuffle(texts)
    return list(enumerate(texts))
