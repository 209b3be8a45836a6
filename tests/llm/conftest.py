import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = ["alpha", "beta", "gamma", "delta", "omega", "éclair", "straße", "naïve", "the", "of", "and"]


def sentence(rng: random.Random, n: int) -> str:
    words = [rng.choice(VOCABULARY) + str(rng.randrange(400)) for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words).strip()


def row(doc_id, text, source="s1"):
    return doc_id, text, "en", source, None if text is None else len(text)


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and blank texts, one word, a long text, copies, near copies, shared parts."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(60, 160)) for _ in range(14)]
    passage = "\n".join(sentence(rng, 14).replace("\n", " ") for _ in range(5))
    rows = [
        row(0, None), row(1, ""), row(2, "  \n\t "), row(3, "word", None), row(4, "word"),
        row(5, "four words stand here"), row(6, "Four WORDS stand here"),
    ]
    rows += [row(10 + i, text, f"s{i % 4}") for i, text in enumerate(base)]
    rows += [row(30 + i, base[0], "s2") for i in range(4)]
    for i in range(6):  # near copies: a few words replaced
        words = base[1].split(" ")
        for _ in range(2):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        rows.append(row(40 + i, " ".join(words)))
    rows += [row(50 + i, f"{sentence(rng, 40)}\n{passage}\n{sentence(rng, 30)}", "s3") for i in range(5)]
    rows.append(row(60, sentence(rng, 6000)))
    rows.append(row(61, "ab" * 4000))
    rows.append(row(62, "x"))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def texts():
    return {r[0]: r[1] for r in odd_rows()}


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns under names that the operators use themselves; repeated rows; null ids."""
    rng = random.Random(5)
    texts = [sentence(rng, 80) for _ in range(3)]
    rows = [(7, texts[0]), (7, texts[0]), (7, texts[1]), (None, texts[2]), (None, None), (8, texts[0]), (9, None)]
    names = ["node", "n", "h", "key", "hash", "order", "token", "size", "spans", "first", "start", "text_key", "copy", "part", "w", "words", "component", "item", "ids"]
    table = spark.createDataFrame([(*r, "en", "s", None) for r in rows], SCHEMA)
    return table.selectExpr("*", *[f"'x' as `{n}`" for n in names])
