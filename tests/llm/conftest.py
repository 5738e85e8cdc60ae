import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, block int, held_out string, root long"


def sentence(rng: random.Random, lang: str, n: int) -> str:
    parts = {"en": ["the", "er", "and", "ing", "th"], "de": ["sch", "ein", "ü", "ung", "der"], "fr": ["é", "oi", "les", "eau", "que"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def corpus():
    """A small corpus: three languages, toxic words in some texts, exact and near copies, licence lines."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        text = sentence(rng, lang, rng.randrange(40, 160))
        toxic = i % 8 == 0
        if toxic:
            at = rng.randrange(len(text))
            text = f"{text[:at]} {rng.choice(['idiot', 'moron', 'scum'])} {text[at:]}"
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
        rows.append((i, text, lang, f"s{i % 4}"))
    for i in range(20):
        rows.append((300 + i, rows[i][1], rows[i][2], "copy"))
        words = rows[20 + i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((400 + i, " ".join(words), rows[20 + i][2], "near"))
    rows.append((500, rows[3][1] + "\nLicensed under the Apache License, Version 2.0.", "en", "s"))
    return rows, labels


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with rows at the edges, and with columns whose names the operators use inside."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
    edge = [
        (900, None, "en", "s"), (901, "", "en", "s"), (902, " \n\t ", None, None), (903, "12 34 !!", "en", "s"), (904, long, "en", "s"), (905, "ab" * 20_000, "en", "s"), (906, "日本語 テキスト ΣΑΣ İ é <|endoftext|> 😀", None, "s"),
        (907, "same words here", "en", "s"), (907, "same words here", "en", "s"), (None, "a row without an id", "en", "s"), (None, None, None, None), (908, "same words here", "en", None), (909, "", None, None),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), 0.5, "k", 1, "x", 7) for i, t, lang, s in [*corpus[0], *edge]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    return spark.createDataFrame([*corpus[1], (None, 1, 1), (12345, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
