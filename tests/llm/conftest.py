import pytest

WORDS = "stone river ANT over Glass of the and night under winter copper lamp moss".split()


def made_texts(n, seed=3):
    import random

    r = random.Random(seed)
    shared = " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(30))
    texts = []
    for i in range(n):
        kind = i % 7
        lines = [" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(r.randint(1, 14))) + r.choice([".", "", " "]) for _ in range(r.randint(1, 6))]
        if kind == 3 and texts:
            lines = (r.choice(texts) or "x").split("\n")
        if kind == 4:
            lines.insert(r.randint(0, len(lines)), "  " + shared.upper() + "\t")
        if kind == 5 and texts:
            words = (r.choice(texts) or "x y").split(" ")
            words[r.randrange(len(words))] = "changed"
            lines = [" ".join(words)]
        texts.append("\n".join(lines))
    texts[1:5] = [None, "", " \t\n", "ü" * 50]
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i * 3 if i % 50 else i * 3, t, None if i % 13 == 0 else f"s{i % 4}", "x", "y") for i, t in enumerate(made_texts(150))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, component_id string").repartition(5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, a null id and one very long text."""
    long = "\n".join(f"line {i} with words that make it longer than forty characters" for i in range(3000))
    rows = [(7, "twice the same text", "a")] * 3 + [(None, "no id here", None), (8, long, "b"), (9, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")
