import numpy as np
import pytest

# Names that operators use or might use inside.
ODD = ["run", "part", "keep_id", "__id", "__nth", "__digest", "__n", "__utf8", "__raw", "__times", "__part", "toxicity", "id", "words", "utf8", "Row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)


def words(rng, n, vocabulary=400):
    return [f"w{int(i)}" for i in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls, empties, long texts, ties, repeated rows, copies, near copies and clashing column names."""
    rng = np.random.default_rng(3)
    texts = [" ".join(words(rng, int(n))) for n in rng.integers(1, 90, 60)]
    base = words(rng, 300, 5000)
    near = []
    for _ in range(6):
        w = list(base)
        w[int(rng.integers(0, 300))] = "changed"
        near.append(" ".join(w))
    shared = " ".join(words(rng, 50, 5000))
    passages = [" ".join(words(rng, 30, 9000)) + " " + shared + " " + " ".join(words(rng, 30, 9000)) for _ in range(4)]
    texts += [None, "", " \n\t", texts[5], texts[5], "a", "a a a a a a", " ".join(["x"] * 300), " ".join(words(rng, 9000, 90_000)), "dòng một\ndòng một\n\ndòng hai", *near, *passages]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, *[f"{c} {i}" for c in ODD]) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "không có số", *[None] * (3 + len(ODD))), (None, texts[5], *[None] * (3 + len(ODD)))]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
