import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    """Ordinary, null, empty, blank, tiny, long and repeated texts, near copies, odd characters."""
    rng = random.Random(3)
    vocab = [f"w{i}é" for i in range(300)] + ["the", "The", "of", "a|b", "É.", "x y", " "]
    pick = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [None, "", "   \n\t", "one", "One", "two words", "a b c d", "a b c d e", "A b C d e", "a b c d e f",
             "x" * 5000, pick(12_000), "the " * 400, "line one here.\nline one here.\n\nother | menu | bar"]
    for _ in range(25):
        base = pick(rng.randrange(3, 160)).split(" ")
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append(" ".join(near))
    texts += [texts[20]] * 3
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i * 3, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None)
            for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
