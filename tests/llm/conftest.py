import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from llm_data import SCHEMA, make_docs, words  # noqa: E402


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages and lines, blanks, nulls and one long text."""
    rng = random.Random(7)
    texts = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(60)]
    passage, line = " ".join(words(rng, 50)), " ".join(words(rng, 20)) + " Shared Line of fair length"
    texts += [texts[0]] * 7 + [texts[1]] * 2
    texts += [" ".join(words(rng, 20) + [passage] + words(rng, 30)) for _ in range(6)]
    texts += ["\n".join([" ".join(words(rng, 9)), f"  {line.upper() if k % 2 else line} \t", " ".join(words(rng, 9))]) for k in range(8)]
    near = words(rng, 300)
    for k in range(6):
        own = list(near)
        own[rng.randrange(300)] = f"new{k}"
        texts.append(" ".join(own))
    texts += [None, "", " \t\n", "a", "  a  ", "\n\n", "x" * 5000, "the " * 90, " ".join(words(rng, 20_000)), None, ""]
    texts.append(" ".join(["loop"] * 3 + [passage] + [passage]))
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make_docs(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
