from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from llm_texts import lined, prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int | None, str | None]]:
    """Documents with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(7)
    docs: list[tuple[int | None, str | None]] = []
    passage = lined(prose(rng, 90))
    for i in range(60):
        docs.append((i, lined(prose(rng, rng.choice((1, 3, 30, 80, 200, 400))))))
    for i in range(60, 72):
        docs.append((i, lined(prose(rng, 60)) + "\n" + passage + "\n" + lined(prose(rng, 60))))
    base = prose(rng, 150)
    for i in range(72, 84):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(99))
        docs.append((i, lined(w)))
    docs += [(84 + i, docs[5][1]) for i in range(5)]
    docs += [(90, None), (91, ""), (92, "   \n\t"), (93, None), (None, lined(prose(rng, 50))), (None, None), (94, "the " * 400), (95, lined(prose(rng, 30000)))]
    docs += [docs[3], docs[3]]
    return docs


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same documents with columns named as results are."""
    from pyspark.sql import functions as F

    names = ("row", "res", "key", "n_words", "score", "kept", "id", "h", "t", "class_id", "lines", "gone", "start", "length", "spans", "base")
    return documents.withColumns({n: F.lit("x") for n in names})
