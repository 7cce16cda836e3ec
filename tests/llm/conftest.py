import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHING = "id long, n long, key string, bucket int, names string, gone int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with every special case: nulls, empty and white texts, short and long ones, copies, near copies, shared lines and passages."""
    rng = random.Random(1)
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one two three"), (5, "One two three"), (6, "é ü. Ünï")]
    for i in range(7, 40):
        docs.append((i, "\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))))
    shared = prose(rng, 60)
    for i in range(40, 60):
        base = docs[rng.randint(7, 39)][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = prose(rng, 1)
        docs.append((i, " ".join(base) + ("\n" + shared if i % 3 == 0 else "")))
    docs += [(60, docs[10][1]), (61, docs[10][1]), (62, "abc " * 3000), (63, docs[62 - 60 + 8][1].upper()), (-5, shared + "\n" + prose(rng, 30))]
    return docs


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text) as a table like `documents`, with clashing extra columns."""

    def make(rows, parts=3):
        full = [(i, t, "en", "s", len(t or ""), 1, 2, "k", 3, "x", 4) for i, t in rows]
        return spark.createDataFrame(full, f"{SCHEMA}, {CLASHING}").repartition(parts)

    return make
