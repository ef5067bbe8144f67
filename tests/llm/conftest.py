import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _facts int, label int, row int, key int"


def prose(rng: random.Random, n: int, stem: str = "w") -> list[str]:
    return [f"{stem}{rng.randint(0, 5000)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with copies, near copies, shared passages, repeated rows, nulls, empties and a long text."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(30)]
    shared = prose(rng, 60, "s")
    out: list[tuple[int | None, str | None]] = [(n, " ".join(w)) for n, w in enumerate(base)]
    for n in range(8):  # near copies: one word in a hundred and more words changed
        w = list(base[n])
        w[len(w) // 2] = "changed"
        out.append((100 + n, " ".join(w)))
    out += [(200 + n, "\n".join([*base[n][:30], *shared, *base[n + 1][:30]])) for n in range(6)]
    out += [(300, " ".join(base[3])), (300, " ".join(base[3])), (301, " ".join(base[3]) + "  "), (302, None), (303, ""), (304, " \n\t "), (305, "one two"), (None, "a b c d e f g h i j k"), (None, None)]
    out += [(400, " ".join(prose(rng, 20_000))), (401, "x " * 500), (402, "#$% " * 200)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "other", 1, 2, 3, 4) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 0 if i in (401, 402) else 1, int(i == 400)) for i in [*range(30), 400, 401, 402]] + [(None, 1, 0), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
