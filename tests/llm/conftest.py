import random

import pytest

SF = "/root/testdata/sf0.001"


def gathered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def corpus(seed: int, n: int = 150) -> list[tuple]:
    """Copies, near copies, shared passages, one-word texts, odd white space, nulls, repeated rows and ids."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages, base = [prose(rng.randint(40, 130)) for _ in range(4)], [prose(rng.randint(60, 300)) for _ in range(4)]
    rows = []
    for d in rng.sample(range(-50, 5000), n):
        r = rng.random()
        if r < 0.3:
            w = list(base[0]) if rng.random() < 0.5 else list(rng.choice(base))
        elif r < 0.5:
            w = list(rng.choice(base))
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif r < 0.85:
            w = prose(rng.randint(0, 60)) + (passages[0] if rng.random() < 0.6 else rng.choice(passages)) + prose(rng.randint(0, 60))
        elif r < 0.9:
            w = ["a"] * rng.randint(0, 200)
        else:
            w = prose(rng.randint(0, 100))
        rows.append((d, rng.choice([" ", "\n", " \x1c ", "\x0b"]).join(w)))
    rows += [(None, rows[0][1]), (7000, None), (7001, ""), (7002, " \n "), rows[3], rows[3], (rows[5][0], rows[6][1])]
    return rows
