import random

import pytest

ALPHABET = ["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "phi", "chi", "psi", "omega"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(ALPHABET) + (str(rng.randrange(400)) if rng.random() < 0.5 else "") for _ in range(n))


def corpus(seed=1, n=120):
    """Texts with exact and near copies, shared passages, odd white space, empty and null texts."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.choice([1, 3, 4, 20, 80, 200])) for _ in range(n)]
    texts += [texts[i] for i in range(0, 20)]
    for i in range(20, 50):
        words = texts[i].split(" ")
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(50))
        texts.append(" ".join(words))
    passage = sentence(rng, 60)
    texts += [sentence(rng, 15) + " " + passage + "\n" + sentence(rng, 25) for _ in range(6)]
    base = sentence(rng, 150).split(" ")
    for k in range(24):  # a chain: each step moves a little further away
        texts.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(len(base))] = f"step{k}{rng.randrange(9)}"
    texts += ["", None, "   \n\t ", "one", "one", " lead and  double\tspace\n\nend ", "loop " * 90, None]
    return [(i, t, "en", rng.choice(["src0", "src0", "src1", "sрc", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("id", "key", "n", "size", "digest", "keep_id", "shard", "start", "score", "w", "rank", "comp", "taken", "_id", "_size")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
