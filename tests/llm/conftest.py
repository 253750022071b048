import random

import pytest

COLUMNS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
           # names that the operators use themselves
           "row string, size string, id string, e string, kept string, shard string, "
           "th string, copies string, n_tokens string, digest string")


def prose(seed, words=60, line=12):
    rng = random.Random(seed)
    out = ["".join(rng.choice(("ba", "do", "mi", "ke", "lu", "ra", "ti")) for _ in range(rng.randint(1, 4)))
           for _ in range(words)]
    return "\n".join(" ".join(out[i:i + line]) for i in range(0, words, line))


def nasty_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows, copies,
    one id with two texts, one very long text, odd characters."""
    a, b = prose(1), prose(2)
    near = a.replace("\n", " ", 1).rsplit(" ", 1)[0] + " changed"
    long = prose(3, 30_000)
    rows = [
        (1, a), (2, a), (3, near), (4, b), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"),
        (10, long), (11, b + "\n" + a), (12, "é ① 日本語 　x \x00 <s> " + prose(4)),
        (13, "Mail a.b@c.example.org or +1 (555) 555-0100, 10.0.0.255 and 4111 1111 1111 1111."),
        (14, prose(5)), (14, prose(5)), (15, prose(6)), (15, prose(7)), (None, prose(8)), (None, prose(8)),
        (None, prose(9)), (None, None), (16, "same " * 400), (17, "x" * 30_000), (18, prose(10)),
    ]
    sources = ("web", None, "books", "code")
    return [(i, t, None if k % 5 == 0 else "en", sources[k % 4], None, *["clash"] * 10)
            for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def nasty(spark):
    df = spark.createDataFrame(nasty_rows(), COLUMNS).repartition(5).cache()
    yield df
    df.unpersist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def folder(tmp_path):
    """Write frames as the tables that a query reads."""
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write
