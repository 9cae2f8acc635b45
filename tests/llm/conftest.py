import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"
SMALL = "the of and to in is it on as by at or an be".split()


def rows_of(seed: int = 1, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared passages, null and empty texts, ties, repeated rows and ids, clashing column names."""
    r = random.Random(seed)
    word = lambda: r.choice(SMALL) if r.random() < 0.4 else "".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    base, shared = [text(r.randint(1, 120)) for _ in range(n // 3)], text(30)
    out = []
    for i in range(n):
        t = r.choice(base) if i % 3 else text(r.randint(0, 90))
        if i % 7 == 1:
            t = f"{text(5)}\n{shared}\t {text(4)}"
        if i % 7 == 2:
            t = t + "  "
        if i % 7 == 3 and t:
            parts = t.split(" ")
            parts[len(parts) // 2] = "changed"
            t = " ".join(parts)
        out.append((i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t), f"k{i}", f"r{i}"))
    out += [(n, None, None, None, None, None, None), (n + 1, "", "en", "s1", 0, "", ""), (n + 2, " \t\n", "en", "s1", 3, "", ""), (None, "no id here at all", "en", "s2", 17, "", ""), (None, None, None, None, None, None, None)]
    out += [out[5], out[5], (7, "another text with the id seven", "en", "s3", 30, "", "")]
    out += [(n + 10, text(6000), "en", "s0", 1, "", ""), (n + 11, "x" * 5000, "en", "s0", 5000, "", "")]
    return out


@pytest.fixture(scope="session")
def rows():
    return rows_of()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
