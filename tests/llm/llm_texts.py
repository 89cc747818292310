import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with every odd case: null, empty, blank, very long, ties, copies, near copies, repeats in themselves."""
    shared, base = prose(1, 70), prose(2, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one", "Don't say so.\n\nDon't say so.", shared, "before " + shared + " after",
             prose(3, 40) + "\n" + shared[:300] + "\n" + prose(4, 30), base, base, " ".join(near), base + " tail",
             "\n".join(["same line of some length that repeats itself"] * 9), "spin " * 200, prose(5, 9000),
             prose(5, 9000)[:20000] + " end", "é" * 150 + " " + "é" * 150, shared.upper(), "日本語 テキスト 日本語",
             "mail a.b@mail.example.com or 10.0.0.300 and 10.1.2.3, 4111 1111 1111 1111, +1 (555) 010-9999",
             "<|endoftext|> it's we'll  \n x", "a line of more than thirty-two bytes, it is\na line of more than thirty-two bytes, it ist"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The texts, one row twice, a null id, and columns whose names the operators use inside."""
    extra = [(k, t, "en" if k % 2 else None, "s", 1, 7, 8, "x", 9, 10) for k, t in rows]
    extra += [extra[8], (None, "no id here", "en", "s", 1, 7, 8, "x", 9, 10)]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, doc long, anchor long, removed string, "
               "label long, rep long").repartition(3)
