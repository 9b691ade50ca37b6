import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, words string, score double, node long, "
        "value long, _row long, p string, shard string, cell string")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those the operators use."""
    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "w", 0.5, 7, 8, 9, "p", "x", "y") for i, t, lang in rows], DOCS)
    return make


WORDS = {"en": "the of and to in that is was for with shing tion ning erly".split(),
         "de": "der die und den von das mit ist nicht sich ung keit lich schen".split()}


def prose(seed, n, lang="en"):
    import random

    r = random.Random(f"{seed}{lang}")
    w = WORDS[lang]
    return " ".join(r.choice(w) if r.random() < 0.5 else "".join(r.choice(w[-5:]) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, repeated ids."""
    base = [(i, prose(i, 60 + i, "en" if i % 3 else "de"), "en" if i % 3 else "de") for i in range(40)]
    near = base[5][1].split()
    near[30] = "changed"
    rows = base + [(50, base[4][1], "en"), (51, base[4][1], None), (52, " ".join(near), "en"), (53, None, "en"), (54, "", None),
                   (None, base[7][1], "en"), (55, "word", "en"), (55, "word", "en"), (56, "!!! ... 123", "de"),
                   (57, prose("long", 40_000), "en"), (58, "two words", "en"), (59, "two words", "en"), (60, base[8][1], "en"),
                   (60, base[9][1], "de")]
    return rows
