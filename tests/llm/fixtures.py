"""Small tables with awkward rows: nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, copies long, row_no long, __part int"


def documents(spark, n=120, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "Delta", "épsilon", "zeta,", "eta.", "theta!", "iota", "κάππα", "日本語", "mu", "nu\tx", "xi  omicron", "don't", "pi\n\nrho", "<|endoftext|>", "0123"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
        rows.append((k * 3, text, rng.choice(["en", None]), rng.choice(["a", "b", "c", None, "d"]), len(text)))
    rows += [(1001, None, "en", "a", None), (1002, "", None, "b", 0), (1003, " \t\n", "en", None, 3), (None, "a null id", "en", "a", 9), (1004, "word " * 9000, "en", "a", 45000), (1005, "x" * 3000, "en", "z", 3000)]
    rows += [rows[5]] * 3 + [(2000 + k, rows[7][1], "de", "b", 1) for k in range(5)]
    base = [f"w{k}" for k in range(100)]
    for k in range(6):  # near copies
        rows.append((3000 + k, " ".join([*base[:k], f"edit{k}", *base[k + 1 :]]), "en", "c", 1))
    return spark.createDataFrame([(*r, 7, 8, 9, 10) for r in rows], DOCUMENTS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
