"""Small tables with the awkward rows: nulls, empty and long texts, ties,
repeated rows, and extra columns whose names operators use inside."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t1 string, _row int, node string, p_toxic double, leaks int"


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    out = [words(rng, rng.randint(1, 220), stock) for _ in range(60)]
    base = words(rng, 200, stock)
    for i in range(8):  # near copies
        w = base.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    passage = words(rng, 110, stock)
    out += [words(rng, 50, stock) + " " + passage + " " + words(rng, 40, stock) for _ in range(4)]
    out += [out[3]] * 5 + ["", " \n\t ", "x", "two words", "A b\x0bC", "ab " * 400, "z" * 3000, "日本語 😀 texts, ́a", "<|endoftext|> a"]
    out.append(words(rng, 20_000, stock))
    return out


def rows(seed=1):
    out = [(i, t, "en", f"s{i % 3}", len(t), "c", 1, "n", 0.5, 2) for i, t in enumerate(texts(seed))]
    out += [(1000, None, None, None, None, None, None, None, None, None), (None, "an id is missing here", "en", "s", 5, None, 3, None, None, None)]
    return out + [out[5], out[5], out[-2], (7, "the same id, another text", "en", "s", 1, "c", 1, "n", 0.1, 0)]


def docs(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
