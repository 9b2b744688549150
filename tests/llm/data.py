"""A small table with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, kept string, key string, block string, sha string, fp string, score string, label string, next string, base string"


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}{r.choice('abcdé')}" for _ in range(n))


def texts(seed=3):
    r = random.Random(seed)
    out = [words(r, r.randrange(5, 120)) + "." for _ in range(40)]
    passage = words(r, 30)
    for k in range(6):
        out.append(words(r, 20) + " " + passage + " " + words(r, 20))
    base = words(r, 200)
    out += [base, base, base, base.replace("w1", "W1", 1), base + " tail", words(r, 3000)]
    out += ["", "", None, None, "  \t\n ", "a", "a", "é", "One. Two! Three? " * 30, "x" * 5000, "+1 (555) 010-9999 a@b.co 10.0.0.1 4111 1111 1111 1111", "\U0001F600 \U0001F600"]
    return out


def rows(seed=3):
    out = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None) + ("clash",) * 11 for k, t in enumerate(texts(seed))]
    return out + [out[3], out[3], (None, "no id", "en", "s1", None) + ("clash",) * 11]


def frame(spark, parts=5, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame(data, SCHEMA).repartition(parts) if data else spark.createDataFrame([], SCHEMA)
