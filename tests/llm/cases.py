"""Small awkward tables for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node string"


def texts(seed: int = 7, n: int = 60) -> list[str | None]:
    """Texts with copies, near copies, shared passages, repeats, blanks, odd white space and a long one."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "é", "über", "12"]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, out = words(60), []
    for i in range(n):
        own = words(r.choice([3, 20, 80, 150]))
        if i % 4 == 1:
            at = r.randrange(len(own))
            own[at:at] = passage[r.randrange(20) :][: r.choice([34, 35, 36, 60])]
        if i % 5 == 2 and out and out[-1]:
            own = out[-1].split()
            for _ in range(r.choice([0, 1, 1, 3])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
        out.append(r.choice([" ", "\n", "  ", "\t"]).join(own) if i % 7 == 3 else " ".join(own))
    out += [None, "", "   \n\t", "one", "One", "a b", "A b", "x " * 90, "x " * 90, "   a\x1cb", "The end.\nThe end.\n\nThe end."]
    return out + [out[0], out[1], " ".join(words(4000))]


def documents(spark, seed: int = 7, n: int = 60):
    """The texts as documents, with null ids and sources, a repeated row and columns whose names clash."""
    rows = [(i * 3, t, "en", f"src{i % 3 if i % 2 else 0}" if i % 11 else None, len(t) if t else None, i, "x") for i, t in enumerate(texts(seed, n))]
    return spark.createDataFrame([*rows, rows[4]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
