"""Small tables with nulls, blanks, ties, repeats and extra columns."""

from __future__ import annotations

import random

LONG = " ".join(f"long{i % 700}" for i in range(6000))


def documents(spark, n: int = 60, seed: int = 3):
    rng = random.Random(seed)
    vocab = {"en": ["the", "and", "of", "thing", "with", "ing", "was"], "fr": ["le", "éau", "que", "être", "des", "où", "les"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(vocab))
        words = [rng.choice(vocab[lang]) + rng.choice(["", "a", "en", "ti"]) for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(words) + ("\n" + " ".join(words[:7]) if i % 5 == 0 else ""), lang, f"s{i % 4}", None, i % 3))
    base = rows[7][1] + " " + " ".join(f"w{k}" for k in range(200))
    edited = base.replace("w10 ", "changed ")
    rows += [
        (100, base, "en", "s1", 5, 0), (101, base, "en", "s2", 5, 0), (102, base.replace(" ", "  "), "en", "s1", 5, 0), (103, edited, "en", None, 5, 0),
        (103, edited, "en", None, 5, 0), (104, None, "en", "s1", None, 0), (105, "", None, "s1", None, 0), (106, " \n\t ", None, None, 0, 0),
        (107, LONG, "en", "s3", 1, 1), (108, LONG + " tail", "en", "s3", 1, 1), (109, "12 34 !!", "en", "s3", 1, 1), (110, "Ab", "en", "s3", 1, 1), (111, "aB", "en", "s3", 1, 1), (None, "no id here", "en", "s3", 1, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hits int")


def pages_of(df):
    return [r.asDict() for r in df.collect()]
