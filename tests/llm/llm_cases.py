"""Fixtures with nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""

import random

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, key string, digest string, doc string, "
        "keys string, size int, node long, kept string, target double")


def prose(seed, words):
    r = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(words))


def rows(texts):
    """(doc_id, text, source) to full rows, with extra columns that clash with names used inside the operators."""
    return [(i, t, "en", s, None if t is None else len(t), "k", "d", "x", "y", 7, 3, "no", 1.5) for i, t, s in texts]


def edge_texts():
    base = prose(1, 80)
    common = "A line that Many documents hold, word for word."
    out = [(1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, base, "b"), (5, base, "b"), (5, base, "b"), (6, base + " x", "c"),
           (7, prose(2, 3), None), (8, prose(3, 30000), "a"), (None, base, "c"), (None, None, None), (9, "one two", "b"),
           (10, "The\n" * 30, "b"), (11, "é ß <|endoftext|> İ Σ 漢字 🙂 \x0b\x1c　 end", "c")]
    out += [(20 + i, f"{prose(100 + i, 60)}\n  {common.upper() if i % 2 else common}\t\n{prose(200 + i, 10)}", "abc"[i % 3]) for i in range(6)]
    return out


def frame(spark, texts=None):
    return spark.createDataFrame(rows(edge_texts() if texts is None else texts), DOCS)
