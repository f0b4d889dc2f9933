"""Small fixtures for the training-data operators: nulls, empties, ties, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that the operators use inside.
CLASHES = ["score", "size", "key", "grp", "root", "bin_id", "entities", "lang_pred", "rn", "slice", "h", "kept", "_pos", "_copy",
           "_n", "times", "copy", "all"]


def hard_docs():
    """Rows with nulls in every column, empty and long texts, ties, repeated rows and repeated ids."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=40)) for _ in range(6)]
    long = " ".join(rng.choices(words, k=30_000))
    rows = [(i, base[i % 6] if i % 5 else base[i % 6] + f" tail{i}", "en", f"s{i % 3}", 10) for i in range(1, 30)]
    rows += [(40, None, "en", "s0", None), (41, "", None, "s1", 0), (42, " \n\t ", "de", None, 3),
             (43, long, "fr", "s2", len(long)), (44, "one", "en", "s0", 3), (45, "One", "en", "s0", 3),
             (46, "one two", "en", None, 7), (47, "12 34 !!", "en", "", 8), (48, "x" * 50_000, "en", "s0", 50_000),
             (None, base[0], None, None, None), (None, None, None, None, None),
             (50, base[1], "en", "s0", 1), (50, base[1], "en", "s0", 1), (51, base[2], "en", "s1", 1),
             (51, base[3], "en", "s1", 1), (52, "ünï cödé 漢字 кот", None, "ß", 1)]
    return rows


def clashing(df):
    """``df`` with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("extra").alias(c) for c in CLASHES if c not in df.columns])
