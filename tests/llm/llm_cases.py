"""Awkward inputs that every operator must take."""

import random

LONG = " ".join(f"w{i % 977}x" for i in range(60_000))

TEXTS = [None, "", " \n\t ", "word", "two words", "...!!!", "tab\tand\nline", "é ﬁ Å ▁x", "\x00\x01 zero", "😀 😀  😀", LONG,
         "same text twice here now again", "same text twice here now again"]

EXTRA = ("score string, margin string, rejected string, lang_pred string, n_words string, n_hit string, items string, "
         "spans string, contaminated string, hits string, secrets string, redacted string, n_candidates string, "
         "pieces string, decoded string, n_bytes string, n_tokens string, over_limit string")


def documents(spark, extra=False, texts=TEXTS):
    """Every awkward text; the last row twice; a null id; null lang and source."""
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"src{i}", len(t or ""))
            for i, t in enumerate(texts)]
    rows.append(rows[-1])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        rows, schema = [(*r, *(["own"] * len(EXTRA.split(", ")))) for r in rows], f"{schema}, {EXTRA}"
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng: random.Random, words: int, alphabet="abcdefgh", size=400) -> str:
    vocabulary = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(size)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))
