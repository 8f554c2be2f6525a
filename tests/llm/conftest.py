from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "sch en er ung keit ein ver ge zu te", "fr": "ou eau ment ai tion oi eux pa vi le", "es": "ción os ado rr ez mente co ar mi bo"}


def word(rng: random.Random, lang: str = "en") -> str:
    return "".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3)))


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(word(rng, lang) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text, lang, source) as a documents table."""

    def make(rows):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "src1"][len(r) - 2 :])[:2], None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and blank texts, repeated rows, ties and one very long text."""
    rng = random.Random(5)
    long_text = prose(rng, 60_000)
    return make_docs(
        [
            (None, None, None, None), (1, None, "en", "src0"), (2, "", "en", "src0"), (3, " \t\n ", None, "src1"), (4, "one", "en", None),
            (5, "same words here", "en", "src2"), (5, "same words here", "en", "src2"), (6, "same words here", "en", "src2"), (None, "same words here", "en", "src2"),
            (7, "12 34 !!", "fr", "src3"), (8, long_text, "en", "src4"), (9, "ÄÖÜ ß Straße 中文 текст", "de", "src5"),
        ]
    )


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def crowded(df):
    """The table with extra columns under names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "key b fp th _th _id root least n_words n_hit spans item_ids held_out lang_pred score _held _k1 _k2 _new _domain _lang full last _words _bytes o"
    return df.select("*", *[F.lit(f"x {n}").alias(n) for n in names.split()])
