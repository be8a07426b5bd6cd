"""Small documents that hold the awkward cases."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000


def row(doc_id, text):
    return (doc_id, text, "en", "src0", None if text is None else len(text))


ODD = [
    row(3, "The quick brown fox jumps over the lazy dog near the river bank today."),
    row(1, None), row(2, ""), row(None, "a text without an id, mail me@x.org"), row(7, " \n\t "),
    row(5, "Grüße an alle! It's 'quoted'  twice,\n\nnaïve café 日本語 🙂 end"), row(5, "Grüße an alle! It's 'quoted'  twice,\n\nnaïve café 日本語 🙂 end"),
    row(9, LONG), row(11, "<|endoftext|> is only text here"), row(12, "x"), row(13, None),
    row(14, "same words same words same words same words same words"), row(15, "same words same words same words same words same words"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with extra columns that bear names the operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns(
        {c: F.lit("clash") for c in ("score", "label", "component_id", "start", "piece", "bin", "kept", "m", "p", "spans", "_base", "fold", "n_shingles")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
