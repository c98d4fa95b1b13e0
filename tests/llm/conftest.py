import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a small DataFrame of documents, with columns whose names clash with those the operators use."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "1 AS kept", "'x' AS n_words", "2 AS rid", "3 AS part", "4 AS __other") if extra else df

    return make


def _twin(first: str) -> str:
    word = first
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


#: Two different words that polynomial hashes modulo 2**64 can't tell apart.
TWINS = (_twin("a"), _twin("b"))
#: Nulls, empty texts, blanks, ties, repeated rows and a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "same words here and there"), (5, "same words here and there"), (5, "same words here and there"), (None, "no id at all"), (None, None), (6, "ab " * 3_000), (7, "x" * 200_000)]
