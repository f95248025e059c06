import pytest


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with the names of the code's own."""
    rows = [
        (1, "plain words of a text. " * 30, "en", "src0", 5, "x", 1),
        (1, "plain words of a text. " * 30, "en", "src0", 5, "x", 1),
        (2, None, None, None, None, None, None),
        (None, "no id here", "en", "src1", 1, "x", 2),
        (None, None, None, None, None, None, None),
        (3, "", "en", "", 0, "", 3),
        (4, " \n\t ", "de", "src1", 4, "x", 4),
        (5, "12345 %%% 678", "fr", "src1", 9, "x", 5),
        (6, "word " * 200_000, "en", "src2", 10, "x", 6),
        (7, "x" * 300_000, None, "src2", 10, "x", 7),
        (8, "日本語 テキスト ßÉ   ź", "ja", "src\U0001f600", 10, "x", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rec string, size int")
