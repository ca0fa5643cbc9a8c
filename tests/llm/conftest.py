import pytest


@pytest.fixture(scope="session")
def docs(spark):
    rows = [
        (1, "Mail a.b@c.de or +49 (0)30 1234-5678; ip 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111.", "en", "a", 5),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, "   ", "de", None, 3),
        (5, "One two three four five six seven eight nine ten eleven twelve", "en", "b", 9),
        (6, "one two three four five six seven eight nine ten eleven twelve", "en", "b", 9),
        (7, "ünï 😀 x@y.z 😀 under the MIT License and the General Public License mit license", "fr", "é", 9),
        (7, "ünï 😀 x@y.z 😀 under the MIT License and the General Public License mit license", "fr", "é", 9),
        (8, "1 " * 30000 + "end a@b.c_d@e.f", "en", "a", 1),
        (9, "zero one two three four five six seven eight nine ten eleven twelve 13 14 15 16 17 18 19", "en", "b", 9),
        (10, "zero one two three four five six seven eight nine ten eleven twelve 13 14 15 16 17 18 20", "en", "b", 9),
        (11, "only three words", "es", "c", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
