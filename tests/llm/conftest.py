"""Small tables with every awkward row."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, row int, copies string, language string, confidence string, u long, key string, mark string, __text string, text_ string, row_ long, t string, rep long, root long, folder string, tokens string, place long"


@pytest.fixture()
def table(spark):
    """Makes a table of documents from texts, or from (doc_id, text, lang, source), with extra columns of clashing names."""

    def make(rows, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r, "en", f"s{i % 3}") for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, 7, "x", "y", "z", 1, "k", "m", "tt", "t_", 5, "t", 6, 8, "f", "w", 9) for r in rows], SCHEMA).repartition(parts)

    return make
