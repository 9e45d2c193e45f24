import pytest

EXTRA = ", set string, rest string, group int, row string, key string, rank string, score string, size string"


@pytest.fixture(scope="session")
def table(spark):
    """(rows, DDL) as a table with columns more whose names the operators use themselves."""
    def make(rows, ddl="doc_id long, text string", extra=True):
        more = EXTRA.count(",") if extra else 0
        return spark.createDataFrame([(*row, *[None] * more) for row in rows], ddl + (EXTRA if extra else ""))
    return make


#: Texts that every operator has to take: nulls, empty, blank, very long, ties, repeated rows, odd letters.
ODD = [
    (1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, " \t\n  "), (None, "a b c"),
    (5, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten"),
    (6, "x" * 30_000), (7, "word " * 8_000), (8, "\x00\x1c\u2003 İSTANBUL ΣΑΣ \U0001f600 e\u0301"), (-20, "two words"),
]
