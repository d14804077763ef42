"""Every registered query of the library against its SQL, at the smallest scale."""

import os

import pytest

from canopyrank.plans import registry
from canopyrank.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(data):
    return sorted(map(repr, map(tuple, data)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    assert rows(df.select(*cols).collect()) == rows(want.project(",".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_answer_letters_of_odd_texts_match_sql(spark, tmp_path):
    """Letters beside others than ASCII, combining marks, further line ends, \\x0B and folded letters."""
    import duckdb

    texts = ["\u65e5A\u65e5", "xyz \u00e9B", "C\u0301 and D", "E\u00e9", "z\rc. it is", "z\u2028d) it", "z\x85e. it", "z\x0b\nf.\x0bg", "an\u017fwer i\u017f b", "answer\x0bis c", "answer is d\u00e9", "answer: e\u0301", "the correct\x0boption g", "ANSWER\u00a0is H", "_A", "A_", "\n \n**b** \n", "e.\r\nx", "\r\nf. x", "", None, "h\U0001d49c I\U0001d49c"]
    data = [(i, turn, t) for i, t in enumerate(texts) for turn in (*range(9), -1, None)] + [(None, k, "so A") for k in range(8)]
    spark.createDataFrame(data, "conv_id long, turn int, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()["fn17_answer_letter"]).project("conv_id, turn, letter").fetchall()
    assert rows(registry.queries()["fn17_answer_letter"](spark, str(tmp_path)).select("conv_id", "turn", "letter").collect()) == rows(want)
