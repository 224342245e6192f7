import duckdb
import pytest

from tidemark.operators import history
from tidemark.plans import ingest, newsroom, reports, stories  # noqa: F401  (they register their queries)
from tidemark.plans import queries as library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in "documents events conversations pages orders".split():
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", list(library.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = library.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(library.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())


def test_a_cosmetic_change_is_minor(spark):
    rows = [(1, "s", "e", "Rain in the north", "k", "rain in the north"), (2, "s", "e", "Rain in the North!", "k", "rain in the north"), (3, "s", "e", "Sun in the north", "k", "sun in the north")]
    frame = spark.createDataFrame(rows, "id long, source string, tag string, title string, article_key string, content_key string").selectExpr("*", "timestamp'2024-01-01' as seen_at")
    got = {r["id"]: r["minor"] for r in history.revisions(frame).collect()}
    assert got == {1: None, 2: True, 3: False}


def test_words_are_marked_where_the_sql_has_them_begin(spark, tmp_path):
    titles = ["There, the theme", "ü<there> äeren ößerer", "enä eren", "other thſKs thé the_1", "_there 1ere Kere ſthe", "x́there", "Überthere", "", None, "THE Ere"]
    folder = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(titles)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    got = [(r["id"], r["marked"]) for r in library.QUERIES["marked_titles"](spark, str(folder)).collect()]
    assert sorted(c.execute(library.ORACLES["marked_titles"]).fetchall()) == sorted(got)
    assert any("ä<mark>eren</mark>" in m for _, m in got)
