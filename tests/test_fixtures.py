"""Views that Spark derives in another way than DuckDB."""

from lantern.fixtures import duck_views, spark_views
from tests.oracle import connection, rows

SF = "/root/testdata/sf0.001"


def test_folders_are_derived_once(spark):
    """They are a written table, so that a query that uses them several times does not derive all files each time."""
    folders = spark_views(spark, SF, "f_folders")[0]
    assert "lineitem" not in folders._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lineitem" in x for x in folders.inputFiles())
    assert rows(folders.toPandas()) == rows(connection(SF).sql(duck_views("f_folders") + "select * from f_folders").df())
