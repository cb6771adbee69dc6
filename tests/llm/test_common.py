import pytest

from quill.llm import common


def test_written_tables_are_read_again_and_cleared(spark):
    df = common.written(spark.range(5), "numbers")
    assert df.count() == 5 and df.dtypes == [("id", "bigint")]
    assert common.clear_shared(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        common.written(spark.range(1), "x") and spark.read.parquet(common.shared_path(spark, "gone")).count()
