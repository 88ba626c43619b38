from parcelwise.sources.store import PARTITION_ROWS, partitions_for

KEY = "spark.sql.shuffle.partitions"


def test_partitions_grow_with_the_rows_and_are_given_back(spark):
    usual = spark.conf.get(KEY)
    with partitions_for(spark, 10):
        assert spark.conf.get(KEY) == usual  # never fewer than the session has
    many = 10 * int(usual)
    try:
        with partitions_for(spark, many * PARTITION_ROWS):
            assert int(spark.conf.get(KEY)) == many
            with partitions_for(spark, PARTITION_ROWS):
                assert int(spark.conf.get(KEY)) == many
            assert int(spark.conf.get(KEY)) == many
            raise ValueError
    except ValueError:
        assert spark.conf.get(KEY) == usual
