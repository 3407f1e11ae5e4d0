"""Tables bucketed by subject: the same rows, and joins that move none."""

import pytest

from cohortloom.operators import joins
from cohortloom.operators.columns import side_by_side
from cohortloom.sources.bucketed import by_subject, drop_table, has_exchange


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def tables(spark):
    raw = spark.createDataFrame([(k if k % 7 else None, float(k)) for k in range(40)], "id long, `VA/1` double")
    made = spark.createDataFrame([(k, f"c{k % 3}", k / 40) for k in range(0, 40, 2)], "SUBJ_ID long, DX_pred string, P double")
    return raw, made


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_prediction_join_back_moves_no_rows(spark, tables):
    raw, made = tables
    plain = joins.attach_predictions(raw, made, "id")
    bucketed = joins.attach_predictions(by_subject(raw, "id", 4), by_subject(made, "SUBJ_ID", 4), "id")
    assert has_exchange(plain) and not has_exchange(bucketed)
    assert rows(plain) == rows(bucketed) and len(rows(plain)) == 40


def test_families_of_one_subject_move_no_rows(spark):
    one = spark.createDataFrame([(k, float(k)) for k in range(30)], "id long, `VA/1` double")
    two = spark.createDataFrame([(k, -float(k)) for k in range(30)], "id long, `VA/1_ND` double")
    plain, bucketed = side_by_side(one, two, ["id"]), side_by_side(by_subject(one, "id", 4), by_subject(two, "id", 4), ["id"])
    assert has_exchange(plain) and not has_exchange(bucketed)
    assert rows(plain) == rows(bucketed)
    assert not has_exchange(by_subject(one, "id", 4).groupBy("id").count())


def test_a_bucket_is_one_file_and_tables_are_kept(spark, tables, tmp_path):
    raw, _ = tables
    back = by_subject(raw, "id", 3, "kept_by_subject", str(tmp_path / "t"))
    assert rows(back) == rows(raw) and back.columns == raw.columns
    assert len(list((tmp_path / "t").glob("*.parquet"))) <= 3
    drop_table(spark, "kept_by_subject")
    assert list((tmp_path / "t").glob("*.parquet"))
    assert by_subject(raw.limit(0), "id", 3).count() == 0
    with pytest.raises(ValueError):
        by_subject(raw, "id", 0)
