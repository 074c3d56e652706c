"""Raw CSV -> encoded tables (the reference's end-to-end preprocessing test)."""

import pytest

from fraudstream.operators.preprocess import drop_for_modelling, preprocess
from fraudstream.schemas import MODEL_COLUMNS
from fraudstream.sources.replay import load_model_dataset, read_raw_transactions

HEADER = (
    ",trans_date_trans_time,cc_num,merchant,category,amt,first,last,gender,street,city,state,zip,lat,long,"
    "city_pop,job,dob,trans_num,unix_time,merch_lat,merch_long,is_fraud"
)


def _row(i, merchant, category, amt, fraud):
    return (
        f"{i},2020-01-0{i + 1} 00:00:00,{1000 + i},{merchant},{category},{amt},A,B,F,S,C,ST,10001,40.0,-73.0,"
        f"1000,eng,1990-01-01,t{i},{1577836800 + i},40.1,-73.1,{fraud}"
    )


def test_preprocess_end_to_end(spark, workdir):
    train_rows = [_row(0, "a", "food", 10.0, 0), _row(1, "b", "travel", 20.0, 1),
                  _row(2, "a", "food", 30.0, 0), _row(3, "b", "travel", 40.0, 1)]
    val_rows = [_row(0, "unseen", "food", 10.0, 0), _row(1, "a", "travel", 20.0, 1)]
    with open(f"{workdir}/train.csv", "w") as f:
        f.write("\n".join([HEADER, *train_rows]) + "\n")
    with open(f"{workdir}/test.csv", "w") as f:
        f.write("\n".join([HEADER, *val_rows]) + "\n")
    raw_train = read_raw_transactions(spark, f"{workdir}/train.csv")
    raw_val = read_raw_transactions(spark, f"{workdir}/test.csv")
    assert "_c0" not in raw_train.columns
    summary = preprocess(raw_train, raw_val, f"{workdir}/out")
    assert summary["train_rows"] == 4
    assert summary["validation_rows"] == 2
    assert summary["train_fraud_rows"] == 2
    val = spark.read.parquet(f"{workdir}/out/validation")
    assert len(val.columns) == 12
    replay = spark.read.parquet(f"{workdir}/out/replay")
    first = replay.filter("trans_num = 't0'").first()
    assert first["merchant_label"] == -1


def test_csv_columns_are_matched_by_name(spark, workdir):
    swapped = HEADER.replace(",lat,", ",LAT,").replace(",merch_lat,", ",lat,").replace(",LAT,", ",merch_lat,")
    with open(f"{workdir}/swapped.csv", "w") as f:
        f.write("\n".join([swapped, _row(0, "a", "food", 10.0, 0)]) + "\n")
    row = read_raw_transactions(spark, f"{workdir}/swapped.csv").first()
    assert (row.lat, row.merch_lat) == (40.1, 40.0)


def test_model_csv_without_a_column_is_an_error(spark, workdir):
    names = [c for c in MODEL_COLUMNS if c != "unix_time"]
    with open(f"{workdir}/model.csv", "w") as f:
        f.write(",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    with pytest.raises(ValueError, match="unix_time"):
        load_model_dataset(spark, f"{workdir}/model.csv")
    with open(f"{workdir}/whole.csv", "w") as f:
        f.write(",".join(reversed(MODEL_COLUMNS)) + "\n" + ",".join(str(i) for i in range(len(MODEL_COLUMNS))) + "\n")
    row = load_model_dataset(spark, f"{workdir}/whole.csv").first()
    assert (row.is_fraud, row.amt) == (0, 11.0)


def test_drop_for_modelling_ignores_absent_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "zip int, merchant string, amt double")
    assert drop_for_modelling(df).columns == ["amt"]
