"""Leakage-safe preprocessing (L4): raw train/validation -> dictionary -> encoded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.contract import validate_columns
from ..sources.replay import write_preprocessed
from . import encoders, sampling


def preprocess(
    raw_train: DataFrame,
    raw_validation: DataFrame,
    out_dir: str,
    *,
    sample_size: int | None = None,
) -> dict[str, int]:
    """Fit codes on train only, encode both, write train/validation/replay + dictionary.

    ``sample_size`` applies the exact stratified down-sample (E5) to each input.
    Returns the split summary (E6) as four numbers.
    """
    if sample_size is not None:
        raw_train = sampling.stratified_sample(raw_train, sample_size)
        raw_validation = sampling.stratified_sample(raw_validation, sample_size)
    validate_columns(raw_train, source="training data")
    validate_columns(raw_validation, source="validation data")
    dictionary = encoders.materialize(encoders.fit_dictionary(raw_train))
    enc_train = encoders.encode(raw_train, dictionary)
    enc_val = encoders.encode(raw_validation, dictionary)
    write_preprocessed(enc_train, enc_val, out_dir)
    encoders.save_dictionary(dictionary, f"{out_dir}/dictionary")
    spark = raw_train.sparkSession
    summary = sampling.split_summary(
        spark.read.parquet(f"{out_dir}/train"), spark.read.parquet(f"{out_dir}/validation")
    ).collect()
    by = {r["split"]: r for r in summary}
    return {
        "train_rows": int(by["train"]["rows"]),
        "validation_rows": int(by["validation"]["rows"]),
        "train_fraud_rows": int(by["train"]["fraud_rows"] or 0),
        "validation_fraud_rows": int(by["validation"]["fraud_rows"] or 0),
    }


def drop_for_modelling(df: DataFrame) -> DataFrame:
    """The exploratory cleaning step's column drop (absent names are ignored)."""
    from ..schemas import CLEANING_DROP_COLUMNS

    return df.drop(*CLEANING_DROP_COLUMNS)
