"""M14 ``ml_predictions``: three model-output staging feeds normalised to one
15-column frame with ``unionByName``. Nothing is scored here; the feeds are
read as they were loaded (S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.catalog import Catalog

COLUMNS = ["model_name", "entity_type", "entity_id", "customer_id", "score", "churn_probability", "label",
           "prediction_date", "as_of_date", "confidence", "model_version", "prediction_source", "title",
           "explanation", "estimated_impact"]
IMPACT = "decimal(38,10)"


def _blank_to_null(c):
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def _null(t):
    return F.lit(None).cast(t)


def ml_predictions(cat: Catalog) -> DataFrame:
    def build():
        ch = cat.stg_churn_predictions.where(F.col("customer_id").isNotNull())
        name = F.coalesce(_blank_to_null("model_name"), F.lit("churn_model"))
        churn = ch.select(
            name.alias("model_name"), F.lit("customer").alias("entity_type"),
            F.col("customer_id").cast("string").alias("entity_id"), F.col("customer_id").cast("string").alias("customer_id"),
            F.col("churn_probability").cast("double").alias("score"),
            F.col("churn_probability").cast("double").alias("churn_probability"),
            F.when(F.col("churn_predicted") == 1, "churn").when(F.col("churn_predicted") == 0, "retain")
            .alias("label"),
            F.to_date("loaded_at").alias("prediction_date"), F.to_date("loaded_at").alias("as_of_date"),
            _null("double").alias("confidence"), name.alias("model_version"),
            F.lit("stg_churn_predictions").alias("prediction_source"), _null("string").alias("title"),
            _null("string").alias("explanation"), _null(IMPACT).alias("estimated_impact"))
        pr = cat.stg_profit_predictions.where(F.col("order_id").isNotNull())
        name = F.coalesce(_blank_to_null("model_name"), F.lit("profit_model"))
        profit = pr.select(
            name.alias("model_name"), F.lit("order").alias("entity_type"),
            F.col("order_id").cast("string").alias("entity_id"), F.col("customer_id").cast("string").alias("customer_id"),
            F.col("profit_probability").cast("double").alias("score"), _null("double").alias("churn_probability"),
            F.when(F.col("profit_predicted") == 1, "profitable").when(F.col("profit_predicted") == 0, "unprofitable")
            .alias("label"),
            F.coalesce("order_date", F.to_date("loaded_at")).alias("prediction_date"),
            F.to_date("loaded_at").alias("as_of_date"), _null("double").alias("confidence"), name.alias("model_version"),
            F.lit("stg_profit_predictions").alias("prediction_source"), _null("string").alias("title"),
            _null("string").alias("explanation"), F.col("net_sales").cast(IMPACT).alias("estimated_impact"))
        fc = cat.stg_sales_forecast_predictions.where(F.col("ds").isNotNull())
        score = F.coalesce("yhat", "ml_xgboost", "sarimax", "seasonal_naive")
        forecast = fc.select(
            F.coalesce(_blank_to_null("model_used"), _blank_to_null("forecast_horizon"), F.lit("sales_forecast"))
            .alias("model_name"),
            F.lit("forecast").alias("entity_type"), F.date_format("ds", "yyyy-MM-dd").alias("entity_id"),
            _null("string").alias("customer_id"), score.cast("double").alias("score"),
            _null("double").alias("churn_probability"), F.lit("sales_forecast").alias("label"),
            F.col("ds").alias("prediction_date"), F.to_date("loaded_at").alias("as_of_date"),
            _null("double").alias("confidence"),
            F.coalesce(_blank_to_null("model_used"), F.lit("sales_forecast")).alias("model_version"),
            F.lit("stg_sales_forecast_predictions").alias("prediction_source"), F.lit("Sales forecast").alias("title"),
            F.col("forecast_horizon").alias("explanation"), score.cast(IMPACT).alias("estimated_impact"))
        return churn.unionByName(profit).unionByName(forecast)
    return cat.memo("m14", build)
