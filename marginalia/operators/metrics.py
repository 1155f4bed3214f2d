"""Figures that the tables can answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PDF_QUOTA, QUESTION_QUOTA = 10, 50


def docs_per_user(documents: DataFrame, sessions: DataFrame) -> DataFrame:
    own = documents.join(sessions.select("session_id", "user_id"), "session_id")
    of_user = own.groupBy("user_id").agg(F.count("*").alias("n"))
    return of_user.agg(F.count("*").alias("users"), F.sum("n").alias("documents"), F.round(F.avg("n"), 6).alias("average"))


def weekly_active_share(activity: DataFrame, n_users: int | DataFrame) -> DataFrame:
    """(user_id, ts) -> week, active users, share of all users: a number, or the distinct user_id of a table."""
    weeks = activity.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count_distinct("user_id").alias("active"))
    if isinstance(n_users, DataFrame):
        total = n_users.agg(F.count_distinct("user_id").alias("total"))
        return weeks.crossJoin(F.broadcast(total)).select("week", "active", F.round(F.col("active") / F.nullif("total", F.lit(0)), 6).alias("share"))
    return weeks.withColumn("share", F.round(F.col("active") / F.lit(n_users), 6))


def upload_success_rate(outcomes: DataFrame) -> DataFrame:
    """(error) -> rows, failures, share without an error."""
    return outcomes.agg(F.count("*").alias("uploads"), F.count("error").alias("failures"), F.round(F.avg(F.col("error").isNull().cast("int")), 6).alias("rate"))


def answer_found_rate(answers: DataFrame) -> DataFrame:
    return answers.agg(F.count("*").alias("answers"), F.round(F.avg(F.col("answer_found").cast("int")), 6).alias("rate"))


def monthly_quota(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """(user_id, ts) of uploads and of questions -> per user and month both counts and whether a quota is exceeded."""
    both = documents.select("user_id", "ts", F.lit(1).alias("d"), F.lit(0).alias("q")).unionByName(questions.select("user_id", "ts", F.lit(0).alias("d"), F.lit(1).alias("q")))
    out = both.groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(F.sum("d").alias("pdfs"), F.sum("q").alias("questions"))
    return out.withColumn("exceeded", (F.col("pdfs") > PDF_QUOTA) | (F.col("questions") > QUESTION_QUOTA))
