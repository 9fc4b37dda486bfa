"""Audit markers and lines, feedback validation, and their text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.functions import text as T

VALIDATE = "validate"


def marker(action: Column, stage: Column, reason: Column, killed: Column | None = None) -> Column:
    """The bracketed tag of an audit line; a null action counts as allowed."""
    score = T.parse_score(reason)
    brands, strong, suspicious, context = (T.parse_field(reason, n) for n in ("brands", "strong", "suspicious", "allowContext"))
    tail = F.when(brands != "", F.concat(F.lit("brands="), brands)).when(strong != "", F.concat(F.lit("strong="), strong)).when(suspicious != "", F.concat(F.lit("suspicious="), suspicious)).otherwise("")
    blocked = F.concat(F.lit("[block:"), stage, F.lit(" score="), T.format_score(score), F.when(tail != "", F.concat(F.lit(" "), T.truncate(tail))).otherwise(""), F.lit("]"))
    near = F.concat(F.lit("[allow:near score="), T.format_score(score), F.when(context != "", F.concat(F.lit(" ctx="), T.truncate(context, 40))).otherwise(""), F.lit("]"))
    shown = (
        F.when(action.isNull(), "[allow]")
        .when((action == "block") & (stage == "brand"), F.concat(F.lit("[block:brand "), T.truncate(brands), F.lit("]")))
        .when(action == "block", blocked)
        .when(F.coalesce(score >= fixed.NEAR_MISS, F.lit(False)), near)
        .when((stage == "allow-context") & (context != ""), F.concat(F.lit("[allow:ctx "), T.truncate(context, 60), F.lit("]")))
        .otherwise("[allow]")
    )
    return shown if killed is None else F.when(killed, "[killed]").otherwise(shown)


def summary(action: Column, stage: Column) -> Column:
    return F.concat_ws(":", F.when(action.isin("block", "review"), action).otherwise("allow"), stage)


def audit_line(ts: Column, tag: Column, donator: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] "), tag, F.lit(" "), T.sanitize(donator), F.lit(": "), T.sanitize(message))


def feedback_error(decision: Column, verdict: Column, message: Column) -> Column:
    """Why a feedback record is refused, or null."""
    known = F.coalesce(decision.isin("block", "allow") & verdict.isin("correct", "false-positive"), F.lit(False))
    return F.when(~known, "Invalid decision or verdict").when(F.coalesce(message, F.lit("")) == "", "Message is required")


def feedback_line(ts: Column, decision: Column, verdict: Column, donator: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] ["), decision, F.lit("] ["), verdict, F.lit("] "), T.sanitize(donator), F.lit(" :: "), T.sanitize(message))


def verdict_response(action: Column, donor: str, message: str) -> Column:
    """The answer to a check as JSON: block with replacements, else allow (review lets through)."""
    blocked = F.to_json(F.struct(F.lit("block").alias("action"), F.lit(donor).alias("replaceDonator"), F.lit(message).alias("replaceMessage")))
    return F.when(action == "block", blocked).otherwise(F.to_json(F.struct(F.lit("allow").alias("action"))))


def envelope(status: Column, data: Column, message: Column, errors: Column, at: Column) -> Column:
    """What a service answers with: status, data, message, errors and the time. Without a message it says what the status means."""
    said = F.coalesce(message, F.when(status, "Success").otherwise("An error occurred"))
    return F.struct(status.alias("status"), data.alias("data"), said.alias("message"), errors.alias("errors"), at.alias("timestamp"))


def per_listener(checks: DataFrame, listeners: Column) -> DataFrame:
    """checks once for each listener (numbered from 1): every listener of a frame asks for itself; without listeners nobody does."""
    turns = F.when(listeners > 0, F.sequence(F.lit(1), listeners.cast("int"))).otherwise(F.array().cast("array<int>"))
    return checks.withColumn("listener", F.explode(turns))


def write_audit(lines: DataFrame, path: str, ts: str = "ts", line: str = "line", platform: str | None = "platform", mode: str = "append") -> None:
    """Writes lines as text (by default behind those that are there), one folder per day; rows of the validation page are left out."""
    if platform:
        lines = lines.where(F.coalesce(F.col(platform), F.lit("")) != VALIDATE)
    lines.select(F.to_date(ts).alias("dt"), F.col(line).alias("value")).write.mode(mode).partitionBy("dt").text(path)
