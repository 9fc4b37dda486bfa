"""Evidence, score and the ordered decision list, as columns of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.functions import text as T
from palisade.operators.evidence import DONOR_LISTS, MESSAGE_LISTS, evidence
from palisade.operators.matching import listed, previewed, weight_sum


def inspect(df: DataFrame, prefix: str, found: Column, message: bool) -> DataFrame:
    """Adds the evidence of one field: <prefix>_variants and its hit lists.

    The message field runs every list; the donor field brands, hard and suspicious rules only.
    """
    lists = MESSAGE_LISTS if message else DONOR_LISTS
    df = df.withColumn(f"{prefix}_variants", found).withColumn(f"_{prefix}", evidence(F.col(f"{prefix}_variants"), message))
    return df.withColumns({f"{prefix}_{name}": F.col(f"_{prefix}.{name}") for name in lists}).drop(f"_{prefix}")


def some(name: str) -> Column:
    return F.size(name) > 0


def capped(name: str, most: int) -> Column:
    return F.least(F.size(name), F.lit(most))


def rule_score() -> Column:
    """Weighted evidence, with discounts for harmless context where no hard rule fired."""
    score = 5 * capped("msg_high", 2) + weight_sum(F.col("msg_hard")) + weight_sum(F.col("msg_promo")) + capped("msg_weak", 3)
    score = score + 2 * capped("donor_high", 1) + capped("donor_suspicious", 2) + capped("msg_suspicious", 2)
    harmless = ~some("msg_promo") & ~some("msg_high")
    slot_only = some("msg_gaming") & (F.size("msg_weak") == 1) & (F.get("msg_weak", F.lit(0))["id"] == "weak-slot")
    discount = F.when(slot_only, 3).otherwise(0) + F.when(some("msg_general") & harmless, 2).otherwise(0) + F.when(some("msg_anti") & harmless, 5).otherwise(0)
    return (score - F.when(some("msg_hard"), 0).otherwise(discount)).cast("int")


def classifier_boost(gambling: Column) -> Column:
    """Probability as -5 to 5 points, halves rounded up; null and non-finite as 0."""
    points = F.floor((gambling - 0.5) * (2 * fixed.CLASSIFIER_RANGE) + 0.5).cast("int")
    return F.coalesce(F.when(T.finite_or_null(gambling).isNotNull(), points), F.lit(0))


def decision(gambling: Column) -> Column:
    """struct<action, stage>: the first rule of the list that applies; a confident classifier lifts what is not blocked."""
    brand, promo = some("msg_high"), F.size("msg_promo")
    overridden = F.array_contains(F.array(*map(F.lit, fixed.GAMING_OVERRIDE_IDS)), F.get("msg_promo", F.lit(0))["id"])
    buckets = some("msg_high").cast("int") + some("msg_promo").cast("int") + (F.size("msg_weak") >= 2).cast("int") + some("msg_suspicious").cast("int")
    chain = F.exists("donor_suspicious", lambda h: h["id"] == "judol-chain")

    def verdict(action: str, stage: str | Column) -> Column:
        return F.struct(F.lit(action).alias("action"), (stage if isinstance(stage, Column) else F.lit(stage)).alias("stage"))

    ladder = (
        F.when(some("msg_anti") & ~some("msg_hard") & ~some("msg_promo") & ~brand, verdict("allow", "anti-judol-context"))
        .when(some("msg_hard"), verdict("block", "hard-message"))
        .when(some("donor_hard"), verdict("block", "hard-donor"))
        .when(brand | some("msg_near"), verdict("block", F.when(brand, "message-brand").otherwise("message-near-brand")))
        .when(some("donor_high") | some("donor_near"), verdict("block", F.when(some("donor_high"), "donor-brand").otherwise("donor-near-brand")))
        .when(chain, verdict("block", "donor-judol-chain"))
        .when(promo >= 2, verdict("block", "two-promo"))
        .when((promo == 1) & overridden & some("msg_gaming"), verdict("allow", "gaming-context-override"))
        .when(promo >= 1, verdict("review", "single-promo"))
        .when((F.col("score") >= 9) & (buckets >= 2), verdict("block", "score-threshold"))
        .when((F.col("score") >= 5) & (some("donor_high") | some("donor_suspicious") | some("msg_weak")), verdict("review", "review-threshold"))
        .otherwise(verdict("allow", "default"))
    )
    sure = F.coalesce(gambling >= fixed.CLASSIFIER_BLOCK, F.lit(False)) & ~F.isnan(F.coalesce(gambling, F.lit(0.0)))
    lifted = F.when(sure & (ladder["action"] != "block") & ~some("msg_anti"), verdict("block", "classifier-confident")).otherwise(ladder)
    blank = T.is_blank(F.col("donator")) & T.is_blank(F.col("message"))
    return F.when(blank, verdict("allow", "empty")).otherwise(lifted)


def reason(gambling: Column) -> Column:
    """key=value parts of the evidence, in order, joined by `; `."""
    boost = classifier_boost(gambling)
    known = T.finite_or_null(gambling)
    parts = [F.concat(F.lit("score="), F.col("score").cast("string")), F.concat(F.lit("classifier="), F.format_string("%.4f", known))]
    parts[1] = F.when(known.isNotNull(), parts[1])
    parts.append(F.when(known.isNotNull() & (boost != 0), F.concat(F.lit("classifierBoost="), F.when(boost > 0, "+").otherwise(""), boost.cast("string"))))
    shown = (
        ("hard", "msg_hard", previewed), ("donorHard", "donor_hard", previewed), ("promo", "msg_promo", previewed), ("msgBrands", "msg_high", listed),
        ("msgNearBrands", "msg_near", listed), ("donorBrands", "donor_high", listed), ("donorNearBrands", "donor_near", listed),
        ("donorSuspicious", "donor_suspicious", previewed), ("denounced", "msg_anti", listed), ("gamingSafe", "msg_gaming", listed),
        ("generalSafe", "msg_general", listed), ("strongGaming", "msg_strong", listed),
    )
    parts += [F.when(some(column), F.concat(F.lit(f"{name}="), show(F.col(column)))) for name, column, show in shown]
    text = F.concat_ws("; ", *parts)
    return F.when(T.is_blank(F.col("donator")) & T.is_blank(F.col("message")), F.lit("empty input")).otherwise(text)


EVIDENCE = [f"{p}_{n}" for p, names in (("donor", DONOR_LISTS), ("msg", MESSAGE_LISTS)) for n in ("variants", *names)]


def decide(df: DataFrame, donor_variants: Column, message_variants: Column, gambling: Column | None = None) -> DataFrame:
    """df (with donator, message) plus evidence columns, score, action, stage, reason. Narrow: no shuffle."""
    gambling = F.lit(None).cast("double") if gambling is None else gambling
    df = inspect(inspect(df, "donor", donor_variants, False), "msg", message_variants, True)
    blank = T.is_blank(F.col("donator")) & T.is_blank(F.col("message"))
    df = df.withColumn("score", F.when(blank, 0).otherwise(rule_score() + classifier_boost(gambling)).cast("int"))
    df = df.withColumns({"_decision": decision(gambling), "reason": reason(gambling)})
    return df.withColumns({"action": F.col("_decision.action"), "stage": F.col("_decision.stage")}).drop("_decision")
