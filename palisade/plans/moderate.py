"""The whole moderation plan: one narrow transform for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import audit, scoring
from palisade.operators.decision import EVIDENCE, decide
from palisade.operators.payloads import block_frames, first_flagged, parse_frame
from palisade.operators.preparing import variants
from palisade.operators.typo import EVERYDAY
from palisade.sources.events import small_batches

METHODS = ("algorithm", "classifier", "both")
DONOR_REPLACEMENT, MESSAGE_REPLACEMENT = "***", "***"


def moderate(df: DataFrame, method: str = "algorithm", scorer: scoring.Scorer | None = None, killed: Column | None = None, words: tuple[str, ...] | None = EVERYDAY, fuzzy: bool = True, evidence: bool = False) -> DataFrame:
    """df (donator, message strings) plus score, action, stage, reason, and the evidence columns if wanted.

    method: rules only, classifier only, or both (its probability joins the score). scorer turns the classifier's
    text into a probability; null, where it fails, falls back to the rules. words is the dictionary of the
    typo step; None leaves the step out. fuzzy also takes the nearest word of the dictionary, not only equal ones. killed
    rows are allowed without a decision.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    columns = df.columns
    df = df.withColumns({"donator": T.as_string(F.col("donator")), "message": T.as_string(F.col("message"))})
    # Readings are arrays of their own projection: the steps below refer to them, not to their making.
    df = df.withColumns({"_donor_bases": T.normalize_text(F.col("donator")), "_msg_bases": T.normalize_text(F.col("message"))})
    gambling = None
    if method != "algorithm":
        joined = F.concat_ws(" ", F.nullif("donator", F.lit("")), F.nullif("message", F.lit("")))
        text = scoring.classifier_text(F.col("donator"), F.col("message"), T.normalize_text(joined))
        df = df.withColumn("_text", text).withColumn("_gambling", (scorer or scoring.stub_score)(F.col("_text")))
        gambling = F.col("_gambling")
    made = decide(df, variants(F.col("_donor_bases"), words, fuzzy), variants(F.col("_msg_bases"), words, fuzzy), gambling if method == "both" else None)
    if method == "classifier":
        own = scoring.label_verdict((gambling > 0.5).cast("int"), gambling)
        nothing = F.struct(F.lit("allow").alias("action"), F.lit("classifier").alias("stage"), F.lit("empty-input").alias("reason"))
        verdict = F.when(F.col("_text") == "", nothing).otherwise(own)
        made = made.withColumn("_v", verdict)
        made = made.withColumns({n: F.coalesce(F.col(f"_v.{n}"), F.col(n)) for n in ("action", "stage", "reason")}).drop("_v")
    if killed is not None:
        made = made.withColumns({"action": F.when(killed, "allow").otherwise(F.col("action")), "stage": F.when(killed, "killed").otherwise(F.col("stage"))})
    return made.select(*columns, *(EVIDENCE if evidence else []), "score", "action", "stage", "reason")


def check(df: DataFrame, **options: object) -> DataFrame:
    """df (platform, donator, message, ...) plus the decision, its response and its audit marker."""
    killed = options.get("killed")
    made = moderate(df, **options)
    return made.withColumn("response", audit.verdict_response(F.col("action"), DONOR_REPLACEMENT, MESSAGE_REPLACEMENT)).withColumn("marker", audit.marker(F.col("action"), F.col("stage"), F.col("reason"), killed))


def check_frames(frames: DataFrame, **options: object) -> DataFrame:
    """frames (platform, raw and any other columns) plus donations, first_block, delivered, checked.

    Narrow, for batches and streams: donations are exploded, decided and folded back in place. Only the first row of a
    frame carries its columns. Null frames, and those that hold no donation, go on as they are.
    """
    parsed = small_batches(frames).withColumn("donations", parse_frame(F.col("platform"), F.col("raw")))
    each = parsed.select(F.struct(*parsed.columns).alias("frame"), F.posexplode_outer("donations").alias("_pos", "_d"))
    each = each.select(F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("frame")).alias("frame"), "_d.donator", "_d.message")
    made = moderate(each, **options).select("frame", (F.col("action") == "block").alias("flag"))
    return block_frames(first_flagged(made).select("frame.*", "first"), F.col("first"), DONOR_REPLACEMENT, MESSAGE_REPLACEMENT).drop("first")


def feedback(df: DataFrame) -> DataFrame:
    """df (ts, donator, message, decision, verdict) plus error and, for accepted rows, line."""
    error = audit.feedback_error(F.col("decision"), F.col("verdict"), F.col("message"))
    line = audit.feedback_line(F.col("ts"), F.col("decision"), F.col("verdict"), F.col("donator"), F.col("message"))
    return df.withColumn("error", error).withColumn("line", F.when(F.col("error").isNull(), line))
