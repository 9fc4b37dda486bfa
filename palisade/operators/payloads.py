"""Event frames of the donation platforms: parsing, blocking and rewriting.

Frames are JSON texts. They are read through the VARIANT type, so that a value of a wrong type is told apart from
its text form. Rewriting keeps unknown fields, so it edits the parsed JSON in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

RECORD_END = "\x1e"
DONATION = "struct<donator:string,message:string,amount:double,currency:string>"


def _string(v: Column, path: str) -> Column:
    """The string at a path; null where it is missing, empty or of another type."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def _number(v: Column, path: str) -> Column:
    """The number at a path; 0 where it is missing or falsy, null where it is of another type."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = F.when(~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(v, path, "double"))
    falsy = kind.isNull() | (kind == "VOID") | ((kind == "BOOLEAN") & (F.try_variant_get(v, path, "boolean") == F.lit(False))) | ((kind == "STRING") & (F.try_variant_get(v, path, "string") == ""))
    return F.when(falsy, F.lit(0.0)).otherwise(number)


def _donation(donator: Column, message: Column, amount: Column, currency: Column) -> Column:
    filled = [F.coalesce(c, F.lit("")) for c in (donator, message, currency)]
    return F.struct(filled[0].alias("donator"), filled[1].alias("message"), amount.alias("amount"), filled[2].alias("currency"))


def _items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def parse_saweria(raw: Column) -> Column:
    """array of donations, or null where the frame is not one of donations."""
    v = F.try_parse_json(raw)
    found = F.transform(_items(v, "$.data"), lambda x: _donation(_string(x, "$.donator"), _string(x, "$.message"), _number(x, "$.amount"), _string(x, "$.currency")))
    return F.when(_string(v, "$.type") == "donation", found)


def parse_bagibagi(raw: Column) -> Column:
    v = F.try_parse_json(F.replace(raw, F.lit(RECORD_END), F.lit("")))
    found = F.transform(_items(v, "$.arguments"), lambda x: _donation(F.coalesce(_string(x, "$.preferedName"), _string(x, "$.username")), _string(x, "$.message"), _number(x, "$.amount"), F.lit("IDR")))
    return F.when(_string(v, "$.target") == "Donation", found)


def leading_int(x: Column) -> Column:
    """The integer that a text begins with, else 0."""
    digits = F.regexp_extract(F.coalesce(x, F.lit("")), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(0)).cast("double")


def parse_sociabuzz(raw: Column) -> Column:
    """Each message's data is an object or its JSON text; one text that does not parse voids the frame."""
    v = F.try_parse_json(raw)
    inner = F.transform(_items(v, "$.messages"), lambda m: F.when(F.schema_of_variant(F.try_variant_get(m, "$.data", "variant")) == "STRING", F.try_parse_json(F.try_variant_get(m, "$.data", "string"))).otherwise(F.try_variant_get(m, "$.data", "variant")))
    found = F.transform(inner, lambda x: _donation(_string(x, "$.fullname"), _string(x, "$.note"), leading_int(F.try_variant_get(x, "$.amount", "string")), F.coalesce(_string(x, "$.currency"), F.lit("IDR"))))
    return F.when((F.try_variant_get(v, "$.action", "double") == 15) & ~F.exists(inner, lambda x: x.isNull()), found)


def tako_signal(raw: Column) -> Column:
    v = F.try_parse_json(F.replace(raw, F.lit(RECORD_END), F.lit("")))
    return F.coalesce(_string(v, "$.event") == "messages", F.lit(False))


def parse_tako(raw: Column) -> Column:
    """array of the one donation of a response body; null where sender or message is missing."""
    v = F.try_parse_json(raw)
    sender, message = F.try_variant_get(v, "$.result.sender", "variant"), _string(v, "$.result.message")
    found = F.array(_donation(_string(v, "$.result.sender.name"), message, _number(v, "$.result.amount"), _string(v, "$.result.currency")))
    return F.when(sender.isNotNull() & message.isNotNull(), found)


PARSERS = {"saweria": parse_saweria, "bagibagi": parse_bagibagi, "sociabuzz": parse_sociabuzz, "tako": parse_tako}


def parse_frame(platform: Column, raw: Column) -> Column:
    found = F.lit(None).cast(f"array<{DONATION}>")
    for name, parse in PARSERS.items():
        found = F.when(platform == name, parse(raw)).otherwise(found)
    return found


def rewritten(platform: str, raw: str, donor: str | None, message: str | None) -> str:
    """The frame with every donation's names and message replaced and its voice removed; raw where it does not parse."""
    try:
        frame = json.loads(raw.replace(RECORD_END, "") if platform == "bagibagi" else raw)
        ending = ""
        if platform == "saweria":
            for item in frame["data"]:
                _fill(item, donor, message, ("donator",), "message")
                item["tts"] = None
        elif platform == "bagibagi":
            for item in frame["arguments"]:
                _fill(item, donor, message, ("preferedName", "username"), "message")
                item["audioData"] = None
            ending = RECORD_END
        elif platform == "sociabuzz":
            for entry in frame["messages"]:
                item = json.loads(entry["data"]) if isinstance(entry["data"], str) else entry["data"]
                _fill(item, donor, message, ("fullname",), "note")
                entry["data"] = _dumped({k: v for k, v in item.items() if k not in ("tts", "voice_note")})
        elif platform == "tako":
            _fill(frame["result"]["sender"], donor, None, ("name",), "")
            _fill(frame["result"], None, message, (), "message")
        else:
            return raw
        return _dumped(frame) + ending
    except (ValueError, KeyError, TypeError, AttributeError):
        return raw


def _fill(item: dict, donor: str | None, message: str | None, names: tuple[str, ...], text: str) -> None:
    if donor:
        item.update(dict.fromkeys(names, donor))
    if message:
        item[text] = message


def _dumped(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def rewrite_frames(platform: Column, raw: Column, donor: Column, message: Column) -> Column:
    """Each frame rewritten, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(names: pd.Series, frames: pd.Series, donors: pd.Series, messages: pd.Series) -> pd.Series:
        return pd.Series([r if r is None else rewritten(p, r, d, m) for p, r, d, m in zip(names, frames, donors, messages, strict=True)], dtype="object")

    return run(platform, raw, donor, message)


def first_flagged(each: DataFrame) -> DataFrame:
    """frame (struct, on the first of its rows), flag -> a row for each frame: frame, first (place of its first flag, from 0, or null).

    The rows of a frame lie one after the other, as exploding leaves them, so they are folded where they are: nothing is shuffled, no
    frame is gathered, and it works the same over streams. Only the last frame's head is held from batch to batch.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: pa.Array | None = None
        place, found = 0, None  # rows of the open frame so far, and its first flag
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column(0).is_valid()))
            flags = np.flatnonzero(np.asarray(batch.column(1).fill_null(False)))
            ends = [*starts.tolist(), batch.num_rows]
            if head is not None and found is None and len(flags) and flags[0] < ends[0]:
                found = place + int(flags[0])
            place += ends[0]
            if not len(starts):
                continue
            # Every frame that ends here: the open one, and all that begin here but the last.
            nearest = np.append(flags, batch.num_rows)[np.searchsorted(flags, starts)]
            own = [int(f - b) if f < e else None for b, f, e in zip(starts.tolist(), nearest.tolist(), ends[1:], strict=True)]
            heads = batch.column(0).take(pa.array(starts))
            done = heads.slice(0, len(starts) - 1)
            firsts = own[:-1]
            if head is not None:
                done, firsts = pa.concat_arrays([head, done]), [found, *firsts]
            yield pa.RecordBatch.from_arrays([done, pa.array(firsts, pa.int32())], ["frame", "first"])
            head, found, place = heads.slice(len(starts) - 1, 1), own[-1], batch.num_rows - int(starts[-1])
        if head is not None:
            yield pa.RecordBatch.from_arrays([head, pa.array([found], pa.int32())], ["frame", "first"])

    schema = StructType([StructField("frame", each.schema["frame"].dataType), StructField("first", IntegerType())])
    return each.select("frame", "flag").mapInArrow(work, schema)


def block_frames(frames: DataFrame, first: Column, donor: str, message: str) -> DataFrame:
    """frames (platform, raw, donations) plus first_block (place of the first blocked donation from 0, or null), delivered, checked.

    The first blocked donation has the whole frame rewritten; later ones are not looked at.
    """
    out = frames.withColumn("first_block", first.cast("int"))
    changed = F.col("first_block").isNotNull()
    out = out.withColumn("delivered", F.when(changed, rewrite_frames(F.col("platform"), F.col("raw"), F.lit(donor), F.lit(message))).otherwise(F.col("raw")))
    return out.withColumn("checked", F.when(changed, F.col("first_block") + 1).otherwise(F.coalesce(F.size("donations"), F.lit(0))).cast("int"))
