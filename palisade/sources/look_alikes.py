"""Builds look-alike tables from character sets: which letters a code point or a sequence stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: code points that are pictures, not letters (first, last) ----
PICTURE_RANGES = ((0x2600, 0x27BF), (0x1F300, 0x1FAFF), (0x1F1E0, 0x1F1FF), (0xFE00, 0xFE0F))


def _is_picture(code: Column) -> Column:
    found = F.lit(False)
    for low, high in PICTURE_RANGES:
        found = found | code.between(low, high)
    return found


def build_look_alikes(sets: DataFrame, order: list[str], key: str = "key", glyph: str = "glyph") -> DataFrame:
    """sequence, letters, kind of rows (key: one ASCII letter, glyph: what stands for it), by code point; letters in the order of `order`.

    kind is 'single' (one code point, one letter), 'several' (one code point, more letters) or 'ligature' (more code points).
    Letters are upper case, each once, in the order they first come in. Keys that are no ASCII letter, empty and null glyphs,
    glyphs equal to their key, ASCII letters and pictures are left out. Pairs are reduced before they are gathered, so
    a sequence never has more than 26 entries.
    """
    rows = sets.select(F.col(key).alias("k"), F.col(glyph).alias("g"), F.struct(*order).alias("o"))
    rows = rows.where(F.col("k").rlike("^[A-Za-z]$") & (F.length("g") > 0) & (F.col("g") != F.col("k")))
    code = F.ascii(F.col("g"))
    alone = F.length("g") == 1
    rows = rows.where(~alone | ~(F.col("g").rlike("^[A-Za-z]$") | _is_picture(code)))
    first = rows.groupBy("g", F.upper("k").alias("letter")).agg(F.min("o").alias("o"))
    gathered = first.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("o", "letter"))).alias("l"))
    letters = F.array_join(F.transform("l", lambda x: x["letter"]), "")
    kind = F.when(F.length("g") > 1, "ligature").when(F.size("l") > 1, "several").otherwise("single")
    # Bytes of UTF-8 sort as code points do; the table is bounded by Unicode.
    return gathered.select(F.col("g").alias("sequence"), letters.alias("letters"), kind.alias("kind")).orderBy("sequence")


def tables(built: DataFrame) -> dict[str, tuple]:
    """The options look_alikes, readings and ligatures of normalize_text from a built table (bounded by Unicode, so it is read whole)."""
    rows = built.orderBy("sequence").collect()
    return {
        "look_alikes": ("".join(r["sequence"] for r in rows if r["kind"] == "single"), "".join(r["letters"] for r in rows if r["kind"] == "single")),
        "readings": tuple((ord(r["sequence"]), r["letters"]) for r in rows if r["kind"] == "several"),
        "ligatures": tuple((r["sequence"], r["letters"][0]) for r in rows if r["kind"] == "ligature"),
    }
