"""Column functions that undo text obfuscation: normalisation, leet folds, tightening, tokens.

All are built-in expressions; only Unicode normal forms go through a static method of the ICU library that
ships with Spark. Functions take and return columns; null stays null unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from unicodedata import name as unicode_name
from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.functions.patterns import BORDER, SPACE, WHITE



def beyond(lowest: int) -> str:
    """The beginning of a pattern of characters from `lowest` on: one comparison for all others, where a class of many ranges takes one for each."""
    return f"(?=[^\\x00-\\x{{{lowest - 1:x}}}])"


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+\z", "")


def squeeze_space(x: Column) -> Column:
    """Runs of white space as one blank, ends trimmed, lower case."""
    # Only what changes is matched: single blanks are most of a text's white space. No other white space is left to trim.
    return F.lower(F.trim(F.regexp_replace(x, f"{SPACE}{{2,}}|[{WHITE}&&[^ ]]", " ")))


def strip_invisible(x: Column) -> Column:
    return F.regexp_replace(x, beyond(0xAD) + fixed.INVISIBLE, "")


def strip_ornaments(x: Column) -> Column:
    return F.regexp_replace(x, "(?![ -Z^-z])" + fixed.ORNAMENTS, "")


def strip_emoji(x: Column) -> Column:
    """Emoji sequences vanish; what is left of their ranges becomes a blank."""
    first = beyond(0x24C2)  # of PICTURES
    return F.regexp_replace(F.regexp_replace(x, first + fixed.EMOJI, ""), rf"{first}(?:{fixed.PICTURES}|[\x{{FE00}}-\x{{FE0F}}])+", " ")


def collapse_repeats(x: Column, most: int = fixed.MAX_REPEAT) -> Column:
    """Runs of three or more of a character as `most` of it."""
    return F.regexp_replace(x, r"(.)\1{2,}", "$1" * most)


def collapse_punctuation(x: Column) -> Column:
    """A run of punctuation as its last mark."""
    return F.regexp_replace(x, r"([.!?,;:~\-]){2,}", "$1")


def collapse_long_runs(x: Column) -> Column:
    """A character alone between blanks four times or more, or a letter four times or more, as one."""
    return F.regexp_replace(x, r"(?<!\S)(\S)\1{3,}(?!\S)|(\p{L})\2{3,}", "$1$2")


def compatible(x: Column) -> Column:
    """Unicode normal form KC; null becomes empty."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(x, F.lit("")), F.lit(True))


def strip_marks(x: Column) -> Column:
    """Compatibility decomposition without combining marks; null becomes empty."""
    apart = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(x, F.lit("")), F.lit(True))
    return F.regexp_replace(apart, r"\p{M}", "")


#: Beginnings of Unicode names that end in a single ASCII letter: such characters read as that letter.
READS_AS = ("LATIN CAPITAL LETTER", "LATIN SMALL LETTER", "LATIN LETTER SMALL CAPITAL", "FULLWIDTH LATIN", "CIRCLED LATIN", "SQUARED LATIN", "NEGATIVE CIRCLED LATIN", "NEGATIVE SQUARED LATIN", "OLD ITALIC LETTER", "MATHEMATICAL", "MODIFIER LETTER")
#: Letters of further scripts that look like Latin letters (public knowledge of confusable shapes), pairwise.
SHAPES = (
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
    "СсХхһԛԝԁ"
    "ոհ"
    "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏚᏙᏞᏟᏢᏦᏴ"
    "ᗅᗩᗷᑕᗞᗪᕼᒍᒪᗰᑎᑭᖇᔕᑌᐯᗯ᙭ᘔᖴ"
    "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
    "₵₫₣₲₤",
    "ABEZHIKMNOPTYX" "CcXxhqwd" "nh" "DRTiAJEWMHYGhZbRWSVLCPKB" "AABCDDHJLMNPRSUVWXZF" "BPdDTGKJCZFMNLSRVHWXYAEIOU" "CdFGL",
)


@cache
def look_alikes() -> tuple[str, str]:
    """(characters, ASCII letters) of all code points that read as one letter.

    By rank: the stated letters, styled Greek letters by their plain letter, Unicode names that end in one letter, then SHAPES. Letters
    that decompose into one and its marks are left to the normal forms unless stated, and characters with several readings to `branches`.
    """
    two = {chr(code) for code, _ in fixed.TWO_READINGS}
    table = dict(zip(*SHAPES, strict=True)) | {"$": "S"}
    for code in [*range(0x80, 0x3000), *range(0xA720, 0xAB70), *range(0xFF00, 0xFFF0), *range(0x10300, 0x10330), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        letter = chr(code)
        words = unicode_name(letter, "").split(" WITH ")[0].split()
        if len(words) > 1 and len(words[-1]) == 1 and "A" <= words[-1] <= "Z" and " ".join(words).startswith(READS_AS) and len(normalize("NFD", letter)) == 1:
            table[letter] = words[-1]
    styled = {pair[0]: pair[1] for pair in fixed.READ_STYLED_GREEK.split()}
    table |= {chr(code): styled[plain] for code in range(0x1D6A8, 0x1D7CC) if (plain := normalize("NFKD", chr(code))) in styled}
    for stated in (fixed.READ_ACCENTED, fixed.READ_LATIN, fixed.READ_GREEK, fixed.READ_CYRILLIC, fixed.READ_ARMENIAN, fixed.READ_MONEY):
        table |= {pair[0]: pair[1] for pair in stated.split()}
    kept = {a: b for a, b in table.items() if a not in two}
    return "".join(kept), "".join(kept.values())


@cache
def ligatures() -> tuple[tuple[str, str], ...]:
    """(sequence, letter), replaced in order: the stated sequences, and a flag letter with a blank behind it.

    A letter under a combining mark needs no entry: normal forms drop the mark.
    """
    stated = [("".join(chr(int(code, 16)) for code in codes.split()), letter) for codes, letter in fixed.LIGATURES]
    return (*stated, *((chr(0x1F1E6 + i) + " ", chr(ord("A") + i)) for i in range(26)))


def fold_ligatures(x: Column, pairs: tuple[tuple[str, str], ...] | None = None) -> Column:
    """Sequences of several characters that stand for a letter; texts without any such sequence are left as they are."""
    pairs = ligatures() if pairs is None else pairs
    if not pairs:
        return x
    # Most characters of a text are ASCII and begin none: they take one comparison, or that with a small class.
    tried = []
    for own, first in (([a for a, _ in pairs if a[0] <= "\x7f"], ""), ([a for a, _ in pairs if a[0] > "\x7f"], beyond(0x80))):
        if own:
            heads = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({a[0] for a in own}))
            tried.append(f"{first}(?=[{heads}])(?:{'|'.join(''.join(f'\\x{{{ord(c):x}}}' for c in a) for a in own)})")
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return F.when(x.rlike("|".join(tried)), F.aggregate(known, x, lambda done, p: F.replace(done, p["a"], p["b"]))).otherwise(x)


def fold_look_alikes(x: Column, table: tuple[str, str] | None = None) -> Column:
    return F.translate(x, *(table or look_alikes()))


def branches(x: Column, most: int = fixed.MAX_VARIANTS, readings: tuple[tuple[int, str], ...] = fixed.TWO_READINGS) -> Column:
    """All readings of characters with several readings, in order, unless there would be more than `most`: then the first reading."""
    if not readings:
        return F.array(x)
    escaped = "".join(f"\\x{{{code:x}}}" for code, _ in readings)
    known = F.create_map(*[F.lit(part) for code, r in readings for part in (chr(code), r)])

    def grow(found: Column, part: Column) -> Column:
        letters = known[part]
        every = F.flatten(F.transform(found, lambda b: F.transform(F.split(letters, ""), lambda one: F.concat(b, one))))
        one = F.transform(found, lambda b: F.concat(b, F.left(letters, F.lit(1))))
        plain = F.transform(found, lambda b: F.concat(b, part))
        return F.when(letters.isNull(), plain).when(F.size(found) * F.length(letters) > most, one).otherwise(every)

    chars = escaped
    # Letters with several readings, and what stands between them as a whole.
    split = F.aggregate(F.split(x, f"(?<=[{chars}])|(?=[{chars}])"), F.array(F.lit("")), grow)
    return F.when(x.rlike(beyond(min(code for code, _ in readings)) + f"[{chars}]"), split).otherwise(F.array(x))


def cleaned(x: Column, most: int = fixed.MAX_REPEAT) -> Column:
    """What follows the folds: normal forms, repeats, emoji, ornaments, invisibles, punctuation, white space, case."""
    x = collapse_repeats(strip_marks(fold_look_alikes(compatible(x))), most)
    x = strip_invisible(strip_ornaments(strip_emoji(x)))
    return squeeze_space(collapse_long_runs(collapse_punctuation(x)))


def normalize_text(x: Column, most_repeat: int = fixed.MAX_REPEAT, most_variants: int = fixed.MAX_VARIANTS, ligatures: tuple[tuple[str, str], ...] | None = None, look_alikes: tuple[str, str] | None = None, readings: tuple[tuple[int, str], ...] = fixed.TWO_READINGS) -> Column:
    """Distinct plain readings of a text, in order. Null and empty give one empty reading.

    `look_alikes` (characters, letters), `readings` (code point, letters) and `ligatures` (sequence, letters; replaced first, in order) are
    tables of one's own, such as palisade.sources.look_alikes makes; without them the rules of this module hold. Plain
    ASCII without marks skips the folds.
    """
    x = F.coalesce(x, F.lit(""))
    wide = x.rlike(r"[^\x00-\x7f]")
    ascii_only = squeeze_space(collapse_long_runs(collapse_punctuation(F.regexp_replace(collapse_repeats(F.translate(x, "$", "S"), most_repeat), r"[\[\]{}]", ""))))
    read = once(fold_look_alikes(fold_ligatures(x, ligatures), look_alikes), lambda folded: branches(folded, most_variants, readings))
    full = F.array_distinct(F.transform(read, lambda b: cleaned(b, most_repeat)))
    return F.when(wide, full).otherwise(F.array(ascii_only))


def fold_leet(x: Column, fold: tuple[str, str] = fixed.LEET_I) -> Column:
    return F.translate(x, *fold)


def fold_leet_smart(x: Column) -> Column:
    """Marks always fold; a digit folds only between two letters of the text as it was."""
    digits, letters = "01345678", "oieasgtb"
    near = F.regexp_replace(x, r"(?<=[A-Za-z])([01345678])(?=[A-Za-z])", "\u0001$1")
    out = F.translate(near, "@$!|", "asii")
    for digit, letter in zip(digits, letters, strict=True):
        out = F.replace(out, F.lit("\u0001" + digit), F.lit(letter))
    return out


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x made once, however often it is used: what stands twice inside higher-order functions is else made twice."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def rewrite_matches(x: Column, pattern: str, clean) -> Column:
    """The text with clean(match) for every match of the pattern."""

    def rewritten(text: Column) -> Column:
        gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(gaps, F.transform(found, clean), lambda gap, match: F.concat(gap, F.coalesce(match, F.lit("")))), "")

    return once(x, rewritten)


def tighten(x: Column) -> Column:
    """Joins letters that were set apart: by marks, by blanks, and short groups by dots, lines and dashes."""
    # What begins and ends with word characters needs to look at one side of its borders only.
    blank, begin, end = rf"{SPACE}*", "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    marked = rf"(?i){begin}[a-z0-9](?:{blank}[{fixed.CHAIN_MARKS}]{blank}[a-z0-9])+{end}"
    spaced = rf"(?i){begin}[a-z0-9](?:{SPACE}+[a-z0-9])+{end}"
    groups = rf"(?i){begin}[a-z0-9]{{1,3}}(?:{blank}[._\-]{blank}[a-z0-9]{{1,3}})+{end}"
    x = rewrite_matches(x, marked, lambda m: F.regexp_replace(m, rf"(?:{SPACE}|[{fixed.CHAIN_MARKS}])+", ""))
    x = rewrite_matches(x, spaced, lambda m: F.regexp_replace(m, f"{SPACE}+", ""))
    return rewrite_matches(x, groups, lambda m: F.regexp_replace(m, rf"(?:{SPACE}|[._\-])+", ""))


def wordify(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "[^a-zA-Z0-9]+", " "))


def squeeze(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, "[^a-zA-Z0-9]+", ""))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))


def close_gaps(x: Column) -> Column:
    """Letters and digits that a blank parts, joined where they make a brand or a stem with no round number."""
    pattern = rf"(?i){BORDER}([a-z]{{2,8}}){SPACE}+(\d{{2,4}}){BORDER}"
    brands, stems = F.array(*map(F.lit, fixed.BRANDS)), F.array(*map(F.lit, fixed.STEMS))

    def clean(match: Column) -> Column:
        joined = F.lower(F.regexp_replace(match, f"{SPACE}+", ""))
        letters, digits = F.regexp_extract(joined, "^[a-z]+", 0), F.regexp_extract(joined, "[0-9]+$", 0)
        good = F.array_contains(brands, joined) | (F.array_contains(stems, letters) & ~digits.rlike("^[1-9]0+$"))
        return F.when(good, joined).otherwise(match)

    return F.when(x.rlike(pattern), rewrite_matches(x, pattern, clean)).otherwise(x)


def with_forms(values: Column) -> Column:
    """Each text, tightened, wordified: distinct, in order, without empty ones."""
    forms = F.flatten(F.transform(values, lambda v: F.array(v, tighten(v), wordify(v))))
    return F.array_distinct(F.filter(forms, lambda v: v != ""))


def folded(base: Column) -> Column:
    return F.array(base, fold_leet(base), fold_leet(base, fixed.LEET_L), fold_leet(base, fixed.LEET_KEEP_468), fold_leet_smart(base))


def variants(bases: Column, canonical: Column | None = None) -> Column:
    """Ordered distinct variants of the readings: leet folds with their forms, canonical texts, closed gaps."""
    bases = F.filter(bases, lambda b: b != "")
    seeds = F.flatten(F.transform(bases, folded))
    if canonical is not None:
        seeds = F.concat(seeds, F.filter(canonical, lambda c: c != ""))
    first = with_forms(seeds)
    closed = F.filter(F.transform(first, lambda v: F.when(close_gaps(v) != v, close_gaps(v)).otherwise(F.lit(""))), lambda v: v != "")
    return F.array_distinct(F.concat(first, with_forms(closed)))


def all_tokens(found: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(found, tokens)))


def all_squeezed(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, squeeze), lambda v: v != ""))


# ---- scalar validation and audit formats ----


def as_string(x: Column, most: int = fixed.MAX_FIELD) -> Column:
    """A text of at most `most` UTF-16 units; null becomes empty."""
    x = F.coalesce(x, F.lit(""))
    units = F.transform(F.split(x, ""), lambda c: F.when(F.octet_length(c) == 4, 2).otherwise(1))
    ends = F.aggregate(units, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda a, u: F.when(a["sum"] + u <= most, F.struct((a["sum"] + u).alias("sum"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(most + 1).alias("sum"), a["n"].alias("n"))))["n"]
    astral = x.rlike(r"[\x{10000}-\x{10FFFF}]") & (F.length(x) * 2 > most)
    return F.when(astral, F.left(x, ends)).otherwise(F.left(x, F.lit(most)))


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sanitize(x: Column) -> Column:
    """One line for a log: line ends and tabs become a blank, ends trimmed; null becomes empty."""
    return js_trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n\t]+", " "))


def truncate(x: Column, most: int = fixed.TRUNCATE) -> Column:
    x = F.coalesce(x, F.lit(""))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(most - 1)), F.lit("…")))


def parse_score(reason: Column) -> Column:
    found = F.regexp_extract(F.coalesce(reason, F.lit("")), r"score=(-?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def format_score(score: Column) -> Column:
    whole = score.cast("long").cast("string")
    cut = F.regexp_replace(F.format_string("%.2f", score), r"\.?0+$", "")
    return F.when(score.isNull(), "?").when(score == F.floor(score), whole).otherwise(cut)


def parse_field(reason: Column, name: str) -> Column:
    return js_trim(F.regexp_extract(F.coalesce(reason, F.lit("")), rf"(?:^|;\s*){name}=([^;]+)", 1))


def is_blank(x: Column) -> Column:
    return js_trim(F.coalesce(x, F.lit(""))) == ""
