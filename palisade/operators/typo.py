"""Dictionary and typo matching of tokens: a relational form, and a narrow form for whole texts.

The relational form matches distinct tokens once and joins on hashed deletions (what is left when a letter or two go), so that the
edit distance is an equi join for dictionaries of any size. The narrow form runs the same ladder in Arrow batches with a memory of tokens seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palisade.functions import fixed_values as fixed
from palisade.functions import text as T
from palisade.sources.events import small_batches

#: A small dictionary of everyday words; pass a larger one where there is one.
EVERYDAY = tuple(dict.fromkeys(
    "abang ada adalah agak agar air akan aku akun alat anak anda apa apakah asik atau awal ayo bagaimana bagi bagus bahwa baik baju bangun banyak baru batas beberapa belajar beli belum benar "
    "berapa berita besar besok biar biasa bisa bola buat buka bukan buku bulan buruan cara cari cepat cinta coba cuma dalam dan dapat dari datang dengan depan dia diri dulu dunia enak fans film gaji "
    "gambar gampang ganti gue guru habis hadiah halo hari harga harus hati hidup hijau hujan ibu ikut ini itu jadi jalan jam jangan jika juga jual kakak kalau kali kami kamu kapan karena kasih "
    "kata kawan kecil keluar kembali kenal kenapa kerja kita klik kode kopi kota kurang lagi lagu lain laku lama langsung lebih lewat lihat link lucu luar main makan makin malam mana mantap masih "
    "masuk mau merah minta minum mobil modal motor mulai murah musik naik nama nanti nonton orang pagi pakai paket panas panci pasti perlu pergi pernah pilih pindah pola profil pulang putaran "
    "ramai resmi rumah sama sampai sangat satu saya sebelum sehat sekarang selalu selamat semangat semua sendiri senang sering server setiap siang siapa situs suara sudah suka sukses tadi tahu "
    "tahun tanya tapi teman tembus tempat terima terus tetap tidak tidur tim tua tugas turun uang udah untuk waktu warung yang".split()
))
KINDS = ("sensitive-exact", "exact", "normalized", "sensitive-fuzzy", "fuzzy", "unknown")


def dictionary_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct words of lines: trimmed, lower case, only those of the letters a to z."""
    return lines.select(F.lower(T.js_trim(F.col(column))).alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()


#: Different words that a task holds before it hands on their counts.
WORDS_HELD = 200_000
#: ASCII letters in lower case; a blank for any other byte.
_LETTERS = bytes(c | 32 if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) of the runs of ASCII letters in texts, in lower case. Each task counts its own texts' words before any is sent."""

    def counts(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for own in batch.column(0).cast(pa.binary()).drop_null().to_pylist():
                held.update(own.translate(_LETTERS).split())
                if len(held) >= WORDS_HELD:
                    yield counts(held)
                    held.clear()
        yield counts(held)

    found = small_batches(texts.select(text)).mapInArrow(run, "word string, n long").where("word is not null")
    return found.groupBy("word").agg(F.sum("n").alias("count"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The words of a text file, one a line."""
    return dictionary_words(spark.read.text(path))


def known_words(words: DataFrame, most: int = 1_000_000) -> tuple[str, ...]:
    """A dictionary (word) as the option `words` of the plan, in order; refused where it is larger than every worker should hold."""
    found = words.select("word").orderBy("word").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a dictionary of more than {most} words is not held by every worker; use fuzzy_join")
    return tuple(r["word"] for r in found)


def most_distance(length: Column) -> Column:
    return F.when(length < 5, 0).when(length < 7, 1).otherwise(2)


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.left(a, i) == F.left(b, i)))
    return F.size(same)


#: Most edits between a token and its match.
MOST_EDITS = 2

#: Hashes of texts go up by powers of an odd number, in 64 bits.
_BASE = 0x9E3779B97F4A7C15
#: What takes one and two powers back.
_BACK, _BACK_TWO = (np.uint64(pow(_BASE, -by, 1 << 64)) for by in (1, 2))


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Characters as 64 bits each."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _keys(texts: list[str], most: int, kept: int) -> np.ndarray:
    """Hashes of texts of one length without up to `most` (2 at most) of their characters after the first `kept`, a row each.

    A text hashes to the sum of its characters' bits times powers of _BASE, so that a deletion moves what is right of it one power down.
    """
    n, length = len(texts), len(texts[0])
    codes = np.array(texts, f"U{max(length, 1)}").view(np.uint32).reshape(n, -1)[:, :length]
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(length, _BASE, np.uint64)]))[:length]
    left = np.zeros((n, length + 1), np.uint64)
    np.cumsum(_mixed(codes) * powers, axis=1, out=left[:, 1:])
    whole, at = left[:, -1:], np.arange(kept, length)
    out = [whole]
    if most >= 1:
        out.append(left[:, at] + (whole - left[:, at + 1]) * _BACK)
    if most >= 2:
        i, j = (at[k] for k in np.triu_indices(len(at), 1))
        out.append(left[:, i] + (left[:, j] - left[:, i + 1]) * _BACK + (whole - left[:, j + 1]) * _BACK_TWO)
    return np.concatenate(out, axis=1)


#: Hashes that one vectorised step makes, about.
_KEYS_AT_ONCE = 1 << 20


def _key_lists(texts: list[str | None], most: np.ndarray, kept: int) -> pa.Array:
    """The distinct hashes of each text; null for null, and for fewer edits than none."""
    lengths = np.array([-1 if t is None or edits < 0 else len(t) for t, edits in zip(texts, most, strict=True)], np.int64)
    groups, place = np.unique(np.stack([lengths, np.clip(most, 0, MOST_EDITS)], 1), axis=0, return_inverse=True)
    found, counts = [], np.zeros(len(texts), np.int64)
    for number, (length, edits) in enumerate(groups.tolist()):
        if length < 0:
            continue
        rows = np.flatnonzero(place.ravel() == number)
        step = max(1, _KEYS_AT_ONCE // (1 + length * (1 + length * (edits == 2))))
        for first in range(0, len(rows), step):
            own = rows[first : first + step]
            keys = np.sort(_keys([texts[r] for r in own], edits, min(kept, length)), axis=1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            counts[own] = new.sum(axis=1)
            found.append((own, keys[new]))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    values = np.empty(offsets[-1], np.uint64)
    for own, keys in found:
        starts = np.cumsum(counts[own]) - counts[own]
        values[np.arange(len(keys)) + np.repeat(offsets[own] - starts, counts[own])] = keys
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)), mask=pa.array(lengths < 0))


def deletion_keys(x: Column, most: Column, same_first: bool) -> Column:
    """Hashes of what is left of a text when up to `most` (2 at most) characters are deleted; null where `most` is.

    Texts within so many edits of each other share a key. Where only texts of one first character are to meet, it is never deleted: a
    common beginning takes part in no edit. All texts of one length in an Arrow batch are hashed together.
    """

    @arrow_udf("array<bigint>")
    def run(texts: pa.Array, edits: pa.Array) -> pa.Array:
        return _key_lists(texts.to_pylist(), edits.fill_null(-1).to_numpy(), int(same_first))

    return run(x, most)


def fuzzy_join(tokens: DataFrame, words: DataFrame, same_first: bool) -> DataFrame:
    """(token, match, distance): the best word within the token's distance, of tokens (token) and words (ord, word).

    Best: least distance, then longest common prefix, then longer word, then order. same_first asks for the same first letter.
    An equi join on deletion keys: a token meets the words that share what is left of it, never all words of its length, so the
    dictionary may be large. Met pairs are measured, and the best is taken by a pre-aggregated minimum. Tokens longer than
    any word can be match nothing and make no keys.
    """
    longest = words.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("longest"))
    most = most_distance(F.length("token"))
    t = tokens.select("token").distinct().crossJoin(F.broadcast(longest)).where(F.length("token") <= F.col("longest") + most)
    # Tokens that are too short make no keys, where a filter on them would move below the count of words and have it made twice.
    t = t.select("token", F.explode(deletion_keys(F.col("token"), F.when(most > 0, most), same_first)).alias("key"))
    w = words.select("ord", "word", F.explode(deletion_keys(F.col("word"), F.lit(MOST_EDITS), same_first)).alias("key"))
    # Measured once a pair. A comparison of first letters by itself would become a second key of the join, and the one to sort by.
    met = (F.left("token", F.lit(1)) == F.left("word", F.lit(1))) if same_first else F.lit(True)
    one, two = (F.levenshtein("token", "word", edits) for edits in (1, MOST_EDITS))
    near = t.join(w, "key").where(F.when(met & (most > 0), F.when(most == 1, one).otherwise(two)) >= 0).withColumn("distance", two)
    best = F.min(F.struct("distance", -common_prefix(F.col("token"), F.col("word")), -F.length("word"), "ord", "word")).alias("b")
    return near.groupBy("token").agg(best).select("token", F.col("b.word").alias("match"), F.col("b.distance").cast("int").alias("distance"))


def ladder_join(tokens: DataFrame, words: DataFrame, sensitive: tuple[str, ...] = tuple(fixed.SENSITIVE), fuzzy: bool = True) -> DataFrame:
    """(token, kind, match, via, distance) of distinct tokens (token) and a dictionary (ord, word) of any size.

    The same ladder as match_tokens, by joins: nothing of the dictionary is held by a worker. A null token counts as empty.
    """
    bare = F.regexp_replace(F.lower(T.js_trim(F.coalesce("token", F.lit("")))), "^[^a-z0-9]+|[^a-z0-9]+$", "")
    every = tokens.select("token").distinct().withColumn("bare", bare)
    real = every.where((F.col("bare") != "") & ~F.col("bare").rlike("^[0-9]+$")).select("bare").distinct()
    folds = [T.fold_leet(F.col("bare"), fold) for fold in (fixed.LEET_I, fixed.LEET_L)]
    forms = F.array_distinct(F.filter(F.array(F.col("bare"), T.tighten(F.col("bare")), *folds, *map(T.tighten, folds)), lambda f: f != ""))
    forms = real.select("bare", F.posexplode(forms).alias("k", "form"))

    def first(found: DataFrame, name: str) -> DataFrame:
        """Of the forms (bare, k, form, match, distance) of each token, the first."""
        best = F.min(F.struct("k", "form", "match", F.col("distance").cast("int").alias("distance"))).alias(name)
        return found.groupBy("bare").agg(best)

    def same(found: DataFrame) -> DataFrame:
        return found.withColumns({"match": F.col("form"), "distance": F.lit(None).cast("int")})

    known = words.select(F.col("word").alias("form")).distinct()
    terms = words.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, sensitive))).alias("ord", "word"))
    steps = {
        "sensitive-exact": same(forms.where(F.col("form").isin(*sensitive))),
        "exact": same(forms.where("k = 0").join(known, "form", "left_semi")),
        "normalized": same(forms.join(known, "form", "left_semi")),
        "sensitive-fuzzy": forms.join(fuzzy_join(forms.select(F.col("form").alias("token")), terms, False).withColumnRenamed("token", "form"), "form"),
    }
    if fuzzy:
        steps["fuzzy"] = forms.join(fuzzy_join(forms.where(~F.col("form").rlike("[0-9]")).select(F.col("form").alias("token")), words, True).withColumnRenamed("token", "form"), "form")
    found = real
    for i, step in enumerate(steps.values()):
        found = found.join(first(step, f"s{i}"), "bare", "left")
    kind = F.coalesce(*[F.when(F.col(f"s{i}").isNotNull(), F.lit(name)) for i, name in enumerate(steps)], F.lit("unknown"))
    hit = F.coalesce(*[F.col(f"s{i}") for i in range(len(steps))])
    found = found.select("bare", kind.alias("kind"), hit["match"].alias("match"), F.when(kind == "exact", None).otherwise(hit["form"]).alias("via"), hit["distance"].alias("distance"))
    return every.join(found, "bare", "left").select("token", F.coalesce("kind", F.lit("unknown")).alias("kind"), "match", "via", "distance")


# ---- the ladder over one token, for Arrow batches ----

_SET_APART = tuple(re.compile(pattern, re.A) for pattern in fixed.SET_APART)
#: Without such a place a text has nothing set apart: a letter alone before a mark or blank, or a short group before a dot, line or dash.
_MAYBE_APART = re.compile(rf"\b[a-z0-9](?:\s*[{fixed.CHAIN_MARKS}]|\s+[a-z0-9]\b)|\b[a-z0-9]{{1,3}}\s*[._\-]", re.A)
_BLANKS = re.compile(r"(\s+)")
_LEET = tuple(str.maketrans(*fold) for fold in (fixed.LEET_I, fixed.LEET_L))


def tightened(text: str) -> str:
    if text.isalnum() or not _MAYBE_APART.search(text):
        return text
    for pattern in _SET_APART:
        text = pattern.sub(lambda m: re.sub(r"[^a-z0-9]+", "", m[0]), text)
    return text


def forms_of(token: str) -> list[str]:
    """The token, its leet readings, and their tightened forms: distinct, in order."""
    folded = [token.translate(fold) for fold in _LEET]
    return [f for f in dict.fromkeys([token, tightened(token), *folded, *map(tightened, folded)]) if f]


def bounded_distance(a: str, b: str, most: int) -> int | None:
    """Edit distance if at most `most` (a small number), else None. Common ends take part in no edit."""
    if abs(len(a) - len(b)) > most:
        return None
    if a == b:
        return 0
    if not most:
        return None
    first, short = 0, min(len(a), len(b))
    while first < short and a[first] == b[first]:
        first += 1
    last = 0
    while last < short - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return len(a) + len(b)
    # Both begin with other characters: one of them goes, or both.
    found = [d for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])) if (d := bounded_distance(x, y, most - 1)) is not None]
    return min(found) + 1 if found else None


def _letters(text: str) -> int:
    """The characters of a text as bits; an edit changes two of them at most."""
    bits = 0
    for c in text:
        bits |= 1 << (ord(c) & 63)
    return bits


class _Words:
    """Words in order, and which of them may be within some edits of a token by their characters."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = list(words)
        self.bits = np.array([_letters(w) for w in self.words], np.uint64)

    def near(self, token: str, most: int) -> list[tuple[int, str]]:
        bits = self.bits ^ np.uint64(_letters(token))
        return [(place, self.words[place]) for place in np.flatnonzero(np.bitwise_count(bits) <= 2 * most).tolist()]


class Matcher:
    """Sensitive terms and a dictionary; match() tells what a token is."""

    def __init__(self, words: tuple[str, ...] = EVERYDAY, sensitive: tuple[str, ...] = tuple(fixed.SENSITIVE), fuzzy: bool = True):
        self.words, self.sensitive, self.fuzzy = dict.fromkeys(words), dict.fromkeys(sensitive), fuzzy
        by_start: dict[str, list[str]] = {}
        for word in self.words:
            by_start.setdefault(word[0], []).append(word)
        self.terms = _Words(self.sensitive)
        self.by_start = {start: _Words(own) for start, own in by_start.items()}
        self.match = lru_cache(100_000)(self._match)

    def _nearest(self, token: str, words: _Words | None) -> tuple[str, int] | None:
        most = 0 if len(token) < 5 else 1 if len(token) < 7 else 2
        best = None
        for place, word in words.near(token, most) if most and words else ():
            distance = bounded_distance(token, word, most)
            if distance is not None:
                shared = next((i for i, (x, y) in enumerate(zip(token, word)) if x != y), min(len(token), len(word)))
                rank = (distance, -shared, -len(word), place)
                best = min(best, (rank, word, distance)) if best else (rank, word, distance)
        return best and best[1:]

    def _match(self, raw: str) -> tuple[str, str | None, str | None, int | None]:
        """(kind, match, via, distance), the first step of the ladder that holds."""
        token = raw.lower().strip()
        if not token.isascii() or not token.isalnum():
            token = re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", token)
        if not token or token.isdigit():
            return "unknown", None, None, None
        forms = forms_of(token)
        for form in forms:
            if form in self.sensitive:
                return "sensitive-exact", form, form, None
        if token in self.words:
            return "exact", token, None, None
        for form in forms:
            if form in self.words:
                return "normalized", form, form, None
        for form in forms:
            if found := self._nearest(form, self.terms):
                return "sensitive-fuzzy", found[0], form, found[1]
        for form in forms if self.fuzzy else ():
            if not re.search("[0-9]", form):
                if found := self._nearest(form, self.by_start.get(form[0])):
                    return "fuzzy", found[0], form, found[1]
        return "unknown", None, None, None

    def canonical(self, text: str) -> str:
        """The text with every token replaced by its match; white space stays as it is."""
        parts = _BLANKS.split(text)
        parts[::2] = [p and (self.match(p)[1] or p.lower().strip()) for p in parts[::2]]
        return "".join(parts)


_matchers: dict[tuple, Matcher] = {}


def _matcher(words: tuple[str, ...], fuzzy: bool) -> Matcher:
    key = (words, fuzzy)
    if key not in _matchers:
        _matchers[key] = Matcher(words, fuzzy=fuzzy)
    return _matchers[key]


def canonical_texts(bases: Column, words: tuple[str, ...] = EVERYDAY, fuzzy: bool = True) -> Column:
    """array<string> -> array<string>: each text with its tokens replaced by dictionary or sensitive matches."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(words, fuzzy)
        for batch in batches:
            yield batch.map(lambda texts: None if texts is None else [matcher.canonical(t) for t in texts])

    return run(bases)


def match_tokens(df: DataFrame, token: str, words: tuple[str, ...] = EVERYDAY, fuzzy: bool = True) -> DataFrame:
    """df plus kind, match, via, distance of the token column; tokens are matched once per worker and remembered."""

    @F.pandas_udf("kind string, match string, via string, distance int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(words, fuzzy)
        for batch in batches:
            yield pd.DataFrame([matcher.match(t or "") for t in batch], columns=["kind", "match", "via", "distance"]).astype({"distance": "Int32"})

    return df.withColumn("_m", run(F.col(token))).select("*", "_m.*").drop("_m")


def score_texts(df: DataFrame, key: str, text: str, words: tuple[str, ...] = EVERYDAY, fuzzy: bool = True) -> DataFrame:
    """Per key: tokens, and counts by kind, of white-space tokens; texts without tokens count zero."""
    parts = df.select(key, F.explode_outer(F.filter(F.split(F.coalesce(text, F.lit("")), T.SPACE + "+"), lambda t: t != "")).alias("token"))
    found = match_tokens(parts, "token", words, fuzzy)
    real = F.col("token").isNotNull()
    return found.groupBy(key).agg(F.count("token").alias("tokens"), *[F.count_if(real & (F.col("kind") == kind)).alias(kind.replace("-", "_")) for kind in KINDS])
