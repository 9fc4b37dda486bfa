"""Donations over the driver's event table: the same view for Spark and for SQL oracles.

The event table holds no messages, so donor and message texts are dealt from the lists below by event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.sources.events import into_tasks

DONORS = ("user one", "admin_hoki88", "budi", "cs kantorbola", "promo4", "", "rajaslot official", "sitislot", "maxwin gacor", "nina", None, "kantirbola fan", "slot jp wd", "pandawa99")
_SPOKEN = (
    "halo bang salam kenal", "daftar di hoki88 sekarang", "rtp live 98% hari ini", "slot kosong buat mabar malam", "stop judol bahaya banget",
    "pasti jp di boss room", "server thailand lancar", "bonus new member tanpa potongan", "nonton sepakbola sama teman", "ubah timeslot ke jam 3",
    "link daftar ada di bio", "main di zeus88 yuk", "cuan gede parah hari ini", "gacor banget streamnya dungeon", "depo via dana minimal 10k",
    "kantorbolla99 asli", "slot togel toto lengkap", "donasi buat masjid", "booking slot kelas kampus", "garuda hoki menang terus",
    "eth 77 lagi ramai", "hoki 50 orang", "cek bit.ly/gacor-hari-ini", "maxwin dot com palsu", "login ke dewajp.vip",
    "wd lancar cair kilat", "kode ini buat tambahan modal", "peluang menang gede", "mabar valorant jp terus", "akun gue wangi banget",
    # Rules that no text above fires.
    "link alternatif paling aman buat slot", "dapat free spin gratis", "pola scatter malam", "maxwin besar hari ini", "sp gacor lagi", "laman resmi yang terpercaya",
    "bola88 rame", "knekk terus", "mantap slot", "di megatoto99 aja", "nonton gilabola88", "klik link di pinned", "cek profil gue ada link", "info polanya dong",
    "bocoran admin malam", "pakai referral gue", "bocoran jam ini rtp naik", "auto sultan besok", "garansi kekalahan penuh", "depo minimal 20k", "bagi bagi saldo gratis",
    "klaim bonus harian", "ayo kita slot bareng", "nomor rekening aktif siap", "cuan lima juta semalam", "permainan kasino asik", "scatter x500 barusan", "buka toko88.com",
    "situs terbaik pilihan", "pindah ke sini aja", "cek abang77 dulu", "link di bio ya", "wd puluhan juta", "grup tele buat info", "anti rungkad club", "game sebelah ramai",
    "admin lagi bocorin", "menang terus di abc77", "slotmania asik", "rollingan harian", "rebate mingguan", "turnover penuh", "mindep kecil",
    # Near brands, texts that only folds, joins, typos and dictionary steps undo, and several rules at once.
    "kantirbola lagi", "pragmaticc4d ramai", "h0k188 p4st1 c4ir", "k a n t o r b o l a 9 9 wd", "s/u/l/t/a/n/j/p", "g.a.c.o.r bgt", "hoki   303 lagi", "wooow gacooor!!! mantappp",
    "pazti menang", "servar thailand", "gacorr parah", "m4xw1n", "toto 4 dan rebate slot", "sl0t t0gel", "cuan!!! besar...", "$ultan88", "jp,wd;slot", "turnover rebate slot jp mindep",
    "", None, "scatter dan jackpot di slot", "aku suka kopi", "joker77x88 link vip", "jagoan33 menang", "buruan daftar sebelum habis",
)
#: Every phrase stands in a text of its own.
MESSAGES = (*_SPOKEN, *(f"cerita {phrase} tadi" for phrase in dict.fromkeys((*fixed.ANTI_PHRASES, *fixed.GAMING_PHRASES, *fixed.STRONG_GAMING_PHRASES, *fixed.GENERAL_PHRASES))))
PLATFORM_SQL = "CASE event_id % 4 WHEN 0 THEN 'saweria' WHEN 1 THEN 'tako' WHEN 2 THEN 'bagibagi' ELSE 'sociabuzz' END"


def dealt(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def dealt_sql(values: tuple, key: str) -> str:
    return f"([{', '.join(map(quoted, values))}])[({key}) % {len(values)} + 1]"


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """donation_id, ts, platform, donator, message, amount, currency, user_id, event_type."""
    events = into_tasks(spark.read.parquet(f"{sf_dir}/events.parquet"))
    key = F.col("event_id")
    return events.select(
        key.alias("donation_id"), "ts", F.expr(PLATFORM_SQL).alias("platform"), dealt(DONORS, F.floor(key / 7).cast("long")).alias("donator"),
        dealt(MESSAGES, key).alias("message"), F.col("value").alias("amount"), F.lit("IDR").alias("currency"), "user_id", "event_type",
    )


DONATIONS_SQL = f"""donations AS (SELECT event_id AS donation_id, ts, {PLATFORM_SQL} AS platform, {dealt_sql(DONORS, 'event_id // 7')} AS donator,
  {dealt_sql(MESSAGES, 'event_id')} AS message, value AS amount, 'IDR' AS currency, user_id, event_type FROM events)"""
