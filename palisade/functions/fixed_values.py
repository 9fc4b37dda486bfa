"""Fixed values that moderation results depend on: word lists, patterns, maps, formats and the platform registry.

They are data, stated as they are: rules are (id, pattern, weight), patterns are case-insensitive and use
`\b` for a border of ASCII word characters. See palisade.functions.patterns for how engines read them.
"""

from __future__ import annotations

# ---- fixed values: letter stems that begin brand names ----
STEMS = (
    "pg eth hoki garuda naga macan zeus olympus dragon mahjong mpo sbo ibc raja dewa king sultan cuan gacor maxwin scatter "
    "ruang jago jagoan kantor winlive premier merahputih sundatoto rumahtoto pompa bandar angkasa juragan warung asia lexitoto "
    "bobatoto pay4d pgbet pgsoft totoplus bigbos mansion mega"
).split()

# ---- fixed values: brands (first mention keeps its place, later ones are the same brand) ----
BRANDS = tuple(dict.fromkeys((
    "kantorbola dewa4d dewatogel dewapoker dewabet dewaslot dewaqq rajabola rajaslot raja4d rajatoto kingbola kingdomtoto eth77 "
    "totoslot gacor77 slotgacor gaspol168 pragmatic4d olympus88 zeus88 zeusbola bigbos777 bigslot mposlot mpo007 mposport sbobet "
    "sbotop ibcbet maxwin138 maxbet agen138 138bet bola88 bola168 asiabet asia288 asia77 koin138 koin55 pay4d pay77 mansion77 "
    "mansion88 garuda4d angkasa168 angkasabet hoki303 hoki99 hokislot hokibet slot777 slot138 slot5000 kakekmerah4d jp88 jpslot "
    "jpmaxwin cuanwin cuan138 wow4d wow77 wowslot indoslot indotogel totowayang totomacau toto88 pools4d depobos depoxito pastijp "
    "juraganbola warunggacor toko4d boslot bosvegas vegas138 tangkas88 king88 mega888 3dbet uustoto kawantogel hokiraja pajero898 "
    "maxwin77 sultan88 dewa222 hokiemas88 mahjongjp88 mstoto gacor22 netizen303 olxtoto watitoto beton88 juli4d jagoslot88 "
    "nibung88 pg88 don178 totoslot288 nono4d pastijitu longfu88 99sl win4d pulau88 laga88 madu303 bimatoto jepe500 gboslot mitrajp "
    "ollo4d rk55 oyo99 oyoslot misterhoki nirwanapoker megaslot rajatogel rajagacor rajajp rajamaxwin kingslot bosku777 888slot "
    "juaraslot88 cindototo bobatoto pragmatic218 tempototo altertoto magnumslot kings128 armyslot88 bosgacor king88bet rajacuan "
    "kl108 ayamtoto generasitogel kembangtoto taruhanbet kumontoto jacktoto qqmacan lexitoto dayak777 desabet royalking4d "
    "pandora88 dewabet777 lunatoto lunastoto jagoan303 ratuslot lucu123 edctoto purnatoto tokek55 acgwin merahputih sundatoto "
    "rumahtoto winlive winlive4d pgbet totoplus bigbos pesanbola ligabola bola99 dewajp sultanjp gacor88 panen138 megajp bosstoto "
    "hokiwin naga168 zeus138 sultan77"
).split()))

# ---- fixed values: phrases ----
ANTI_PHRASES = ("anti judol", "stop judol", "bahaya judol", "iklan judol", "laporkan judol", "korban judol", "waspada judol", "haram judol", "penipuan judol", "jebakan judol")
GAMING_PHRASES = (
    "slot vip", "slot kosong", "slot penuh", "slot tim", "slot room", "room id", "kode room", "custom room", "open mabar", "mabar", "push rank", "scrim",
    "turnamen", "discord", "livestream", "stream", "mobile legends", "mlbb", "valorant", "pubg", "minecraft", "diamond", "dm", "map", "farm", "raid", "boss",
    "dungeon", "guild", "grind", "spawn", "respawn", "loot", "quest", "leveling",
)
STRONG_GAMING_PHRASES = ("moonton", "gacha", "mobile legends", "mlbb", "genshin", "honkai", "valorant", "pubg", "minecraft", "roblox", "dota", "free fire", "wild rift")
GENERAL_PHRASES = (
    "donasi", "sedekah", "amal", "rekening donasi", "transfer donasi", "rekening panitia", "masjid", "gereja", "kampus", "beasiswa", "kuliah", "invoice",
    "booking slot", "slot kelas", "store",
)

# ---- fixed values: sensitive terms of the dictionary matcher ----
SENSITIVE = "gacor maxwin cuan jackpot scatter rtp slot togel toto judol judi bocoran sultan depo deposit mindep rollingan rebate turnover freechip freebet freespin gacha withdraw".split()

# ---- fixed values: leet folds (characters, letters) ----
LEET_I = ("01345678@$!|", "oieasgtbasii")
LEET_L = ("01345678@$!|", "oleasgtbasil")
LEET_KEEP_468 = ("01357@$!|", "oiestasii")

# ---- fixed values: fragments of rules ----
STEM = r"(?:pg|eth|hoki|garuda|naga|macan|zeus|olympus|dragon|mahjong|mpo|sbo|ibc|raja|dewa|king|sultan|cuan|gacor|maxwin|scatter|ruang|jago(?:an)?|kantor|winlive|premier|merahputih|sundatoto|rumahtoto|pompa|bandar|angkasa|juragan|warung|asia|lexitoto|bobatoto|pay4d|pgbet|pgsoft|totoplus|bigbos|mansion|mega)"
NOUN = r"(?:gacor|maxwin|cuan|jp|jackpot|scatter|slot|togel|toto|judi|casino|kasino|rtp)"
QUALIFIER = r"(?:online|resmi|terpercaya|terbaik|hari\s*ini)"

# ---- fixed values: rules ----
HARD_RULES = (
    ("rtp-number", r"\brtp(?:\s*(?:live|slot|gacor|hari\s*ini))?\s*\d{2,3}(?:[.,]\d+)?%?\b", 6),
    ("gambling-noun-pair", rf"\b{NOUN}\s+(?:{NOUN}|{QUALIFIER})\b", 6),
    ("promo-link", r"\b(?:link|situs)\s+(?:alternatif|daftar|login|resmi)\b[\s\S]{0,25}\b(?:slot|togel|toto|judi|casino|bola)\b", 6),
    ("free-spin", r"\b(?:free\s*spin|freespin|free\s*bet|freebet|free\s*chip|freechip)s?\b", 6),
    ("slot-pattern", r"\bpola\s+(?:slot|gacor|scatter|rtp|maxwin|jp)\b", 5),
    ("jp-today", r"\b(?:jp|maxwin|jackpot)\s+(?:(?:besar|gede|terus|parah|gampang|banyak)\s+)?hari\s*ini\b", 6),
    ("judol-code-promo", r"\b(?:sp|mjw|goh|pp|ag|ln|sb|wwg)\s+(?:gacor|maxwin|cuan|jackpot|jp)\b", 6),
    ("trusted-page", r"\blaman\s+(?:baru|resmi|alternatif|terbaru)\b[\s\S]{0,30}\b(?:terpercaya|gacor|daftar|jp|slot|togel|toto|judi)\b", 5),
    ("depo-urgent", r"\b(?:ayo|yuk|buruan|mari|segera)\s+(?:depo|deposit|top\s*up|daftar|main|join|klik)\b", 5),
    ("gambling-brand-token", rf"\b{STEM}[a-z]*(?:\d{{2,}}[a-z0-9]*|\d[a-z]+[a-z0-9]*)\b", 5),
    ("gambling-brand-phrase", r"\b(?:garuda|naga|macan|raja|dewa|king|sultan|lucky|mpo|jago(?:an)?|angkasa|mega|bandar|warung)\s+(?:hoki|bola|slot|toto|togel|bet|win|gacor|jp|maxwin|cuan|jackpot|kasino|casino|asia|indo|thailand)\b", 6),
    ("try-at-brand", rf"\b(?:coba(?:in)?|main|mampir|daftar|join|judi|taruhan)\s+(?:di|ke|pada)\s+(?:situs\s+)?{STEM}[a-z0-9]*\d*\b", 6),
    ("stem-short-suffix", rf"\b{STEM}(?:jp|vip|bet|bola|slot|toto|togel|cuan|win)\d*\b", 5),
    ("bola-digits", r"\bbola\d+\b", 5),
    ("gambling-knek", r"\bknekk+\b", 5),
    ("pure-brandish-msg", r"^[\s\W]*[a-z]{2,}[\s\W]*(?:slot|toto|togel|bet|poker|bola)[a-z0-9]*[\s\W]*$", 5),
    ("leet-brand-token", r"\b[a-z]+\d+[a-z]+\d{2,}\b", 5),
    ("brand-suffix-token", r"\b(?!timeslots?\b)[a-z]{2,}(?:toto|togel|slot|bandar)\d*\b", 5),
    ("brand-bola-token", r"\b(?!sepakbola\b|basketbola\b|lapanganbola\b|bermainbola\b)[a-z]{3,}bola\d*\b", 5),
    ("gambling-stem-domain", rf"\b[a-z]*{STEM}[a-z]*\.(?:id|com|net|org|me|co|vip|site|online|xyz|bet|live|top|shop|gg|club|fun|biz)\b", 5),
    ("link-daftar", r"\blink\s+daftar\b", 5),
    ("link-gambling", r"\blink\s+(?:gacor|maxwin|cuan|jp|slot|togel|vip|alternatif)\b", 5),
    ("klik-link-redirect", r"\bklik\s+link\s+(?:di|pada|ke|pinned)\b", 5),
    ("profile-link-redirect", r"\b(?:cek|liat|lihat|buka)\s+profil\b[\s\S]{0,15}\blink\b", 5),
    ("info-pola", r"\binfo\s+pola(?:nya)?\b", 5),
    ("bocoran-context", r"\bbocoran\s+(?:admin|cs|room|pola|jam|waktu|hari\s*ini)\b", 5),
    ("shortener-gambling", r"\b(?:bit\.ly|tinyurl|t\.co|s\.id|cutt\.ly|bitly\.cc)\/[a-z0-9\-]*(?:gacor|slot|togel|jp|maxwin|hoki|cuan|bonus)", 5),
    ("kode-referral", r"\b(?:kode|pake|pakai)\s+referral\b", 5),
)
PROMO_RULES = (
    ("instant-cashout", r"\b(?:cair\s+(?:instan|kilat|terus|setiap\s+hari)|\d+\s*menit\s+cair|cair\s+(?:cuma\s+)?(?:dalam\s+)?(?:hitungan\s+)?(?:menit|detik)|tarik\s+(?:dana|saldo|uang|duit)[\s\S]{0,20}\bcair)\b", 3),
    ("no-fees", r"\btanpa\s+potongan\b", 3),
    ("server-thailand", r"\bserver\s+(?:thailand|kamboja|vietnam|luar\s*negeri|internasional)\b", 3),
    ("vip-account", r"\bakun\b[\s\S]{0,20}\b(?:vip|pro|thailand|sultan|platinum|elite|wangi|jp|gacor|hoki)\b", 3),
    ("leak-tip", r"\bbocoran\b[\s\S]{0,20}\b(?:rtp|pola|scatter|slot|gacor|jp|maxwin)\b", 4),
    ("wd-promo", r"\b(?:wd|withdraw|wede)(?:nya)?\s+(?:lancar|cepat|instan|mudah|kilat|cair+|berapa\s*pun)\b", 4),
    ("win-guarantee", r"\b(?:garansi|dijamin|pasti(?:nya)?|auto)\s+(?:\w+\s+)?(?:menang|jp|cuan|maxwin|jackpot|knek+|dapet|tembus|sukses|gacor|dibayar|bayar|cair+|scatter)\b", 4),
    ("sultan-promise", r"\b(?:jadi|jd|auto|langsung|instan|instant|pasti|dijamin)\s+sultan\b", 4),
    ("garansi-kekalahan", r"\b(?:garansi|jaminan|bonus)\s+(?:kekalahan|kalah|rugi|modal(?:\s+kembali)?)\b", 4),
    ("depo-wallet", r"\b(?:depo|deposit|mindep|dp)\s*(?:(?:via|pakai|pake|lewat)\s+)?(?:qris|dana|ovo|gopay|pulsa|linkaja|shopeepay)\b", 4),
    ("depo-amount", r"\b(?:depo|deposit|mindep|dp)\s*(?:(?:minimal|min)\s+)?(?:5k|10k|20k|25k|50k|100k|\d{1,3}\s?(?:k|rb))\b", 3),
    ("bonus-member", r"\bbonus\s+(?:member\s*baru|new\s*member|deposit|cashback|rollingan|rebate|turnover)\b", 4),
    ("money-giveaway", r"\b(?:bagi|bagikan)[\s-]*(?:bagi|2)\s+(?:saldo|dana|duit|bonus|uang|fs|freespin|freebet|chip)s?\b", 4),
    ("claim-bonus", r"\b(?:klaim|claim)\s+(?:bonus|saldo|cashback|chip|fs|freespin|freebet|cair|wd)s?\b", 4),
    ("cta-to-gamble", r"\b(?:join|daftar|klik|gas|cus|ayo|yuk|buruan|mari)\b[\s\S]{0,20}\b(?:slot|togel|toto|judi|casino)\b", 4),
    ("bank-account-setup", r"\b(?:no|nomor)\s+rek(?:ening)?\s+(?:aktif|standby|baru|siap|ready|ganti)\b", 3),
    ("win-chance", r"\bpeluang\s+(?:menang|cuan|jp|maxwin|jackpot|gede|besar)\b", 3),
    ("jp-claim", r"\b(?:jp|maxwin|jackpot|scatter)\s+(?:besar|gede|terus|parah|gampang|banyak)\b", 4),
    ("profit-boost", r"\bcuan\s+(?:gede|parah|gila|deras)\b", 4),
    ("profit-amount", r"\bcuan\s+(?:satu|dua|tiga|empat|lima|enam|tujuh|delapan|sembilan|sepuluh|seratus|seribu|sejuta|puluhan|ratusan|\d+)\s*(?:juta|ribu|jt|rb|m)\b", 4),
    ("online-gambling", r"\bpermainan\s+(?:online|judi|slot|gacor|kasino|casino)\b", 4),
    ("multiplier-hype", r"\b(?:jp|maxwin|jackpot|scatter|hadiah|bonus|cuan|petir\s+(?:merah|emas))\s*x\s*\d{2,}\b", 4),
    ("gambling-domain-tld", r"\b[a-z]{4,}\.(?:vip|site|online|xyz|bet|live|top|shop|gg|club|fun|biz)\b", 4),
    ("gambling-domain-branded", r"\b[a-z]{2,}(?:\d{2,}|\d+d)\.(?:id|com|net|org|me|co|vip|site|online|xyz|bet|live|top|shop|gg|club|fun|biz)\b", 4),
    ("site-pitch", r"\bsitus\s+(?:lama|baru|alternatif|resmi|terbaik|terpercaya|gacor|pasti|tergacor|terbaru|aman|besar|gede|jumbo)\b", 3),
    ("switch-to-site", r"\b(?:pindah|main|gabung|cus)\s+(?:sini|ke\s+sini|situs)\b", 3),
    ("wd-brand-digits", r"\b(?:wd|withdraw|wede|depo|deposit|cek)\s+[a-z]{2,}\d{2,}\b", 4),
    ("try-at-any-brand", r"\b(?:coba(?:in)?|main|mampir|daftar|join|judi|taruhan|depo|deposit|wd|withdraw)\s+(?:di|ke|pada)\s+(?:situs\s+)?[a-z]{2,}\d{2,}\b", 4),
    ("link-bio-generic", r"\blink\s+(?:di\s+)?(?:bio|profil|deskripsi|komentar|pinned)\b", 4),
    ("wd-amount-bragging", r"\b(?:wd|withdraw|wede)\s+(?:puluhan|jutaan|ratusan|ribuan|belasan)\s+(?:juta|rb|ribu|jt)\b", 4),
    ("gacor-intensifier", r"\bgacor\s+(?:banget|parah|gila|bener|bgt|amat|sekali)\b", 3),
    ("telegram-leak", r"\bgrup\s+tele(?:gram)?\s+(?:buat|untuk)\s+(?:info|bocoran|pola|scatter|rtp|gacor|admin)\b", 4),
    ("anti-rungkad", r"\b(?:anti|no|tanpa|nggak|gak|tidak)\s+rungkad\b", 4),
    ("game-sebelah", r"\b(?:game|situs|tempat|main)\s+sebelah\b", 3),
    ("admin-bocor", r"\badmin(?:nya)?\s+(?:lagi\s+)?bocor(?:in|kan|i)?\b", 4),
    ("kode-bonus", r"\b(?:kode|pake|pakai)\s+(?:referral|\w+)\s+(?:buat|untuk)\s+(?:tambahan|bonus|saldo|modal|spin|main|dapetin|dapat)\b", 4),
    ("shortlink-redirect", r"\b(?:bit\.ly|tinyurl|t\.co|s\.id|cutt\.ly|bitly\.cc|wde\.la|sid)\/[a-z0-9]+", 3),
    ("gambling-prep-brand", r"\b(?:gacor|maxwin|cuan|jp|jackpot|scatter|cair|bonus|menang|wd|withdraw|wede|hoki|sultan)\b[\s\S]{0,20}\b(?:di|ke|pada|sini)\s+[a-z]{3,}\d{2,}\b", 4),
)
WEAK_RULES = tuple((f"weak-{word}", rf"\b{word}\b", 1) for word in "slot togel toto gacor jp maxwin jackpot scatter rollingan rebate turnover mindep".split())
CHAIN_WORD = r"\b(?:sp|mjw|goh|pp|ag|ln|sb|wwg|maxwin|gacor|cuan|jackpot|slot|toto|togel|rtp|scatter|jp|wd)\b"
SUSPICIOUS_RULES = (
    ("brandish-suffix", r"\b[a-z0-9]{3,16}(?:slot|toto|togel|bet|poker|bola)\b", 2),
    ("brandish-prefix", r"\b(?:slot|toto|togel|bet|poker|bola)[a-z0-9]{2,12}\b", 2),
    ("digits-suffix", r"\b[a-z]{3,12}(?:88|99|777|4d|303|168|138|178|898|500)\b", 1),
    ("judol-chain", rf"{CHAIN_WORD}[\s._\-,:;]+{CHAIN_WORD}", 4),
)
GAMING_OVERRIDE_IDS = ("win-guarantee", "jp-claim", "profit-boost", "gacor-intensifier", "multiplier-hype", "win-chance")

# ---- fixed values: limits and thresholds ----
MAX_FIELD = 4096
MAX_REPEAT, MAX_VARIANTS = 2, 16
BRAND_SUBSTRING_MIN, NEAR_BRAND_MIN, NEAR_BRAND_DISTANCE = 6, 9, 2
CLASSIFIER_RANGE, CLASSIFIER_BLOCK = 5, 0.85
NEAR_MISS, TRUNCATE = 3, 80
RATE_WINDOW_MS, RATE_MAX = 60_000, 30
BATCH_ROWS, MAX_TOKENS = 32, 512
FLAG_TTL_MS, SCORER_LIMIT_MS = 2_000, 5_000

# ---- fixed values: characters with two readings (code point, letters in order) ----
TWO_READINGS = (
    (0x166, "FT"), (0x196, "IL"), (0x1B2, "VU"), (0x26F, "WM"), (0x27E, "RJ"), (0x28D, "MW"), (0x393, "RT"), (0x3C2, "CS"), (0x3C6, "PQ"), (0x414, "AD"),
    (0x424, "OQ"), (0x433, "RL"), (0x547, "TC"), (0x5E2, "YV"), (0x10EA, "BG"), (0x13B4, "SD"), (0x13D6, "JT"),
)

# ---- fixed values: letters that read as the Latin letter after them; styled ones of mathematics by the plain letter ----
READ_ACCENTED = "ÄA åA ĂA ąA ǟA ÇC çC ĆC ČC ĎD ÈE êE ēE ĔE ĞG ģG ĤH ÌI ìI ïI ĨI ĬI įI ĴJ ĶK ķK ĹL ĻL ñN ŃN ŇN ÖO õO ŐO ƠO ơO ǪQ ợQ ŔR ŕR ŘR ŚS ŞS şS šS ţT ŤT ÚU ùU ųU ỮU ŴW ŶY ŹZ ŽZ žZ ẔZ"
READ_LATIN = "ƛA ßB ɮB ɔC ÐD ƸE ȝE ɟF ʄF ƃG ǶH ɧH łI ɿI ʆJ ʅL ŋN ðO þP ƿP ƢQ ǪQ ợQ ƦR ƧS ƚT ɬT ɄU ʊU ƔV ƜW"
READ_GREEK = "ΔA ΛA άA αA λA βB ΞE ΣE έE εE ϜF ϝF ΉH ίI ιI ἶI κK ϰK ΜM ήN ηN ῆN σO όO ρP ΩQ ϙQ ϚS ͲT υU νV ὗV ωW ώW ῳW χX ψY"
READ_CYRILLIC = "АA аA БB бB вB ҍB дD ԃD ЄE ёE єE ҽE ғF ӺF нH ђH ҺH ӇH ԋH ЇI їI јJ КK кK ҚK қK ҜK ҟK ҠK ҡK ӄK ГL ӀL МM мM ѪM ѫM ИN ЙN ЛN ПN пN ѲO ѳO ӨO РP фQ ҨQ ҩQ ЯR яR ѕS тT ЦU цU ѴV ѵV ШW ЩW щW ЖX жX ҲX ҳX ӼX ӾX УY ЧY уY чY ӋY ЗZ зZ"
READ_ARMENIAN = "ԹA ՅB ԺD ժD ԲF ԳG ցG հH յJ ԸL ԼL ՆL ՈN ՌN ղN ռN ԾO օO քP զQ ՐR ՏS ֆS ԵT էT ԱU ՄU մU աW ՃX ՎY վY ՀZ չZ"
READ_MONEY = "₳A ฿B ¢C ₵C €E £F ₣F ₲G ₭K ₥M ₦N ₱P ₴S ₮T ₩W ¥Y"
READ_STYLED_GREEK = "ΔA αA ΒB βB ςC δD ΣE εE ΗH λH ΙI ΚK κK ιL ΩM ΠN ηN ΘO θO ΡP ρP ΦQ φQ ΓR γR ΤT τT μU ∇V νV πW ΧX χX ΨY ψY ΖZ"

# ---- fixed values: sequences that read as one letter (code points, letter), replaced in this order ----
LIGATURES = (
    ("5C2 5B4 3B1 5C2 5C5 5C5", "A"), ("3D0 ECB 5A2 5C2 5B4 8EA", "B"), ("255 5B4 5C4 2D6", "C"), ("19C9 597 1A60", "E"), ("192 597 5B4", "F"),
    ("5C2 5C5 19C1", "G"), ("5C5 5C4 10E9 5B4 5C2", "H"), ("742 8ED 742 AAB1 8EA 5C5", "I"), ("742 29D 597 5C5", "J"), ("8EA 5B4 199 5B8 5C2", "K"),
    ("8ED 8EA AA91", "M"), ("8EA 5B4 1992 1A60 5C2 5C5", "O"), ("8EA 2118 82D 5BA 5B9 5B9 5B9 5B4", "P"), ("ECB 8EA 5B4 ABF1 5B8 5C2", "S"),
    ("597 5B4 ECB 236 5C2 5C5", "T"), ("5C2 5C5 1A30 1A60 82D 5C5 5C2", "W"), ("5C2 1A2E 5C5 742 5C2", "Y"), ("1F170 FE0F", "A"), ("1F171 FE0F", "B"),
    ("21A9 FE0F", "D"), ("1F3F3 FE0F", "F"), ("2139 FE0F", "I"), ("24C2 FE0F", "M"), ("26A1 FE0F", "N"), ("1F17F FE0F", "P"), ("AE FE0F", "R"),
    ("270C FE0F", "V"), ("15BD 1438", "K"), ("259E 259A 20", "A"), ("2AF7 20", "C"), ("2588 2630 20", "E"), ("2588 2580 20", "F"), ("1F136 20", "G"),
    ("2588 25AC 2588 20", "H"), ("2588 20", "I"), ("2588 25C0 20", "K"), ("2599 20", "L"), ("2590 25AE 258C 20", "M"), ("2588 2580 2588 20", "N"),
    ("2B24 20", "O"), ("259B 20", "P"), ("259C 20", "Q"), ("2588 2598 20", "R"), ("2584 2588 2580 20", "S"), ("2580 2588 2580 20", "T"),
    ("2588 2584 2588 20", "U"), ("259A 259E 20", "V"), ("259A 259E 259A 259E 20", "W"), ("2AF8 2AF7 20", "X"), ("2580 2584 2580 20", "Y"),
    ("2580 2588 2584 20", "Z"),
)

# ---- fixed values: platforms ----
PLATFORMS = (
    {"platform": "saweria", "name": "Saweria", "stream_key_param": "streamKey", "overlays": ["alert", "mediashare"], "asset_origin": "https://saweria.co", "backend_origin": "https://backend.saweria.co", "backend_path_prefix": None, "forward_headers": [], "impersonate": False},
    {"platform": "tako", "name": "Tako", "stream_key_param": "overlay_key", "overlays": ["alert", "mediashare"], "asset_origin": "https://tako.id", "backend_origin": "https://tako.id/api", "backend_path_prefix": "/api", "forward_headers": ["x-queued-gift-ids", "x-played-gift-ids", "authorization"], "impersonate": False},
    {"platform": "bagibagi", "name": "BagiBagi", "stream_key_param": "streamKey", "overlays": ["alertbox"], "asset_origin": "https://bagibagi.co", "backend_origin": "https://bagibagi.co/api", "backend_path_prefix": "/api", "forward_headers": [], "impersonate": True},
    {"platform": "sociabuzz", "name": "Sociabuzz", "stream_key_param": "streamKey", "overlays": ["alert", "mediashare"], "asset_origin": "https://sociabuzz.com", "backend_origin": "https://sociabuzz.com/pro", "backend_path_prefix": "/pro", "forward_headers": [], "impersonate": False},
)
DEFAULT_PLATFORM = "saweria"
MIME_TYPES = {"json": "application/json", "js": "application/javascript", "css": "text/css", "html": "text/html", "svg": "image/svg+xml", "txt": "text/plain", "xml": "application/xml"}

# ---- fixed values: characters that normalisation removes, and marks that set letters apart ----
INVISIBLE = r"[​-‏‪-‮⁠﻿­]"
ORNAMENTS = r"[•¤¦§¨¬¯°´¶˜∀-⋿─-◿⦀-⧿⬀-⯿、-〿぀-ゟ゠-ヿ㐀-䶿一-鿿｜\[\]{}]"
PICTURES = r"[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F7E0}-\x{1F7FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{27BF}\x{24C2}-\x{24FF}\x{1F1E0}-\x{1F1FF}]"
EMOJI = rf"{PICTURES}[\x{{FE0E}}\x{{FE0F}}\x{{20E3}}]?(?:\x{{200D}}{PICTURES}[\x{{FE0E}}\x{{FE0F}}]?|[\x{{1F3FB}}-\x{{1F3FF}}])*"
CHAIN_MARKS = r"._\-/\\,:;*+|~"
#: Letters that were set apart: by marks, by blanks, and short groups by dots, lines and dashes.
SET_APART = (rf"\b[a-z0-9](?:\s*[{CHAIN_MARKS}]\s*[a-z0-9])+\b", r"\b[a-z0-9](?:\s+[a-z0-9])+\b", r"\b[a-z0-9]{1,3}(?:\s*[._\-]\s*[a-z0-9]{1,3})+\b")

# ---- fixed values: traces of delivery networks in pages ----
ARTEFACTS = (
    r' crossorigin="[^"]*"',
    r' integrity="[^"]*"',
    r'(?i)<script[^>]*src="[^"]*cdn-cgi[^"]*"[^>]*>[\s\S]*?</script>',
    r"(?i)<script[^>]*rocket-loader[^>]*>[\s\S]*?</script>",
    r"(?i)<script[^>]*cloudflareinsights[^>]*>[\s\S]*?</script>",
    r"(?i)<link[^>]*builds/meta[^>]*>",
)
