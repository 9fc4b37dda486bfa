"""All queries of the moderation engine over the driver's tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.functions import text as T
from palisade.operators import audit, evidence, matching, payloads, scoring, state, typo, web
from palisade.operators.decision import decide
from palisade.plans import full_oracles as full
from palisade.plans import oracles as O
from palisade.operators.preparing import variants as prepared
from palisade.plans.moderate import check, check_frames, moderate
from palisade.plans.salted import DONATIONS_SQL, MESSAGES, dealt, dealt_sql, donations
from palisade.sources.events import into_tasks, request_fields
from palisade.sources.look_alikes import build_look_alikes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, with its oracle."""

    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return into_tasks(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def plain(x: Column) -> Column:
    """One variant: the lower-cased text; none where it is empty."""
    return F.filter(F.array(F.lower(F.coalesce(x, F.lit("")))), lambda v: v != "")


# ---- scalar functions over whole documents ----


def _over_documents(name: str, columns: Callable[[Column], dict[str, Column]], oracle: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in columns(F.col("text")).items()])

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = f"SELECT doc_id, {oracle} FROM documents"


_over_documents("sanitize_truncate", lambda text: {"line": F.md5(T.sanitize(text)), "short": T.truncate(text)}, r"md5(trim(regexp_replace(text, '[\r\n\t]+', ' ', 'g'))) AS line, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END AS short")
_over_documents("text_squeeze", lambda text: {"squeezed": F.md5(T.squeeze(text))}, "md5(lower(regexp_replace(text, '[^a-zA-Z0-9]+', '', 'g'))) AS squeezed")
_over_documents("text_wordify", lambda text: {"words": F.md5(T.wordify(text))}, "md5(trim(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))) AS words")
_over_documents("text_tokens", lambda text: {"n_tokens": F.size(T.tokens(text)), "n_distinct": F.size(T.all_tokens(F.array(text)))}, "len(regexp_extract_all(text, '[a-z0-9]+'))::INTEGER AS n_tokens, len(list_distinct(regexp_extract_all(text, '[a-z0-9]+')))::INTEGER AS n_distinct")
for _name, _fold in (("i", fixed.LEET_I), ("l", fixed.LEET_L), ("conservative", fixed.LEET_KEEP_468)):
    _over_documents(f"leet_fold_{_name}", lambda text, fold=_fold: {"folded": F.md5(T.fold_leet(text, fold))}, f"md5(translate(text, '{_fold[0]}', '{_fold[1]}')) AS folded")
_over_documents("strip_diacritics", lambda text: {"plain": F.md5(T.strip_marks(text))}, "md5(strip_accents(text)) AS plain")
_over_documents("collapse_repeats", lambda text: {"collapsed": F.md5(T.collapse_punctuation(T.collapse_repeats(text)))}, None)
ORACLES["collapse_repeats"] = f"WITH {full.collapsed('r', 'documents', 'doc_id', 'text')} SELECT d.doc_id, md5({full.PUNCTUATION.format('x')}) AS collapsed FROM documents d LEFT JOIN r USING (doc_id)"
_over_documents("strip_ornaments", lambda text: {"plain": F.md5(T.strip_ornaments(text))}, r"md5(regexp_replace(text, '[•¤¦§¨¬¯°´¶˜∀-⋿─-◿⦀-⧿⬀-⯿、-〿぀-ゟ゠-ヿ㐀-䶿一-鿿｜\[\]{}]', '', 'g')) AS plain")
_over_documents("strip_invisible", lambda text: {"plain": F.md5(T.strip_invisible(F.concat(text, F.lit("​x﻿"))))}, r"md5(regexp_replace(concat(text, '​x﻿'), '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}\x{AD}]', '', 'g')) AS plain")
_over_documents("squeeze_space", lambda text: {"squeezed": F.md5(T.squeeze_space(text))}, r"md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS squeezed")
_over_documents("truncate_field", lambda text: {"field": F.md5(T.as_string(text))}, "md5(left(text, 4096)) AS field")
_over_documents("tighten", lambda text: {"tight": F.md5(T.tighten(F.lower(text)))}, None)
ORACLES["tighten"] = f"WITH {full.tight('w', '(SELECT doc_id, lower(text) AS x FROM documents)', 'x')} SELECT doc_id, md5(tight) AS tight FROM w"


@query(f"WITH {DONATIONS_SQL}, texts AS (SELECT DISTINCT message AS t FROM donations WHERE message <> ''), {full.normal('r', 'texts', 't', 't')} SELECT donation_id, coalesce(n, '') AS reading FROM donations LEFT JOIN r ON message = t")
def normalize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return donations(spark, sf_dir).select("donation_id", F.get(T.normalize_text(F.col("message")), F.lit(0)).alias("reading"))


@query(f"{full.FULL_TEXTS} SELECT donation_id, count(v) AS n, md5(coalesce(string_agg(v, '|' ORDER BY o), '')) AS variants FROM donations LEFT JOIN seen ON message = t GROUP BY donation_id")
def message_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants in order: readings, leet folds, canonical texts, tight and plain forms, closed gaps."""
    read = donations(spark, sf_dir).select("donation_id", T.normalize_text(F.col("message")).alias("bases"))
    made = read.select("donation_id", prepared(F.col("bases"), typo.EVERYDAY, True).alias("v"))
    return made.select("donation_id", F.size("v").cast("long").alias("n"), F.md5(F.array_join("v", "|")).alias("variants"))


@query(full.documents_read())
def normalize_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of whole documents; made once, in a projection of their own."""
    made = documents(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("v"))
    return made.select("doc_id", F.md5(F.get("v", F.lit(0))).alias("first"), F.size("v").alias("n"))




@query(f"WITH {DONATIONS_SQL} SELECT donation_id, coalesce(array_to_string(list_transform(range(1, length(message) + 1), lambda i: CASE WHEN message[i] IN ('@','$','!','|') THEN translate(message[i], '@$!|', 'asii') WHEN message[i] IN ('0','1','3','4','5','6','7','8') AND i > 1 AND i < length(message) AND regexp_matches(message[i-1], '[a-zA-Z]') AND regexp_matches(message[i+1], '[a-zA-Z]') THEN translate(message[i], '01345678', 'oieasgtb') ELSE message[i] END), ''), '') AS smart FROM donations")
def leet_fold_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return donations(spark, sf_dir).select("donation_id", T.fold_leet_smart(F.coalesce("message", F.lit(""))).alias("smart"))


_gap = r"'\b([a-z]{2,8})\s+(\d{2,4})\b'"


@query(f"WITH {DONATIONS_SQL}, g AS (SELECT donation_id, coalesce(message, '') AS m, regexp_extract(coalesce(message, ''), {_gap}, 1) AS a, regexp_extract(coalesce(message, ''), {_gap}, 2) AS b FROM donations) SELECT donation_id, CASE WHEN a <> '' AND (a || b IN ({', '.join(repr(x) for x in fixed.BRANDS)}) OR (a IN ({', '.join(repr(x) for x in fixed.STEMS)}) AND NOT regexp_matches(b, '^[1-9]0+$'))) THEN regexp_replace(m, {_gap}, a || b) ELSE m END AS closed FROM g")
def gap_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return donations(spark, sf_dir).select("donation_id", T.close_gaps(F.coalesce("message", F.lit(""))).alias("closed"))


@query(f"WITH {DONATIONS_SQL} SELECT donation_id, platform, coalesce(donator, '') AS donator, coalesce(message, '') AS message, amount, '' AS currency FROM donations")
def coerce_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON body; the currency comes as a number, which is no string."""
    body = F.to_json(F.struct("platform", "donator", "message", "amount", F.lit(5).alias("currency")))
    fields = request_fields(F.col("body"))
    return donations(spark, sf_dir).select("donation_id", body.alias("body")).select("donation_id", *[fields[n].alias(n) for n in ("platform", "donator", "message", "amount", "currency")])


# ---- rules, phrases, brands ----


def _rule_query(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sent = donations(spark, sf_dir).select("donation_id", plain(F.col("message")).alias("v"))
        return sent.select("donation_id", F.explode(evidence.evidence(F.col("v"), True)[kind]).alias("h")).select("donation_id", "h.id", "h.value", "h.weight")

    QUERIES[f"rule_hits_{kind}"] = run
    ORACLES[f"rule_hits_{kind}"] = f"{O.MESSAGE_TEXTS}, {O.HITS_SQL} SELECT donation_id, id, value, weight::INTEGER AS weight FROM donations JOIN hits ON lower(message) = t WHERE kind = '{kind}'"


for _kind in O.KINDS:
    _rule_query(_kind)


@query(f"{O.MESSAGE_TEXTS}, {O.HITS_SQL} SELECT id, count(*) AS hits, sum(weight)::BIGINT AS weight FROM donations JOIN hits ON lower(message) = t GROUP BY id")
def rule_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct message is matched once and counts as often as it was sent."""
    every = tuple(r for rules in O.KINDS.values() for r in rules)
    sent = donations(spark, sf_dir).groupBy("message").agg(F.count("*").alias("sent"))
    hits = sent.select("sent", F.explode(matching.rule_hits(plain(F.col("message")), every)).alias("h"))
    return hits.groupBy("h.id").agg(F.sum("sent").alias("hits"), F.sum(F.col("sent") * F.col("h.weight")).alias("weight"))


_opening = r"'\b' || regexp_replace(regexp_extract(text, '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+'), ' ', '\\s+', 'g') || '\b'"


@query(f"WITH rules AS (SELECT item_id, {_opening} AS pattern FROM benchmark WHERE regexp_matches(text, '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+')) SELECT doc_id, item_id::VARCHAR AS id, length(pattern)::INTEGER AS weight FROM documents, rules WHERE regexp_matches(text, '(?i)' || pattern)")
def rules_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words of every benchmark text as rules over whole documents."""
    words = F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+ [A-Za-z]+", 0)
    rules = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), words.alias("w")).where("w <> ''")
    pattern = F.concat(F.lit(r"\b"), F.replace("w", F.lit(" "), F.lit(r"\s+")), F.lit(r"\b"))
    return evidence.rules_by_text(documents(spark, sf_dir), rules.select("id", pattern.alias("pattern"), F.length(pattern).alias("weight")), "doc_id")


@query(f"{O.MESSAGE_TEXTS}, {O.PHRASES_SQL} SELECT donation_id, kind, phrase FROM donations JOIN said ON lower(message) = t")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists by one pass over each text."""
    said = donations(spark, sf_dir).select("donation_id", evidence.phrase_lists(plain(F.col("message"))).alias("s"))
    named = {kind: name for kind, p in O.PHRASES.items() for name, own in evidence.PHRASES.items() if own == p}
    lists = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"s.{name}").alias("found")) for kind, name in named.items()])
    return said.select("donation_id", F.explode(lists).alias("l")).select("donation_id", "l.kind", F.explode("l.found").alias("phrase"))


@query(f"{O.MESSAGE_TEXTS}, {O.BRANDS_SQL} SELECT donation_id, brand FROM donations JOIN toks ON lower(message) = t JOIN brands ON token = brand")
def brand_token_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As an equi join of exploded tokens with the brand table."""
    terms = spark.range(1).select(F.explode(F.array(*map(F.lit, fixed.BRANDS))).alias("term"))
    texts = donations(spark, sf_dir).select("donation_id", T.all_tokens(plain(F.col("message"))).alias("tokens"))
    return matching.join_tokens(texts, terms, "donation_id").withColumnRenamed("term", "brand")


def _formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = donations(spark, sf_dir).select("donation_id", plain(F.col("message")).alias("v"))
    return rows.select("donation_id", T.all_tokens(F.col("v")).alias("tokens"), T.all_squeezed(F.col("v")).alias("squeezed"))


@query(f"{O.MESSAGE_TEXTS}, {O.BRANDS_SQL} SELECT donation_id, brand FROM donations JOIN named ON lower(message) = t")
def brand_substring_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.brands_by_text(_formed(spark, sf_dir), "donation_id")


@query(f"{O.MESSAGE_TEXTS}, {O.BRANDS_SQL} SELECT donation_id, brand FROM donations JOIN near_named ON lower(message) = t")
def near_brand_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.brands_by_text(_formed(spark, sf_dir), "donation_id", near=True)


@query(f"{O.MESSAGE_TEXTS}, {O.BRANDS_SQL} SELECT donation_id, (SELECT count(*) FROM named n WHERE n.t = lower(message)) AS exact, (SELECT count(*) FROM near_named n WHERE n.t = lower(message)) AS near FROM donations")
def brand_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many brands a text names and nearly names, both at once."""
    found = _formed(spark, sf_dir).select("donation_id", evidence.brand_lists(F.col("tokens"), F.col("squeezed")).alias("b"))
    return found.select("donation_id", F.size("b.high").cast("long").alias("exact"), F.size("b.near").cast("long").alias("near"))


# ---- typos ----

_tokens_sql = f"{O.MESSAGE_TEXTS}, tokens AS (SELECT DISTINCT unnest(regexp_extract_all(t, '[a-z]{{4,}}')) AS token FROM texts)"


def _message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("message"), F.lit("[a-z]{4,}"), F.lit(0))
    return donations(spark, sf_dir).select(F.explode(found).alias("token")).distinct()


def _words(spark: SparkSession, words: tuple[str, ...]) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, words))).alias("ord", "word"))


def _near_sql(first: bool) -> str:
    """CTE near of the CTEs tokens(token) and words(ord, word)."""
    most = "CASE WHEN length(token) < 5 THEN 0 WHEN length(token) < 7 THEN 1 ELSE 2 END"
    lcp = "len(list_filter(range(1, least(length(token), length(word)) + 1), lambda i: left(token, i) = left(word, i)))"
    pairs = "tokens JOIN words ON left(token, 1) = left(word, 1)" if first else "tokens, words"
    return f"""near AS (SELECT token, word AS match, levenshtein(token, word)::INTEGER AS distance, row_number() OVER (PARTITION BY token ORDER BY levenshtein(token, word), {lcp} DESC, length(word) DESC, ord) AS n
  FROM {pairs} WHERE {most} > 0 AND abs(length(token) - length(word)) <= {most} AND levenshtein(token, word) <= {most})"""


def _best_sql(words: tuple[str, ...], first: bool) -> str:
    return f"words(ord, word) AS (VALUES {O.values(list(enumerate(words)))}), {_near_sql(first)}"


@query(f"{_tokens_sql}, {_best_sql(tuple(fixed.SENSITIVE), False)} SELECT token, match, distance FROM near WHERE n = 1")
def fuzzy_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typo.fuzzy_join(_message_tokens(spark, sf_dir), _words(spark, tuple(fixed.SENSITIVE)), False)


@query(f"{_tokens_sql}, {_best_sql(typo.EVERYDAY, True)} SELECT token, match, distance FROM near WHERE n = 1")
def fuzzy_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typo.fuzzy_join(_message_tokens(spark, sf_dir), _words(spark, typo.EVERYDAY), True)


_near_two = _best_sql(tuple(fixed.SENSITIVE), False).replace("words(", "terms(").replace("near AS", "near_term AS").replace("tokens, words", "tokens, terms") + ", " + _best_sql(typo.EVERYDAY, True)


@query(f"""{_tokens_sql}, {_near_two} SELECT tokens.token, CASE WHEN tokens.token IN (SELECT word FROM terms) THEN 'sensitive-exact' WHEN tokens.token IN (SELECT word FROM words) THEN 'exact' WHEN s.match IS NOT NULL THEN 'sensitive-fuzzy' WHEN d.match IS NOT NULL THEN 'fuzzy' ELSE 'unknown' END AS kind
  FROM tokens LEFT JOIN near_term s ON s.token = tokens.token AND s.n = 1 LEFT JOIN near d ON d.token = tokens.token AND d.n = 1""")
def typo_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typo.match_tokens(_message_tokens(spark, sf_dir), "token").select("token", "kind")


_raw = "tokens AS (SELECT donation_id, unnest(list_filter(regexp_split_to_array(coalesce(message, ''), '\\s+'), lambda x: x <> '')) AS raw FROM donations)"
_kinds_sql = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k.replace('-', '_')}" for k in typo.KINDS)


@query(f"WITH {DONATIONS_SQL}, {_raw}, {full.ladder('tokens')} SELECT d.donation_id, count(t.raw) AS tokens, {_kinds_sql} FROM donations d LEFT JOIN tokens t USING (donation_id) LEFT JOIN laddered l ON l.raw = t.raw GROUP BY d.donation_id")
def typo_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typo.score_texts(donations(spark, sf_dir), "donation_id", "message")


@query(f"WITH {DONATIONS_SQL}, texts AS (SELECT DISTINCT lower(coalesce(message, '')) AS t FROM donations), {full.canonical('c', 'texts', 't', 't')} SELECT donation_id, coalesce(canonical, '') AS canonical FROM donations LEFT JOIN c ON lower(coalesce(message, '')) = c.t")
def canonicalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return donations(spark, sf_dir).select("donation_id", F.get(typo.canonical_texts(F.array(F.lower(F.coalesce("message", F.lit(""))))), F.lit(0)).alias("canonical"))


@query(r"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE regexp_full_match(lower(w), '[a-z]+')")
def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words as the lines of a dictionary."""
    return typo.dictionary_words(documents(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("line")), "line")


_counted_sql = r"counted AS (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY 1)"
#: Words of documents that occur so often are a dictionary; rarer ones are looked up in it.
_USUAL = 12


@query(f"WITH {_counted_sql}, tokens AS (SELECT word AS token FROM counted WHERE n < {_USUAL}), words AS (SELECT word AS ord, word FROM counted WHERE n >= {_USUAL}), {_near_sql(True)} SELECT token, match, distance FROM near WHERE n = 1")
def fuzzy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare words of documents and the nearest usual word: a dictionary that grows with the table."""
    counted = typo.word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    usual = counted.where(F.col("count") >= _USUAL).select("word", F.col("word").alias("ord"))
    return typo.fuzzy_join(counted.where(F.col("count") < _USUAL).select(F.col("word").alias("token")), usual, True)


_raw_tokens = "SELECT DISTINCT raw FROM (SELECT unnest(list_filter(regexp_split_to_array(coalesce(message, ''), '\\s+'), lambda x: x <> '')) AS raw FROM donations)"


@query(f"WITH {DONATIONS_SQL}, {full.ladder(f'({_raw_tokens})')} SELECT raw AS token, kind, match FROM laddered")
def ladder_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typo ladder with its dictionary as a table."""
    found = F.filter(F.split(F.coalesce("message", F.lit("")), T.SPACE + "+"), lambda t: t != "")
    tokens = donations(spark, sf_dir).select(F.explode(found).alias("token"))
    return typo.ladder_join(tokens, _words(spark, typo.EVERYDAY)).select("token", "kind", "match")


# ---- decisions ----


def _decided(spark: SparkSession, sf_dir: str, gambling: Column | None = None) -> DataFrame:
    return decide(donations(spark, sf_dir), plain(F.col("donator")), plain(F.col("message")), gambling)


_stub = "CASE WHEN contains(coalesce(message, ''), 'gacor') THEN 0.92 ELSE 0.05 END"


@query(f"{O.decided_sql()} SELECT donation_id, score, action, stage FROM decided")
def decide_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("donation_id", "score", "action", "stage")


@query(f"{O.decided_sql()} SELECT action, stage, count(*) AS n, sum(score)::BIGINT AS score FROM decided GROUP BY action, stage")
def decide_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).groupBy("action", "stage").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query(f"{O.decided_sql()} SELECT donation_id, reason FROM decided")
def decide_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("donation_id", "reason")


@query(f"{O.decided_sql(_stub)} SELECT donation_id, score, action, stage, reason FROM decided")
def decide_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, scoring.stub_score(F.col("message"))).select("donation_id", "score", "action", "stage", "reason")


@query(f"WITH {DONATIONS_SQL}, s AS (SELECT donation_id, {_stub}::DOUBLE AS g FROM donations) SELECT donation_id, CASE WHEN g > 0.5 THEN 'block' ELSE 'allow' END AS action, 'classifier' AS stage, 'score=' || printf('%.4f', g) AS reason FROM s")
def decide_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scoring.stub_score(F.col("message"))
    return donations(spark, sf_dir).select("donation_id", scoring.label_verdict((g > 0.5).cast("int"), g).alias("v")).select("donation_id", "v.*")


@query(f"WITH {DONATIONS_SQL}, s AS (SELECT {_stub} > 0.5 AS hit, platform FROM donations) SELECT platform, count(*) AS total, count(*) FILTER (hit) AS label_1 FROM s GROUP BY platform")
def batch_label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (scoring.stub_score(F.col("message")) > 0.5)
    return donations(spark, sf_dir).groupBy("platform").agg(F.count("*").alias("total"), F.count_if(label).alias("label_1"))


@query("WITH e AS (SELECT vec_id, i // 2 AS pair, embedding[i]::DOUBLE AS a, embedding[i + 1]::DOUBLE AS b FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding), 2)) AS i FROM embeddings)) SELECT vec_id, pair, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 9) AS gambling, (b > a)::INTEGER AS label FROM e")
def softmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring components of every vector as logits."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("_e", F.transform("embedding", lambda x: x.cast("double")))
    starts = F.sequence(F.lit(0).cast("long"), F.floor(F.size("_e") / 2) - 1)
    pairs = vectors.select("vec_id", F.explode(F.transform(starts, lambda i: F.struct(i.alias("pair"), F.get("_e", (2 * i).cast("int")).alias("a"), F.get("_e", (2 * i + 1).cast("int")).alias("b")))).alias("p"))
    return pairs.select("vec_id", "p.pair", F.round(scoring.softmax(F.col("p.a"), F.col("p.b")), 9).alias("gambling"), scoring.label_of(F.col("p.a"), F.col("p.b")).alias("label"))


@query(f"WITH {DONATIONS_SQL} SELECT donation_id, trim(regexp_replace(regexp_replace(lower(trim(concat_ws(' ', nullif(donator, ''), nullif(message, '')))), '[|/\\\\\\[\\]{{}}<>*_~`]+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM donations")
def classifier_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = F.array(F.lower(T.js_trim(F.concat_ws(" ", F.nullif("donator", F.lit("")), F.nullif("message", F.lit(""))))))
    return donations(spark, sf_dir).select("donation_id", scoring.classifier_text(F.col("donator"), F.col("message"), readings).alias("text"))


@query(f"{full.FULL_SQL} SELECT donation_id, score, action, stage, reason FROM decided")
def decide_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan with normalisation, folds and typo matching."""
    return moderate(donations(spark, sf_dir)).select("donation_id", "score", "action", "stage", "reason")


_distinct_sql = DONATIONS_SQL.replace(dealt_sql(MESSAGES, "event_id"), f"coalesce({dealt_sql(MESSAGES, 'event_id')}, '') || ' kata ' || translate(event_id::VARCHAR, '0123456789', 'abcdefghij')")


@query(f"{O.decided_sql(texts=full.full_texts(_distinct_sql), key='d.{}')} SELECT action, stage, count(*) AS n, sum(score)::BIGINT AS score FROM decided GROUP BY action, stage")
def decide_full_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan over texts of which no two are the same."""
    number = F.translate(F.col("donation_id").cast("string"), "0123456789", "abcdefghij")
    rows = donations(spark, sf_dir).withColumn("message", F.concat(F.coalesce("message", F.lit("")), F.lit(" kata "), number))
    return moderate(rows).groupBy("action", "stage").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


# ---- responses, audit, feedback ----

_marker_sql = "CASE WHEN action = 'block' THEN '[block:' || stage || ' score=' || score || ']' WHEN score >= 3 THEN '[allow:near score=' || score || ']' ELSE '[allow]' END"


_response_sql = """CASE WHEN action = 'block' THEN '{"action":"block","replaceDonator":"***","replaceMessage":"***"}' ELSE '{"action":"allow"}' END"""


@query(f"{full.FULL_BOTH_SQL} SELECT donation_id, score, action, stage, reason, {_response_sql} AS response, CASE WHEN reason = 'empty input' THEN '[allow]' ELSE {_marker_sql} END AS marker FROM decided")
def decide_full_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check(donations(spark, sf_dir), method="both").select("donation_id", "score", "action", "stage", "reason", "response", "marker")


@query(f"""{O.decided_sql()} SELECT donation_id, CASE WHEN action = 'block' THEN '{{"action":"block","replaceDonator":"***","replaceMessage":"***"}}' ELSE '{{"action":"allow"}}' END AS response FROM decided""")
def verdict_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("donation_id", audit.verdict_response(F.col("action"), "***", "***").alias("response"))


@query(f"{O.decided_sql()} SELECT donation_id, CASE WHEN reason = 'empty input' THEN '[allow]' ELSE {_marker_sql} END AS marker, action || ':' || stage AS summary FROM decided")
def audit_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _decided(spark, sf_dir)
    return made.select("donation_id", audit.marker(F.col("action"), F.col("stage"), F.col("reason")).alias("marker"), audit.summary(F.col("action"), F.col("stage")).alias("summary"))


_reasons = ("score=7; brands=hoki88, eth77; strong=rtp", "score=2.50; allowContext=donasi masjid", "strong=link daftar; suspicious=x", "score=-1", "note brands=late", " score=4;brands= wide ; allowContext=a", None)
_stages, _actions = ("brand", "hard", "allow-context"), ("block", "allow", "review", None)
_field = "coalesce(trim(regexp_extract(coalesce(reason, ''), '(?:^|;\\s*){}=([^;]+)', 1)), '')"
_fields_sql = f"""r AS (SELECT donation_id, {dealt_sql(_reasons, 'donation_id')} AS reason, {dealt_sql(_stages, 'donation_id')} AS stage, {dealt_sql(_actions, 'donation_id')} AS action FROM donations),
p AS (SELECT *, {_field.format('brands')} AS brands, {_field.format('strong')} AS strong, {_field.format('suspicious')} AS suspicious, {_field.format('allowContext')} AS context, try_cast(nullif(regexp_extract(coalesce(reason, ''), 'score=(-?[0-9]+(?:[.][0-9]+)?)', 1), '') AS DOUBLE) AS score FROM r),
q AS (SELECT *, CASE WHEN score IS NULL THEN '?' WHEN score = floor(score) THEN score::BIGINT::VARCHAR ELSE regexp_replace(printf('%.2f', score), '[.]?0+$', '') END AS shown, CASE WHEN brands <> '' THEN 'brands=' || brands WHEN strong <> '' THEN 'strong=' || strong WHEN suspicious <> '' THEN 'suspicious=' || suspicious ELSE '' END AS tail FROM p)"""


@query(f"""WITH {DONATIONS_SQL}, {_fields_sql} SELECT donation_id, brands, strong, context, CASE WHEN action IS NULL THEN '[allow]' WHEN action = 'block' AND stage = 'brand' THEN '[block:brand ' || brands || ']' WHEN action = 'block' THEN '[block:' || stage || ' score=' || shown || CASE WHEN tail <> '' THEN ' ' || tail ELSE '' END || ']'
  WHEN coalesce(score >= 3, false) THEN '[allow:near score=' || shown || CASE WHEN context <> '' THEN ' ctx=' || context ELSE '' END || ']' WHEN stage = 'allow-context' AND context <> '' THEN '[allow:ctx ' || context || ']' ELSE '[allow]' END AS marker FROM q""")
def reason_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons taken apart, and the markers of every kind of decision."""
    key = F.col("donation_id")
    rows = donations(spark, sf_dir).select("donation_id", dealt(_reasons, key).alias("reason"), dealt(_stages, key).alias("stage"), dealt(_actions, key).alias("action"))
    fields = [T.parse_field(F.col("reason"), n).alias(a) for n, a in (("brands", "brands"), ("strong", "strong"), ("allowContext", "context"))]
    return rows.select("donation_id", *fields, audit.marker(F.col("action"), F.col("stage"), F.col("reason")).alias("marker"))


@query(f"WITH {DONATIONS_SQL} SELECT donation_id, '[' || strftime(ts, '%H:%M:%S') || '] [killed] ' || trim(coalesce(donator, '')) || ': ' || trim(coalesce(message, '')) AS line FROM donations")
def audit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = audit.marker(F.lit("allow"), F.lit("x"), F.lit(""), F.lit(True))
    return donations(spark, sf_dir).select("donation_id", audit.audit_line(F.col("ts"), tag, F.col("donator"), F.col("message")).alias("line"))


@query(f"{O.decided_sql()} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS lines, count(*) FILTER (action = 'block') AS blocked FROM decided WHERE platform <> 'validate' GROUP BY day")
def daily_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _decided(spark, sf_dir).where(F.col("platform") != audit.VALIDATE)
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("lines"), F.count_if(F.col("action") == "block").alias("blocked"))


_decisions, _verdicts = ("block", "allow", "maybe"), ("correct", "false-positive", None, "wrong")
_feedback_sql = f"""WITH {DONATIONS_SQL}, f AS (SELECT donation_id, ts, coalesce(donator, '') AS donator, coalesce(message, '') AS message, {dealt_sql(_decisions, 'donation_id')} AS decision, {dealt_sql(_verdicts, 'donation_id')} AS verdict FROM donations),
v AS (SELECT *, CASE WHEN NOT coalesce(decision IN ('block', 'allow') AND verdict IN ('correct', 'false-positive'), false) THEN 'Invalid decision or verdict' WHEN message = '' THEN 'Message is required' END AS error FROM f)"""


@query(f"{_feedback_sql} SELECT donation_id, error, CASE WHEN error IS NULL THEN '[' || strftime(ts, '%H:%M:%S') || '] [' || decision || '] [' || verdict || '] ' || trim(donator) || ' :: ' || trim(message) END AS line FROM v")
def feedback_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.plans.moderate import feedback

    rows = donations(spark, sf_dir).withColumns({"decision": dealt(_decisions, F.col("donation_id")), "verdict": dealt(_verdicts, F.col("donation_id"))})
    return feedback(rows).select("donation_id", "error", "line")


# ---- frames ----


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the platforms' shapes, one donation each, with an unknown field."""
    donor, message, amount = F.coalesce("donator", F.lit("")), F.coalesce("message", F.lit("")), F.floor(F.abs("amount"))
    saweria = F.to_json(F.struct(F.lit("donation").alias("type"), F.array(F.struct(donor.alias("donator"), message.alias("message"), amount.alias("amount"), F.lit("IDR").alias("currency"), F.lit("x").alias("tts"), F.lit(7).alias("extra"))).alias("data")))
    bagibagi = F.concat(F.to_json(F.struct(F.lit(1).alias("type"), F.lit("Donation").alias("target"), F.array(F.struct(F.lit("").alias("preferedName"), donor.alias("username"), message.alias("message"), amount.alias("amount"))).alias("arguments"))), F.lit(payloads.RECORD_END))
    inner = F.to_json(F.struct(donor.alias("fullname"), message.alias("note"), F.concat(amount.cast("string"), F.lit(" rupiah")).alias("amount"), F.lit("tts").alias("tts")))
    sociabuzz = F.to_json(F.struct(F.lit(15).alias("action"), F.array(F.struct(inner.alias("data"))).alias("messages")))
    tako = F.to_json(F.struct(F.struct(F.struct(donor.alias("name"), F.lit(1).alias("id")).alias("sender"), message.alias("message"), amount.alias("amount"), F.lit("IDR").alias("currency")).alias("result")))
    raw = F.when(F.col("platform") == "saweria", saweria).when(F.col("platform") == "bagibagi", bagibagi).when(F.col("platform") == "sociabuzz", sociabuzz).otherwise(tako)
    return donations(spark, sf_dir).select("donation_id", "platform", "donator", "message", raw.alias("raw"))


def _parse_query(platform: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _frames(spark, sf_dir).where(F.col("platform") == platform)
        return own.select("donation_id", F.explode(payloads.PARSERS[platform](F.col("raw"))).alias("d")).select("donation_id", "d.*")

    QUERIES[f"parse_{platform}"] = run
    needs = " AND coalesce(message, '') <> ''" if platform == "tako" else ""
    ORACLES[f"parse_{platform}"] = f"WITH {DONATIONS_SQL} SELECT donation_id, coalesce(donator, '') AS donator, coalesce(message, '') AS message, floor(abs(amount))::DOUBLE AS amount, 'IDR' AS currency FROM donations WHERE platform = '{platform}'{needs}"


for _platform in payloads.PARSERS:
    _parse_query(_platform)


@query(f"""WITH {DONATIONS_SQL} SELECT donation_id, CASE WHEN platform = 'tako' AND coalesce(message, '') = '' THEN NULL ELSE 'D' END AS donator, CASE WHEN platform = 'tako' AND coalesce(message, '') = '' THEN NULL ELSE 'M' END AS message, platform, NULL AS voice, platform = 'bagibagi' AS ends, CASE platform WHEN 'saweria' THEN '7' END AS extra FROM donations
  WHERE NOT (platform = 'tako' AND coalesce(message, '') = '')""")
def rewrite_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame rewritten and parsed again."""
    own = _frames(spark, sf_dir).where(~((F.col("platform") == "tako") & (F.coalesce("message", F.lit("")) == "")))
    changed = own.select("donation_id", "platform", payloads.rewrite_frames(F.col("platform"), F.col("raw"), F.lit("D"), F.lit("M")).alias("raw"))
    again = changed.select("donation_id", "platform", "raw", F.explode(payloads.parse_frame(F.col("platform"), F.col("raw"))).alias("d"))
    inner = F.get_json_object("raw", "$.messages[0].data")
    voice = F.coalesce(F.get_json_object("raw", "$.data[0].tts"), F.get_json_object("raw", "$.arguments[0].audioData"), F.get_json_object(inner, "$.tts"), F.get_json_object(inner, "$.voice_note"))
    return again.select("donation_id", "d.donator", "d.message", "platform", voice.alias("voice"), F.col("raw").endswith(payloads.RECORD_END).alias("ends"), F.get_json_object("raw", "$.data[0].extra").alias("extra"))


_turns = "SELECT conv_id, turn, text, lower(text) LIKE '%the%' AS bad FROM conversations"


@query(f"WITH t AS ({_turns}) SELECT conv_id, bool_or(bad) AS blocked, count(*) AS donations, coalesce(min(turn) FILTER (bad), max(turn)) AS last_checked FROM t GROUP BY conv_id")
def frame_any_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a frame: the first blocked turn ends the checks."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    frames = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("items"))
    each = frames.select(F.struct("conv_id", "items").alias("frame"), F.posexplode("items").alias("pos", "item"))
    each = each.select(F.when(F.col("pos") == 0, F.col("frame")).alias("frame"), F.contains(F.lower("item.text"), F.lit("the")).alias("flag"))
    found = payloads.first_flagged(each).select("frame.*", "first")
    last = F.coalesce("first", F.size("items") - 1)
    return found.select("conv_id", F.col("first").isNotNull().alias("blocked"), F.size("items").cast("long").alias("donations"), F.get("items", last)["turn"].alias("last_checked"))


_empty_tako = "(platform = 'tako' AND coalesce(message, '') = '')"


@query(f"""{full.FULL_SQL} SELECT donation_id, platform, CASE WHEN action = 'block' AND NOT {_empty_tako} THEN 0 END::INTEGER AS first_block, CASE WHEN {_empty_tako} THEN 0 ELSE 1 END::INTEGER AS checked,
  CASE WHEN {_empty_tako} THEN NULL WHEN action = 'block' THEN '***' ELSE coalesce(donator, '') END AS donator, CASE WHEN {_empty_tako} THEN NULL WHEN action = 'block' THEN '***' ELSE coalesce(message, '') END AS message FROM decided""")
def check_frames_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames decided, and what is delivered parsed again."""
    made = check_frames(_frames(spark, sf_dir).select("donation_id", "platform", "raw"))
    again = made.withColumn("d", F.get(payloads.parse_frame(F.col("platform"), F.col("delivered")), F.lit(0)))
    return again.select("donation_id", "platform", "first_block", "checked", "d.donator", "d.message")


@query(f"WITH {DONATIONS_SQL} SELECT donation_id, NULL::INTEGER AS first_block, 0 AS checked, true AS same FROM donations")
def check_frames_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames cut short, or of platforms nobody knows, go on as they are."""
    broken = _frames(spark, sf_dir).withColumn("raw", F.when(F.col("donation_id") % 2 == 0, F.expr("left(raw, length(raw) - 4)")).otherwise(F.col("raw")))
    broken = broken.withColumn("platform", F.when(F.col("donation_id") % 2 == 0, F.col("platform")).otherwise("nimo"))
    made = check_frames(broken.select("donation_id", "platform", "raw"))
    return made.select("donation_id", "first_block", "checked", (F.col("delivered") == F.col("raw")).alias("same"))


_turn_key = "(conv_id * 7 + turn)"
_turns_sql = f"""donations AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, conv_id * 1000 + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS donation_id, NULL::TIMESTAMP AS ts, 'saweria' AS platform, role AS donator, {dealt_sql(MESSAGES, _turn_key)} AS message, 0.0 AS amount, 'IDR' AS currency, 0 AS user_id, '' AS event_type FROM conversations)"""


@query(f"""{O.decided_sql(texts=full.full_texts(_turns_sql), key="d.{}")}, f AS (SELECT d.conv_id, min(pos) FILTER (action = 'block') AS first_block, count(*) AS donations FROM decided JOIN donations d USING (donation_id) GROUP BY d.conv_id)
  SELECT conv_id, donations, first_block::INTEGER AS first_block, coalesce(first_block + 1, donations)::INTEGER AS checked, CASE WHEN first_block IS NULL THEN 0 ELSE donations END AS replaced FROM f""")
def check_frames_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of many donations, one per conversation: the first blocked one ends the checks, and all are replaced."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("message", F.coalesce(dealt(MESSAGES, F.expr(_turn_key)), F.lit("")))
    item = F.struct(F.col("role").alias("donator"), "message", F.lit(1).alias("amount"), F.lit("IDR").alias("currency"))
    sorted_items = F.array_sort(F.collect_list(F.struct("turn", "role", "text", item.alias("item"))))
    frames = turns.groupBy("conv_id").agg(F.transform(sorted_items, lambda x: x["item"]).alias("data"))
    frames = frames.select("conv_id", F.lit("saweria").alias("platform"), F.to_json(F.struct(F.lit("donation").alias("type"), "data")).alias("raw"))
    made = check_frames(frames).withColumn("again", payloads.parse_frame(F.col("platform"), F.col("delivered")))
    replaced = F.size(F.filter("again", lambda d: (d["donator"] == "***") & (d["message"] == "***")))
    return made.select("conv_id", F.size("donations").cast("long").alias("donations"), "first_block", "checked", replaced.cast("long").alias("replaced"))


@query(f"WITH {DONATIONS_SQL}, s AS (SELECT donation_id, ts, {_stub} > 0.5 AS bad, nullif(message, '') AS text FROM donations) SELECT donation_id, text IS NOT NULL AS status, CASE WHEN text IS NOT NULL THEN bad::INTEGER END AS data, CASE WHEN text IS NOT NULL THEN 'Success' ELSE 'text must have at least 1 character' END AS message, CASE WHEN text IS NULL THEN 'text' END AS errors, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM s")
def response_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = scoring.invalid_texts(F.col("message"))
    data = F.when(wrong.isNull(), (scoring.stub_score(F.col("message")) > 0.5).cast("int"))
    made = audit.envelope(wrong.isNull(), data, wrong, F.when(wrong.isNotNull(), F.lit("text")), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return donations(spark, sf_dir).select("donation_id", made.alias("e")).select("donation_id", "e.status", "e.data", "e.message", "e.errors", F.col("e.timestamp").alias("at"))


@query(f"WITH {DONATIONS_SQL} SELECT donation_id, unnest(range(1, (donation_id % 4)::INTEGER + 1))::INTEGER AS listener FROM donations WHERE donation_id % 4 > 0")
def listener_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.per_listener(donations(spark, sf_dir).select("donation_id"), F.col("donation_id") % 4)


@query(f"WITH {DONATIONS_SQL} SELECT donation_id, event_type = 'click' AS signal FROM donations")
def tako_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "click", F.lit('{"event":"messages"}\x1e')).when(F.col("event_type") == "view", F.lit("no json")).otherwise(F.lit('{"event":"ping"}'))
    return donations(spark, sf_dir).select("donation_id", payloads.tako_signal(raw).alias("signal"))


# ---- platforms, URLs, HTML ----

_names = ("saweria", "tako", "bagibagi", "sociabuzz", "nimo", "", None)
_registry_sql = O.values([(p["platform"], p["name"], p["asset_origin"], p["backend_origin"], p["backend_path_prefix"]) for p in fixed.PLATFORMS])
_known_sql = f"registry(platform, name, asset_origin, backend_origin, prefix) AS (VALUES {_registry_sql})"


@query(f"""WITH {_known_sql}, p AS (SELECT page_id, {dealt_sql(_names, 'page_id')} AS wanted FROM pages) SELECT page_id, wanted, name, asset_origin, CASE WHEN coalesce(wanted, '') = '' THEN 'Missing platform' WHEN name IS NULL THEN 'Unknown platform "' || wanted || '". Available: saweria, tako, bagibagi, sociabuzz' END AS platform_error FROM p LEFT JOIN registry ON wanted = platform""")
def platform_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = pages(spark, sf_dir).select("page_id", dealt(_names, F.col("page_id")).alias("wanted"))
    return web.with_platform(wanted, "wanted").select("page_id", "wanted", "name", "asset_origin", "platform_error")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


_cookies = ("moderation_platform=tako; a=b", "x=y", None, "moderation_platform=nobody")
_referers = ("http://h/overlay?platform=bagibagi&streamKey=1", "http://h/x", None)


@query(f"""WITH p AS (SELECT page_id, {dealt_sql(_cookies, 'page_id')} AS c, {dealt_sql(_referers, 'page_id')} AS r FROM pages), w AS (SELECT page_id, coalesce(nullif(regexp_extract(c, 'moderation_platform=(\\w+)', 1), ''), nullif(regexp_extract(r, '[?&]platform=([^&#]*)', 1), ''), 'saweria') AS x FROM p)
  SELECT page_id, CASE WHEN x IN ('saweria', 'tako', 'bagibagi', 'sociabuzz') THEN x ELSE 'saweria' END AS platform FROM w""")
def platform_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", web.resolve_platform(dealt(_cookies, F.col("page_id")), dealt(_referers, F.col("page_id"))).alias("platform"))


_kinds = ("alert", "mediashare", None)


@query(f"""WITH p AS (SELECT page_id, {dealt_sql(_names, 'page_id')} AS p, coalesce({dealt_sql(_kinds, 'page_id')}, 'alert') AS k FROM pages) SELECT page_id, CASE p WHEN 'saweria' THEN 'https://saweria.co/widgets/' || k || '?streamKey=k' || page_id WHEN 'tako' THEN 'https://tako.id/overlay/' || k || '?overlay_key=k' || page_id WHEN 'bagibagi' THEN 'https://bagibagi.co/alertbox/k' || page_id
  WHEN 'sociabuzz' THEN 'https://sociabuzz.com' || CASE WHEN k = 'mediashare' THEN '/pro/tribe/mediashare/v2/k' ELSE '/pro/tribe/alert1/v3/k' END || page_id || '?v=1' END AS url FROM p""")
def overlay_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("k"), F.col("page_id").cast("string"))
    return pages(spark, sf_dir).select("page_id", web.overlay_url(dealt(_names, F.col("page_id")), key, dealt(_kinds, F.col("page_id")), F.lit("v=1")).alias("url"))


_paths = ("/widgets/alert?streamKey=@", "/widgets/mediashare", "/overlay/alert?overlay_key=@", "/alertbox/@", "/pro/tribe/alert1/v3/@?v=1", "/pro/tribe/mediashare/v2/@", "/other", "/pro/tribe/alert1/v3/@?t=a%20b%21&platform=x&q=x+y&n&%zz=1")
_targets = ("/overlay?platform=saweria&overlayType=alert&streamKey=@", None, "/overlay?platform=tako&overlayType=alert&streamKey=@", "/overlay?platform=bagibagi&streamKey=@", "/overlay?v=1&platform=sociabuzz&overlayType=alert&streamKey=@", "/overlay?platform=sociabuzz&overlayType=mediashare&streamKey=@", None, "/overlay?t=a+b%21&q=x+y&n=&%25zz=1&platform=sociabuzz&overlayType=alert&streamKey=@")


@query(f"SELECT page_id, replace({dealt_sql(_targets, 'page_id')}, '@', 'k' || page_id) AS url, CASE WHEN page_id % {len(_paths)} = 1 THEN 'Missing streamKey' END AS error FROM pages")
def overlay_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.replace(dealt(_paths, F.col("page_id")), F.lit("@"), F.concat(F.lit("k"), F.col("page_id").cast("string")))
    return pages(spark, sf_dir).select("page_id", web.overlay_alias(path).alias("a")).select("page_id", "a.*")


_pasted = ("https://saweria.co/widgets/alert?streamKey=@&x=1", "http://tako.id/overlay/mediashare?overlay_key=@", "https://bagibagi.co/alertbox/@?x", "https://sociabuzz.com/pro/tribe/alert1/v3/@?a=b", "https://sociabuzz.com/pro/tribe/mediashare/v2/@", "https://example.com/@")
_pasted_out = ("platform=saweria&overlayType=alert&streamKey=@", "platform=tako&overlayType=mediashare&streamKey=@", "platform=bagibagi&streamKey=@", "platform=sociabuzz&overlayType=alert&streamKey=@&a=b", "platform=sociabuzz&overlayType=mediashare&streamKey=@", None)


@query(f"SELECT page_id, replace({dealt_sql(_pasted_out, 'page_id')}, '@', 'k' || page_id) AS query FROM pages")
def paste_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.replace(dealt(_pasted, F.col("page_id")), F.lit("@"), F.concat(F.lit("k"), F.col("page_id").cast("string")))
    return pages(spark, sf_dir).select("page_id", web.paste_url(url).alias("query"))


@query("SELECT page_id, 'https://tako.id/api/items' || CASE WHEN page_id % 2 = 0 THEN '?id=' || page_id ELSE '' END AS url FROM pages")
def backend_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("?streamKey=s&id="), F.col("page_id").cast("string"), F.lit("&overlayType=alert"))).otherwise("?streamKey=s&overlayType=alert")
    url = F.concat(F.lit("/backend/tako/api/items"), tail)
    return pages(spark, sf_dir).select("page_id", web.backend_target(url, F.lit("tako"), F.lit("https://tako.id/api")).alias("url"))


_calls = ("https://tako.id/api/x?y=1", "/api/z", "https://other.example/a")
_calls_out = ("http://localhost:3000/backend/tako/api/x?y=1&streamKey=@&overlayType=alert", "http://localhost:3000/backend/tako/api/z?streamKey=@&overlayType=alert", "https://other.example/a")


@query(f"SELECT page_id, replace({dealt_sql(_calls_out, 'page_id')}, '@', 'k' || page_id) AS url FROM pages")
def client_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("k"), F.col("page_id").cast("string"))
    return pages(spark, sf_dir).select("page_id", web.client_rewrite(dealt(_calls, F.col("page_id")), F.lit("tako"), F.lit("https://tako.id/api"), F.lit("/api"), key, F.lit("alert")).alias("url"))


_junk = '<script src="/cdn-cgi/x.js" a>q</script><link href="/builds/meta/1"><a href="https://tako.id/p" crossorigin="anonymous" integrity="sha"><script type="ab12-module"></script><script type="0f-text/javascript"></script>'


@query(f"""SELECT page_id, md5(replace(html || '<a href="/p"><script type="module"></script><script ></script>', 'https://tako.id/', '/')) AS html FROM pages""")
def strip_cdn_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.md5(web.strip_artefacts(F.concat("html", F.lit(_junk)), F.lit("https://tako.id"))).alias("html"))


@query("""SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN CASE WHEN contains(html, '</head>') THEN left(html, strpos(html, '</head>') - 1) || '<b>' || page_id || '</b>' || substr(html, strpos(html, '</head>')) ELSE html END
  ELSE regexp_replace(html, '(<head[^>]*>)', '\\1<b>' || page_id || '</b>') END) AS html FROM pages""")
def inject_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("<b>"), F.col("page_id").cast("string"), F.lit("</b>"))
    return pages(spark, sf_dir).select("page_id", F.md5(web.inject_head(F.col("html"), block, F.col("page_id") % 2 == 1)).alias("html"))


_files = ("/a/b.json", "/x.js?v=1", "/s.css", "/i.png", "/doc.html#t", "/none")


@query(f"SELECT page_id, {dealt_sql(('application/json', 'application/javascript', 'text/css', None, 'text/html', None), 'page_id')} AS mime FROM pages")
def mime_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", web.mime_of(dealt(_files, F.col("page_id"))).alias("mime"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'authorization=t' || page_id ELSE '' END AS headers FROM pages")
def forward_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("t"), F.col("page_id").cast("string"))).otherwise("")
    headers = F.create_map(F.lit("authorization"), value, F.lit("cookie"), F.lit("c"))
    allowed = F.array(*[F.lit(h) for h in fixed.PLATFORMS[1]["forward_headers"]])
    kept = F.transform(F.map_entries(web.forward_headers(headers, allowed)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return pages(spark, sf_dir).select("page_id", F.array_join(kept, ",").alias("headers"))


@query("SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) LIKE '%.com' AS same FROM pages")
def referer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1).endswith(".com"), F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1)).otherwise("elsewhere")
    return pages(spark, sf_dir).select("page_id", web.referer_matches(F.col("url"), host).alias("same"))


# ---- state ----

_window, _most = 6 * 3_600_000, 2


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events),
  w(user_id, event_id, t, i, until, n) AS (SELECT user_id, event_id, t, i, t + {_window}, 1 FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.t, o.i, CASE WHEN w.until <= o.t THEN o.t + {_window} ELSE w.until END, CASE WHEN w.until <= o.t THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
  SELECT user_id, event_id, n::INTEGER AS count, n > {_most} AS limited, CASE WHEN n > {_most} THEN greatest(1, ceil((until - t) / 1000.0))::INTEGER END AS retry_after FROM w""")
def rate_limit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", state.epoch_ms(F.col("ts")).alias("t"))
    return state.rate_limit(hits, "user_id", "t", "event_id", _window, _most).select("user_id", "event_id", "count", "limited", "retry_after")


@query("""WITH e AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
  SELECT event_id, user_id, s > coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS inspected FROM e WHERE event_type = 'view'""")
def signal_arm_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return state.arm_fire(events, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "view").select("event_id", "user_id", "inspected")


@query("""SELECT event_id, coalesce(last_value(CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM events""")
def kill_switch_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return state.flag_as_of(events, ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup", ["user_id"]).select("event_id", "active")


@query("""SELECT event_id, coalesce(last_value(CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM events""")
def kill_switch_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One switch for all rows, in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.flag_as_of(events, ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup").select("event_id", "active")


@query(f"""WITH RECURSIVE known AS (SELECT user_id, event_id, event_type, epoch_ms(ts) AS t, coalesce(last_value(CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM events),
  o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM known WHERE event_type = 'view'),
  w(user_id, event_id, i, until, seen) AS (SELECT user_id, event_id, i, t + {_window}, active FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN w.until <= o.t THEN o.t + {_window} ELSE w.until END, CASE WHEN w.until <= o.t THEN o.active ELSE w.seen END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
  SELECT event_id, user_id, seen AS active FROM w""")
def kill_switch_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The switch as a process sees it that looks at most every so often."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", state.epoch_ms(F.col("ts")))
    kind = F.col("event_type")
    return state.cached_flag(events, "user_id", "t", "event_id", kind == "error", kind == "signup", kind == "view", _window, ["ts", "event_id"]).select("event_id", "user_id", "active")


@query(r"""WITH found AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '[A-Za-z][^\x00-\x7f]{1,2}'), range(0, len(regexp_extract_all(text, '[A-Za-z][^\x00-\x7f]{1,2}'))))) AS z FROM documents),
  pairs AS (SELECT upper(left(z[1], 1)) AS letter, substr(z[1], 2) AS g, doc_id, z[2] AS pos FROM found),
  kept AS (SELECT g, letter, min((doc_id, pos)) AS o FROM pairs WHERE length(g) > 1 OR NOT (unicode(g) BETWEEN 9728 AND 10175 OR unicode(g) BETWEEN 127744 AND 129791 OR unicode(g) BETWEEN 127462 AND 127487 OR unicode(g) BETWEEN 65024 AND 65039) GROUP BY g, letter)
  SELECT g AS sequence, string_agg(letter, '' ORDER BY o) AS letters, CASE WHEN length(g) > 1 THEN 'ligature' WHEN count(*) > 1 THEN 'several' ELSE 'single' END AS kind FROM kept GROUP BY g""")
def homoglyph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as character sets: a letter and what follows it that is no ASCII, one or two code points."""
    found = documents(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-z][^\x00-\x7f]{1,2}"), F.lit(0))).alias("pos", "pair"))
    pairs = found.select("doc_id", "pos", F.left("pair", F.lit(1)).alias("key"), F.expr("substr(pair, 2)").alias("glyph"))
    return build_look_alikes(pairs, ["doc_id", "pos"])


#: Letters of words that are swapped for a character with two readings, and those readings.
_TWO = {"f": ("\u0166", "FT"), "t": ("\u0166", "FT"), "l": ("\u0196", "IL"), "v": ("\u01b2", "VU"), "m": ("\u026f", "WM"), "a": ("\u0414", "AD")}
_LONGER = f"CASE WHEN len(done) * len(one) > {fixed.MAX_VARIANTS} THEN list_transform(done, lambda d: d || one[1]) ELSE flatten(list_transform(done, lambda d: list_transform(one, lambda o: d || o))) END"


@query(f"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
  two(c, r) AS (VALUES {O.values([(c, r) for c, (_, r) in _TWO.items()])}), letters AS (SELECT word, list(coalesce(list_transform(range(1, length(r) + 1), lambda i: r[i]), [z[1]]) ORDER BY z[2]::INTEGER) AS l FROM (SELECT word, unnest(list_zip(string_split(word, ''), range(1, length(word) + 1))) AS z FROM words) LEFT JOIN two ON z[1] = c GROUP BY word)
  SELECT word, len(reads)::INTEGER AS n, array_to_string(reads, '|') AS reads FROM (SELECT word, list_reduce(list_prepend([''], l), lambda done, one: {_LONGER}) AS reads FROM letters)""")
def homoglyph_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings of every word of documents, with letters swapped for characters that have two."""
    words = documents(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).distinct()
    read = words.withColumn("r", T.branches(F.translate("word", "".join(_TWO), "".join(c for c, _ in _TWO.values()))))
    return read.select("word", F.size("r").alias("n"), F.array_join("r", "|").alias("reads"))


#: Alphabets of look-alikes, A to Z: stated letters of other scripts, then styles by their first code point.
_FIRST = {pair[1]: pair[0] for table in (fixed.READ_LATIN, fixed.READ_ARMENIAN, fixed.READ_GREEK, fixed.READ_CYRILLIC) for pair in reversed(table.split())}
_ALPHABETS = ("".join(_FIRST[chr(65 + i)] for i in range(26)), *("".join(chr(code + i) for i in range(26)) for code in (0x1D586, 0x24D0, 0xFF41, 0x1F170, 0x1D670)))
_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHOUTED = "upper(replace(text, 'ß', 's'))"


@query(full.documents_read(f"(SELECT doc_id, {_SHOUTED} AS text FROM documents)", folds=False))
def normalize_look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written in look-alikes, circled letters with marks or flags, by id: they must read as the plain text does."""
    text, way = F.expr(_SHOUTED), F.pmod("doc_id", F.lit(len(_ALPHABETS) + 2))
    salted = F.when(way == len(_ALPHABETS), F.regexp_replace(text, "([A-Z])", "$1\u20dd"))
    for i, alphabet in enumerate(_ALPHABETS):
        salted = salted.when(way == i, F.translate(text, _ABC, alphabet))
    flags = F.regexp_replace(F.translate(text, _ABC, "".join(chr(0x1F1E6 + i) for i in range(26))), r"([\x{1F1E6}-\x{1F1FF}])", "$1 ")
    written = documents(spark, sf_dir).select("doc_id", salted.otherwise(flags).alias("text"))
    made = written.select("doc_id", T.normalize_text(F.col("text")).alias("v"))
    return made.select("doc_id", F.md5(F.get("v", F.lit(0))).alias("first"), F.size("v").alias("n"))
