"""HTML and URL transforms, and the platform dimension."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed

COOKIE = "moderation_platform"
REGISTRY = "platform string, name string, stream_key_param string, overlays array<string>, asset_origin string, backend_origin string, backend_path_prefix string, forward_headers array<string>, impersonate boolean"


def registry(spark: SparkSession) -> DataFrame:
    """The four platforms, planned as literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(fixed.PLATFORMS)), f"array<struct<{REGISTRY}>>")))


def with_platform(df: DataFrame, name: str = "platform") -> DataFrame:
    """df with the registry's columns and `platform_error` (null where the platform is known)."""
    known = registry(df.sparkSession).withColumnRenamed("platform", "_known")
    joined = df.join(F.broadcast(known), F.col(name) == F.col("_known"), "left")
    available = ", ".join(p["platform"] for p in fixed.PLATFORMS)
    missing = F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit("Missing platform"))
    unknown = F.concat(F.lit('Unknown platform "'), F.col(name), F.lit(f'". Available: {available}'))
    return joined.withColumn("platform_error", missing.when(F.col("_known").isNull(), unknown)).drop("_known")


def resolve_platform(cookie: Column, referer: Column, default: str = fixed.DEFAULT_PLATFORM) -> Column:
    """The platform of the cookie, else of the referer's query, else the default; unknown names give the default."""
    names = [p["platform"] for p in fixed.PLATFORMS]
    of_cookie = F.nullif(F.regexp_extract(F.coalesce(cookie, F.lit("")), rf"{COOKIE}=(\w+)", 1), F.lit(""))
    of_referer = F.nullif(F.regexp_extract(F.coalesce(referer, F.lit("")), r"[?&]platform=([^&#]*)", 1), F.lit(""))
    wanted = F.coalesce(of_cookie, of_referer, F.lit(default))
    return F.when(wanted.isin(names), wanted).otherwise(F.lit(default))


def overlay_url(platform: Column, stream_key: Column, overlay_type: Column, extra: Column) -> Column:
    kind = F.coalesce(overlay_type, F.lit("alert"))
    path = F.when(kind == "mediashare", "/pro/tribe/mediashare/v2/").otherwise("/pro/tribe/alert1/v3/")
    sociabuzz = F.concat(F.lit("https://sociabuzz.com"), path, stream_key, F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("?"), extra)).otherwise(""))
    return (
        F.when(platform == "saweria", F.concat(F.lit("https://saweria.co/widgets/"), kind, F.lit("?streamKey="), stream_key))
        .when(platform == "tako", F.concat(F.lit("https://tako.id/overlay/"), kind, F.lit("?overlay_key="), stream_key))
        .when(platform == "bagibagi", F.concat(F.lit("https://bagibagi.co/alertbox/"), stream_key))
        .when(platform == "sociabuzz", sociabuzz)
    )


def param(url: Column, name: str) -> Column:
    """A query parameter's raw value; null where it is missing or empty."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def form_encoded(query: Column) -> Column:
    """A query string taken apart and put together again as form data; what cannot be decoded is encoded as it is."""

    def again(text: Column) -> Column:
        return F.url_encode(F.coalesce(F.try_url_decode(text), text))

    return F.array_join(F.transform(F.split(query, "&"), lambda p: F.concat(again(F.regexp_extract(p, "^[^=]*", 0)), F.lit("="), again(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)))), "&")


def overlay_alias(url: Column) -> Column:
    """A platform's own overlay path as struct<url, error>; null url and error where no alias fits.

    The other parameters of a Sociabuzz path stay, encoded as form data.
    """
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    widget, tako = F.regexp_extract(path, r"^/widgets/([^/]+)$", 1), F.regexp_extract(path, r"^/overlay/([^/]+)$", 1)
    box, alert, share = F.regexp_extract(path, r"^/alertbox/([^/]+)$", 1), F.regexp_extract(path, r"^/pro/tribe/alert1/v3/([^/]+)$", 1), F.regexp_extract(path, r"^/pro/tribe/mediashare/v2/([^/]+)$", 1)
    extra = F.array_join(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike("^(?:platform|overlayType|streamKey)=")), "&")
    more = F.when(extra != "", F.concat(form_encoded(extra), F.lit("&"))).otherwise("")

    def sociabuzz(kind: str, key: Column) -> Column:
        return F.concat(F.lit("/overlay?"), more, F.lit(f"platform=sociabuzz&overlayType={kind}&streamKey="), key)

    target = (
        F.when(widget != "", F.concat(F.lit("/overlay?platform=saweria&overlayType="), widget, F.lit("&streamKey="), param(url, "streamKey")))
        .when(tako != "", F.concat(F.lit("/overlay?platform=tako&overlayType="), tako, F.lit("&streamKey="), param(url, "overlay_key")))
        .when(box != "", F.concat(F.lit("/overlay?platform=bagibagi&streamKey="), box))
        .when(alert != "", sociabuzz("alert", alert))
        .when(share != "", sociabuzz("mediashare", share))
    )
    error = F.when((widget != "") & param(url, "streamKey").isNull(), F.lit("Missing streamKey"))
    return F.struct(target.alias("url"), error.alias("error"))


def paste_url(url: Column) -> Column:
    """A pasted platform URL as an overlay query; null where no pattern fits."""
    forms = (
        ("saweria", r"^https?://saweria\.co/widgets/(alert|mediashare)\?streamKey=([^&]+)"),
        ("tako", r"^https?://tako\.id/overlay/(alert|mediashare)\?overlay_key=([^&]+)"),
    )
    out = F.lit(None).cast("string")
    buzz = r"^https?://sociabuzz\.com/pro/tribe/(alert1/v3|mediashare/v2)/([^?&#]+)(.*)?"
    kind = F.when(F.regexp_extract(url, buzz, 1).startswith("alert"), "alert").otherwise("mediashare")
    rest = F.regexp_extract(url, buzz, 3)
    tail = F.when(rest.startswith("?"), F.concat(F.lit("&"), F.substring(rest, 2, 1 << 30))).otherwise("")
    out = F.when(url.rlike(buzz), F.concat(F.lit("platform=sociabuzz&overlayType="), kind, F.lit("&streamKey="), F.regexp_extract(url, buzz, 2), tail)).otherwise(out)
    box = r"^https?://bagibagi\.co/alertbox/([^?&#]+)"
    out = F.when(url.rlike(box), F.concat(F.lit("platform=bagibagi&streamKey="), F.regexp_extract(url, box, 1))).otherwise(out)
    for name, pattern in reversed(forms):
        made = F.concat(F.lit(f"platform={name}&overlayType="), F.regexp_extract(url, pattern, 1), F.lit("&streamKey="), F.regexp_extract(url, pattern, 2))
        out = F.when(url.rlike(pattern), made).otherwise(out)
    return out


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+", 0)


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Only the first match is replaced (Spark's own function replaces all)."""
    return F.regexp_replace(text, rf"^([\s\S]*?){pattern}", replacement)


def backend_target(url: Column, platform: Column, backend_origin: Column) -> Column:
    """A proxied path as the backend's URL: prefix and control parameters dropped, once each."""
    prefix = F.concat(F.lit("/backend/"), platform)
    at = F.position(prefix, url)
    path = F.when(at > 0, F.concat(F.substr(url, F.lit(1), at - 1), F.substr(url, at + F.length(prefix)))).otherwise(url)
    path = replace_first(path, "([?&])streamKey=[^&]*&?", "$1$2")
    path = replace_first(path, "([?&])overlayType=[^&]*&?", "$1$2")
    return F.concat(origin_of(backend_origin), F.regexp_replace(path, r"[?&]\z", ""))


def client_rewrite(url: Column, platform: Column, backend_origin: Column, prefix: Column, stream_key: Column, overlay_type: Column, here: str = "http://localhost:3000") -> Column:
    """A page's backend call as a call to the proxy: by origin, else by path prefix, else unchanged."""

    def proxied(path: Column) -> Column:
        mark = F.when(F.contains(path, F.lit("?")), "&").otherwise("?")
        kind = F.when(F.coalesce(overlay_type, F.lit("")) != "", F.concat(F.lit("&overlayType="), F.url_encode(overlay_type))).otherwise("")
        return F.concat(F.lit(f"{here}/backend/"), platform, path, mark, F.lit("streamKey="), F.url_encode(stream_key), kind)

    rest = F.substr(url, F.length(origin_of(backend_origin)) + 1)
    return F.when(url.startswith(backend_origin), proxied(rest)).when(url.startswith(prefix), proxied(url)).otherwise(url)


def strip_artefacts(html: Column, asset_origin: Column) -> Column:
    """HTML without what a content network added to it, in fixed order."""
    out = F.replace(html, F.concat(asset_origin, F.lit("/")), F.lit("/"))
    for pattern in fixed.ARTEFACTS:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r'(?i)type="[a-f0-9]+-module"', 'type="module"')
    return F.regexp_replace(out, r'(?i)type="[a-f0-9]+-text/javascript"', "")


def inject_head(html: Column, block: Column, inline: Column) -> Column:
    """The block before the first </head>, or, inline, after the first <head ...>; unchanged where there is none."""
    close = F.instr(html, "</head>")
    before = F.when(close > 0, F.concat(F.substr(html, F.lit(1), close - 1), block, F.substr(html, close))).otherwise(html)
    opening = F.regexp_extract(html, r"<head[^>]*>", 0)
    at = F.position(opening, html) + F.length(opening)
    after = F.when(opening != "", F.concat(F.substr(html, F.lit(1), at - 1), block, F.substr(html, at))).otherwise(html)
    return F.when(inline, after).otherwise(before)


def mime_of(path: Column) -> Column:
    ending = F.element_at(F.split(F.regexp_extract(path, r"^[^?#]*", 0), r"\."), -1)
    return F.create_map(*[F.lit(x) for pair in fixed.MIME_TYPES.items() for x in pair])[ending]


def forward_headers(headers: Column, allowed: Column) -> Column:
    """Allowed, non-empty request headers."""
    return F.map_filter(headers, lambda k, v: F.array_contains(allowed, F.lower(k)) & (F.coalesce(v, F.lit("")) != ""))


def referer_matches(referer: Column, host: Column) -> Column:
    return F.coalesce(F.regexp_extract(referer, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1) == host, F.lit(False))


def minus_reserved(params: Column) -> Column:
    return F.map_filter(params, lambda k, v: ~k.isin("platform", "overlayType", "streamKey"))
