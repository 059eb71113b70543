"""What a text costs as text and as image pages, how well pages read back, and which route to take."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the results to match.
#: Dollars per million tokens in and out, cache read and write multipliers, how images are counted; first family contained in a model's name, in this order.
RATES = {
    "opus": ("15", "75", "0.1", "1.25", "patch"),
    "sonnet": ("3", "15", "0.1", "1.25", "patch"),
    "haiku": ("1", "5", "0.1", "1.25", "patch"),
    "gpt": ("1.25", "10", "0.1", "1.25", "tile512"),
    "gemini": ("1.25", "10", "0.25", "1", "tile768"),
    "default": ("3", "15", "0.1", "1.25", "patch"),
}
#: Names of a rate's parts in overrides, and how each family counts images.
PARTS = ("input", "output", "cacheReadMult", "cacheWriteMult")
FAMILIES = {"anthropic": "patch", "openai": "tile512", "gemini": "tile768"}
WEAK_READERS = ("claude-haiku-4-5", "claude-sonnet-4-5")
#: Highest ratio of text to image tokens, level, accuracy.
BANDS = ((8, "high", "~98%"), (12, "good", "~90-97%"), (16, "degraded", "~75-87%"), (20, "low", "~60-75%"))
BELOW = ("unreliable", "<60%")
FETCH_SHARE, FETCH_SAVING, FETCH_PAGES = 75, 300, 6


Rates = dict[str, tuple[str, ...]]


def rates(override: str | None) -> Rates:
    """The table with parts replaced by a JSON object of objects; what doesn't parse changes nothing."""
    try:
        given = json.loads(override or "{}")
        own = dict(RATES)
        for key, parts in given.items():
            base = own.get(key, RATES["default"])
            own[key] = (*(str(parts.get(p, v)) for p, v in zip(PARTS, base, strict=False)), FAMILIES.get(parts.get("family"), base[4]))
    except (ValueError, AttributeError):
        return RATES
    return own


def rate_key(model: Column) -> Column:
    name = F.lower(F.coalesce(model, F.lit("")))
    out = F.lit("default")
    for key in reversed([k for k in RATES if k != "default"]):
        out = F.when(name.contains(key), key).otherwise(out)
    return out


def _rate(key: Column, i: int, kind: str, table: Rates = RATES) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])]), key).cast(kind)


def provider_tokens(dims: Column, kind: Column, patch_tokens: Column) -> Column:
    """Image tokens of pages (array of structs w, h) by the way a provider counts."""

    def tile512(d: Column) -> Column:
        w, h = d["w"].cast("double"), d["h"].cast("double")
        s1 = F.least(F.lit(1.0), F.lit(2048.0) / F.greatest(w, h))
        w, h = w * s1, h * s1
        s2 = F.least(F.lit(1.0), F.lit(768.0) / F.least(w, h))
        return F.lit(85) + F.lit(170) * (F.ceil(F.ceil(w * s2) / 512) * F.ceil(F.ceil(h * s2) / 512))

    def tile768(d: Column) -> Column:
        return F.when((d["w"] <= 384) & (d["h"] <= 384), F.lit(258)).otherwise(F.lit(258) * (F.ceil(d["w"] / 768) * F.ceil(d["h"] / 768)))

    total = lambda f: F.aggregate(dims, F.lit(0).cast("long"), lambda a, d: a + f(d).cast("long"))
    return F.when(kind == "tile512", total(tile512)).when(kind == "tile768", total(tile768)).otherwise(patch_tokens).cast("long")


def cost_verdict(rows: DataFrame, table: Rates = RATES) -> DataFrame:
    """``rows`` (model, cached, text_tokens, image_tokens, dims or not) with key, image_count, text_usd, image_usd, cheaper, cost_saved_pct, breakeven.

    Dollars are decimals, exact to the last place.
    """
    key = rate_key(F.col("model"))
    money = "decimal(12,4)"
    rows = rows.withColumn("key", key)
    count = provider_tokens(F.col("dims"), _rate(F.col("key"), 4, "string", table), F.col("image_tokens")) if "dims" in rows.columns else F.col("image_tokens")
    one = F.lit(1).cast("decimal(4,2)")
    into = _rate(F.col("key"), 0, money, table)
    text_rate = into * F.when(F.col("cached"), _rate(F.col("key"), 2, "decimal(4,2)", table)).otherwise(one)
    image_rate = into * F.when(F.col("cached"), _rate(F.col("key"), 3, "decimal(4,2)", table)).otherwise(one)
    rows = rows.withColumns({"image_count": count.cast("long"), "_t": text_rate * F.col("text_tokens").cast("decimal(14,0)"), "_i": image_rate * count.cast("decimal(14,0)"), "_r": image_rate})
    usd = lambda c: F.round(F.col(c) / F.lit(1000000).cast("decimal(7,0)"), 6).cast("decimal(18,6)")
    d = (F.col("_t") - F.col("_i")).cast("decimal(30,6)")
    pct = F.when(F.col("_t") == 0, F.lit(0)).otherwise(F.signum(d) * F.floor((F.abs(d) * 200 + F.col("_t")).cast("decimal(34,6)") / (F.col("_t") * 2).cast("decimal(34,6)")))
    return rows.withColumns(
        {
            "text_usd": usd("_t"), "image_usd": usd("_i"), "cheaper": F.when(F.col("_i") < F.col("_t"), "PIPELINE").otherwise("TEXT"),
            "cost_saved_pct": pct.cast("long"), "breakeven": F.floor(F.col("_t") / F.col("_r")).cast("long"),
        }
    ).drop("_t", "_i", "_r")


def is_weak_reader(model: Column) -> Column:
    name = F.lower(F.coalesce(model, F.lit("")))
    return name.contains(WEAK_READERS[0]) | name.contains(WEAK_READERS[1])


def tenths(text_tokens: Column, image_tokens: Column) -> Column:
    """Tenths of the ratio of text to image tokens, rounded half up."""
    return F.when(image_tokens > 0, F.floor((text_tokens * 20 + image_tokens) / (image_tokens * 2))).otherwise(0).cast("long")


def fidelity_level(text_tokens: Column, image_tokens: Column, tiny: Column, weak: Column) -> Column:
    t = tenths(text_tokens, image_tokens)
    level = F.lit(BELOW[0])
    for most, name, _ in reversed(BANDS):
        level = F.when(t <= most * 10, name).otherwise(level)
    floored = F.when(tiny & level.isin("high", "good", "degraded"), "low").otherwise(level)
    return F.when(image_tokens <= 0, "high").when(weak, "unreliable").otherwise(floored)


def route(rows: DataFrame) -> DataFrame:
    """``rows`` (raw_tokens, image_tokens, side_tokens, space_tokens, n_credentials, dense, model, cheaper) with pick, tokens, route_saved_pct, fidelity, reason."""
    weak = is_weak_reader(F.col("model"))
    level = fidelity_level(F.col("raw_tokens"), F.col("image_tokens"), F.lit(False), weak)
    clean = level.isin("high", "good")
    wins = F.col("space_tokens") < F.col("raw_tokens")
    text_tokens = F.when(wins, F.col("space_tokens")).otherwise(F.col("raw_tokens"))
    image = F.col("image_tokens") + F.col("side_tokens")
    stays = (F.col("n_credentials") > 0) | F.col("dense") | weak | F.coalesce(F.col("cheaper") == "TEXT", F.lit(False))
    imaged = ~stays & clean & (image < text_tokens)
    reason = (
        F.when(F.col("n_credentials") > 0, "credentials").when(F.col("dense"), "dense").when(weak, "weak reader").when(F.col("cheaper") == "TEXT", "cost")
        .when(imaged, "image").when(~clean, "past the cliff").otherwise("text is cheaper")
    )
    tokens = F.when(imaged, image).otherwise(text_tokens)
    return rows.withColumns(
        {
            "pick": F.when(imaged, "image").when(wins, "text").otherwise("raw"), "tokens": tokens, "route_saved_pct": T.percent_saved(F.col("raw_tokens"), tokens),
            "fidelity": F.when(imaged, level).otherwise("exact"), "reason": reason,
        }
    )


def steered(rows: DataFrame) -> DataFrame:
    """``rows`` of a route (reason, tokens, n_credentials) and an advice (crush_kept, crush_rows, crush_text_tokens, crush_image_tokens) with steer: the thinned-out row set, where it takes fewer tokens than the route."""
    least = F.least("crush_text_tokens", "crush_image_tokens")
    word = lambda c: c.cast("string")
    text = F.concat(F.lit("crush: true would keep "), word(F.col("crush_kept")), F.lit(" of "), word(F.col("crush_rows")), F.lit(" rows for ~"), word(least), F.lit(" tok, full set stashed (recommend.crush)"))
    return rows.withColumn("steer", F.when((F.col("n_credentials") == 0) & (least < F.col("tokens")), text))


def verdict() -> Column:
    image = F.col("image_tokens") + F.col("side_tokens")
    return F.when(F.col("n_credentials") > 0, "TEXT cheaper (credentials)").when(F.col("dense"), "TEXT cheaper (needle-dense)").when(image < F.col("raw_tokens"), "PIPELINE cheaper").otherwise("TEXT cheaper")


def may_be_pages(raw: Column, cost: Column, pages: Column, n_credentials: Column, dense: Column) -> Column:
    """Whether a fetched slice goes out as pages."""
    return (cost * 100 <= raw * FETCH_SHARE) & (raw - cost >= FETCH_SAVING) & (pages <= FETCH_PAGES) & (n_credentials == 0) & ~dense
