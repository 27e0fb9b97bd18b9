"""Stored web pages: their text, whether they can be used, and the platforms they run on."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a page's text leaves out, in this order, and what each run of blanks becomes; phrases of block pages, the least useful length and the most that is kept; markers of platforms by category.
LEFT_OUT = (r"(?is)<(script|style|noscript|svg|nav|footer|header)[^>]*>.*?</\1>", r"(?s)<!--.*?-->", r"<[^>]+>")
BLANKS = ((r"[ \t\r\f\x0B]+", " "), (r" *\n *", "\n"), (r"\n\s*\n+", "\n"), (r"(?U)^\s+|\s+$", ""))
MAX_CHARS = 6000
BLOCKED = (
    "you have been blocked", "access denied", "are you a human", "enable javascript and cookies", "verify you are human", "unusual traffic",
    "complete the security check", "attention required", "error 403", "forbidden", "requiring captcha", "please enable cookies",
)
LEAST_CHARS = 200
PLATFORMS = {
    "ecommerce_platform": (("cdn.shopify.com", "Shopify"), ("cdn.shopifycdn.net", "Shopify"), ("/wp-content/plugins/woocommerce", "WooCommerce"), ("bigcommerce.com/s-", "BigCommerce"), ("cdn.shopware.com", "Shopware")),
    "cms_platform": (("/wp-content/", "WordPress"), ("/wp-includes/", "WordPress"), ("webflow.js", "Webflow"), ("assets.squarespace.com", "Squarespace"), ("wixstatic.com", "Wix"), ("cdn.contentful.com", "Contentful")),
    "marketing_crm_platform": (
        ("js.hs-scripts.com", "HubSpot"), ("js.hsforms.net", "HubSpot"), ("js.hsleadflows.net", "HubSpot"), ("cdn.marketo.com", "Marketo"), ("munchkin.marketo.net", "Marketo"), ("pardot.com", "Pardot"),
        ("d.la4-c1-was.salesforceliveagent.com", "Salesforce Live Agent"),
    ),
    "analytics_platform": (("googletagmanager.com/gtm.js", "Google Tag Manager"), ("cdn.segment.com/analytics.js", "Segment"), ("cdn.amplitude.com", "Amplitude"), ("static.hotjar.com", "Hotjar")),
}


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def page_text(raw: Column) -> Column:
    """The text between a page's tags, without scripts, styles, navigation and comments; null stays null."""
    bare = reduce(lambda c, pattern: F.regexp_replace(c, pattern, " "), LEFT_OUT, raw)
    return reduce(lambda c, pair: F.regexp_replace(c, *pair), BLANKS, _unescaped(bare))


def page_state(text: Column) -> Column:
    """block_page, empty_content or ok."""
    blocked = F.lower(F.substring(text, 1, 2000)).rlike("|".join(BLOCKED))
    return F.when(blocked, "block_page").when(F.length(F.coalesce(text, F.lit(""))) < LEAST_CHARS, "empty_content").otherwise("ok")


def page_excerpt(text: Column, most: int = MAX_CHARS) -> Column:
    """What is kept of a page for a judge: its first ``most`` characters if it is in order, else null."""
    return F.when(page_state(text) == "ok", F.substring(text, 1, most))


def platforms(raw: Column) -> Column:
    """struct with one platform a category (null: none): the first marker of the table that the page holds; nothing from block pages."""
    low = F.lower(raw)
    usable = ~F.substring(low, 1, 4000).rlike("|".join(BLOCKED))
    return F.struct(*[F.coalesce(*[F.when(usable & F.contains(low, F.lit(mark)), name) for mark, name in marks]).alias(kind) for kind, marks in PLATFORMS.items()])
