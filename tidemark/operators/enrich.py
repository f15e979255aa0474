"""Enrichment of events: address, place, user agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import kv

_IPV4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"
_IPV6 = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"

# User-agent families, the first that applies wins.
BROWSERS = [("Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera", r"OPR/([\d.]+)"), ("Chrome", r"(?:Chrome|CriOS)/([\d.]+)"), ("Firefox", r"(?:Firefox|FxiOS)/([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari/")]
ENGINES = [("Gecko", r"rv:([\d.]+)\) Gecko/"), ("AppleWebKit", r"AppleWebKit/([\d.]+)"), ("Trident", r"Trident/([\d.]+)")]
SYSTEMS = [("Android", "Android"), ("iOS", "iPhone|iPad|iPod"), ("Windows", "Windows"), ("macOS", "Mac OS X"), ("Linux", "Linux|X11")]
BOT = r"(?i)bot|crawl|spider|slurp|curl/|wget/|python-requests"


def is_ip(text: Column) -> Column:
    return text.rlike(_IPV4) | text.rlike(_IPV6)


def ip_number(text: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    parts = F.split(text, "\\.")
    number = sum((F.element_at(parts, i + 1).cast("long") * (1 << 8 * (3 - i)) for i in range(1, 4)), F.element_at(parts, 1).cast("long") * (1 << 24))
    return F.when(text.rlike(_IPV4), number)


def with_ip(search: Column, request_ip: Column, replace_given: bool = False) -> Column:
    """``search`` with an ``ip`` pair of the request if none is given (or instead of it); '<nil>' if it is no address."""
    given = F.exists(search, lambda p: p["key"] == "ip")
    own = F.array(kv("ip", F.when(is_ip(request_ip), request_ip).otherwise(F.lit("<nil>"))))
    if replace_given:
        return F.concat(F.filter(search, lambda p: p["key"] != "ip"), own)
    return F.when(given, search).otherwise(F.concat(search, own))


def with_place(df: DataFrame, ranges: DataFrame, ip_col: str, prefix_bits: int = 16) -> DataFrame:
    """``df`` with geoip_city and geoip_country pairs from a table (start, end, city, country) of number ranges.

    A range join by prefix: ranges are dealt to the address prefixes that they touch, so that the join is an
    equality of prefixes with a filter, and a table of any size can be shuffled.
    """
    width = 1 << (32 - prefix_bits)
    dealt = ranges.withColumn("_prefix", F.explode(F.sequence(F.call_function("div", F.col("start"), F.lit(width)), F.call_function("div", F.col("end"), F.lit(width)))))
    number = ip_number(F.col(ip_col))
    left = df.withColumn("_ip", number).withColumn("_at", F.call_function("div", F.col("_ip"), F.lit(width)))
    joined = left.join(dealt, (F.col("_at") == F.col("_prefix")) & F.col("_ip").between(F.col("start"), F.col("end")), "left")
    place = F.when(F.col("city").isNotNull(), F.concat("search", F.array(kv("geoip_city", F.col("city")), kv("geoip_country", F.col("country"))))).otherwise(F.col("search"))
    return joined.withColumn("search", place).select(*df.columns)


def _family(agent: Column, table: list[tuple[str, str]]) -> tuple[Column, Column]:
    name, version = F.lit(""), F.lit("")
    for family, pattern in reversed(table):
        hit = agent.rlike(pattern)
        name, version = F.when(hit, family).otherwise(name), F.when(hit, F.regexp_extract(agent, pattern, 1) if "(" in pattern else F.lit("")).otherwise(version)
    return name, version


def user_agent_tags(agent: Column) -> Column:
    """Eight pairs about a user agent, of the documented families."""
    flag = lambda c: F.when(c, "true").otherwise("false")
    browser, browser_version = _family(agent, BROWSERS)
    engine, engine_version = _family(agent, ENGINES)
    system, _ = _family(agent, [(n, p) for n, p in SYSTEMS])
    platform = F.regexp_extract(agent, r"\(([^;)]+)", 1)
    return F.array(
        kv("ua_is_bot", flag(agent.rlike(BOT))), kv("ua_is_mobile", flag(agent.rlike("Mobi|Android|iPhone|iPad"))), kv("ua_platform", platform), kv("ua_os", system),
        kv("ua_engine_name", engine), kv("ua_engine_version", engine_version), kv("ua_browser_name", browser), kv("ua_browser_version", browser_version),
    )
