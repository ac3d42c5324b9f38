"""Features of single rows: time, cards, addresses, e-mail, crosses, devices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The domain lists of the e-mail flags.
DISPOSABLE = ("mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email", "yopmail.com", "maildrop.cc", "sharklasers.com", "guerrillamailblock.com", "dispostable.com", "trashmail.com", "temp-mail.org", "10minuteemail.com", "tempmailaddress.com")
TRUSTED = ("qq.com", "foxmail.com", "163.com", "126.com", "yeah.net", "sina.com", "sohu.com", "139.com", "189.cn", "wo.cn", "aliyun.com", "tom.com", "gmail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.jp", "icloud.com", "mail.ru", "gmx.com")
CROSSES = (("card1", "addr1"), ("card1", "card2"), ("P_emaildomain", "addr1"))
PLACEHOLDERS = ("—", "-", "--", "unknown")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def time_features(df: DataFrame, time: str = "t", prefix: str | None = None) -> DataFrame:
    """Hour, day of week (Monday 0), midnight flag and part of the day (0 to 4) of seconds in UTC; null time gives 0."""
    if time not in df.columns:
        return df
    prefix = prefix or time
    t = F.coalesce(F.col(time), F.lit(0)).cast("long")
    hour = F.pmod(F.floor(t / 3600), F.lit(24)).cast("int")
    # 1970-01-01 was a Thursday
    day = F.pmod(F.floor(t / 86400) + 3, F.lit(7)).cast("int")
    part = F.when(hour < 6, 0).when(hour < 12, 1).when(hour < 18, 2).when(hour < 22, 3).otherwise(4)
    none = F.col(time).isNull()
    values = {f"{prefix}_hour": hour, f"{prefix}_dow": day, "is_midnight_flag": (hour < 6).cast("int"), "time_of_day": part}
    return df.select("*", *[F.when(none, 0).otherwise(v).alias(k) for k, v in values.items()])


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``{c}_missing_flag``; 1 for a column that is absent."""
    return df.select("*", *[(F.col(c).isNull().cast("int") if c in df.columns else F.lit(1)).alias(f"{c}_missing_flag") for c in columns])


def card_features(df: DataFrame) -> DataFrame:
    return missing_flags(df, ("card2", "card3", "card5"))


def address_features(df: DataFrame, first: str = "addr1", second: str = "addr2") -> DataFrame:
    """Missing flags and the joint key, ``NA`` for what is not there."""
    known = first in df.columns and second in df.columns
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) if known else F.lit("NA") for c in (first, second)]
    return missing_flags(df, (first, second)).withColumn(f"{first}_{second}", F.concat_ws("@", *parts))


def cross_features(df: DataFrame, pairs: Sequence[tuple[str, str]] = CROSSES, suffix: str = "") -> DataFrame:
    """``a@b`` text keys; numbers as whole numbers, null as ``NA``; a pair with an absent column is left out."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")}

    def text(c: str) -> Column:
        return F.coalesce((F.col(c).cast("long") if c in numeric else F.col(c)).cast("string"), F.lit("NA"))

    present = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    return df.select("*", *[F.concat_ws("@", text(a), text(b)).alias(f"{a}@{b}{suffix}") for a, b in present])


def email_features(df: DataFrame, column: str) -> DataFrame:
    """The normalised domain and flags: missing, disposable, trusted, unknown (a domain in neither list)."""
    domain = F.lower(F.trim(F.col(column))) if column in df.columns else F.lit(None).cast("string")
    name = F.when(F.coalesce(domain, F.lit("")) == "", "unknown").otherwise(domain)
    listed = domain.isin(*DISPOSABLE) | domain.isin(*TRUSTED)
    return df.select(
        "*",
        (F.col(column).isNull() if column in df.columns else F.lit(True)).cast("int").alias(f"{column}_missing_flag"),
        _flag(domain.isin(*DISPOSABLE)).alias(f"{column}_is_disposable"),
        _flag(domain.isin(*TRUSTED)).alias(f"{column}_is_trusted"),
        _flag((domain != "") & ~listed).alias(f"{column}_is_unknown"),
        name.alias(f"{column}_domain"),
    )


def hash_bucket(value: Column, size: int) -> Column:
    """The md5 of ``value`` as a number modulo ``size``; -1 for null.

    The 32 hex digits are folded eight at a time: (a * 16**8 + b) mod size.
    """
    digest, out, step = F.md5(value), F.lit(0).cast("long"), 16**8 % size
    for at in (1, 9, 17, 25):
        out = F.pmod(out * step + F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), F.lit(size))
    return F.when(value.isNull(), -1).otherwise(out).cast("int")


def device_features(df: DataFrame, buckets: int = 64) -> DataFrame:
    """Operating system, device type, browser, versions and their contradictions, from id_30, id_31, DeviceInfo and DeviceType."""

    def cleaned(c: str) -> Column:
        return F.when(F.col(c).isin(*PLACEHOLDERS), None).otherwise(F.col(c)) if c in df.columns else F.lit(None).cast("string")

    os_text, browser_text, info, kind = (cleaned(c) for c in ("id_30", "id_31", "DeviceInfo", "DeviceType"))
    either = F.lower(F.coalesce(os_text, info))
    patterns = {"android": r"android|build/", "ios": "ios", "windows": "windows", "macos": r"\bmac(?:\s|os|_)"}
    systems = {name: F.coalesce(either.rlike(p), F.lit(False)) for name, p in patterns.items()}
    any_system = systems["android"] | systems["ios"] | systems["windows"] | systems["macos"]

    def code(text: Column, android: str) -> Column:
        low = F.lower(text)
        return F.when(low.rlike(android), 0).when(low.rlike("ios"), 1).when(low.rlike("windows"), 2).when(low.rlike(patterns["macos"]), 3)

    from_os, from_info = code(os_text, "android"), code(info, r"android|build/")
    kind_low = F.lower(kind)
    mobile, desktop = F.coalesce(kind_low == "mobile", F.lit(False)), F.coalesce(kind_low == "desktop", F.lit(False))
    hits = sum((s.cast("int") for s in systems.values()), F.lit(0))
    browser = F.lower(browser_text)
    names = {"chrome": "chrome", "safari": "safari", "samsung": "samsung browser", "firefox": "firefox", "edge": "edge"}
    found = {k: F.coalesce(browser.contains(v), F.lit(False)) for k, v in names.items()}
    any_browser = found["chrome"] | found["safari"] | found["samsung"] | found["firefox"] | found["edge"]
    mobile_safari = F.coalesce(browser.contains("mobile safari"), F.lit(False))

    def version(text: Column) -> Column:
        digits = F.regexp_extract(text, r"(\d+)", 1)
        return F.when(digits != "", digits.cast("double"))

    def tier(v: Column, low: int, mid: int) -> Column:
        return F.when(v.isNull(), "none").when(v < low, "low").when(v < mid, "mid").otherwise("high")

    os_version, chrome = version(F.coalesce(os_text, info)), F.when(found["chrome"], version(browser_text))
    ios = F.when(systems["ios"], os_version)
    ids = [c for c in df.columns if c.startswith("id_")]
    no_device = info.isNull()
    for c in ids:
        no_device = no_device & cleaned(c).isNull() if c in ("id_30", "id_31") else no_device & F.col(c).isNull()
    out = {f"device_os_{k}": v.cast("int") for k, v in systems.items()}
    out |= {
        "device_os_unknown": (~any_system).cast("int"),
        "device_type_mobile": mobile.cast("int"),
        "device_type_desktop": desktop.cast("int"),
        "dev_multi_os_hit": (hits > 1).cast("int"),
        "id30_missing_but_devinfo_ok": (os_text.isNull() & info.isNotNull()).cast("int"),
        "dev_os_devinfo_mismatch": _flag(from_os != from_info),
        "dev_os_devicetype_conflict": (((systems["android"] | systems["ios"]) & desktop) | ((systems["windows"] | systems["macos"]) & mobile)).cast("int"),
    }
    out |= {f"browser_{k}": v.cast("int") for k, v in found.items()}
    out |= {
        "browser_unknown": (~any_browser).cast("int"),
        "dev_browser_os_mismatch": (any_system & ((found["samsung"] & ~systems["android"]) | (mobile_safari & ~systems["ios"]))).cast("int"),
        "os_android_ver_major": os_version,
        "os_ios_ver_major": ios,
        "browser_chrome_ver_major": chrome,
        "os_android_ver_tier": tier(os_version, 8, 13),
        "os_ios_ver_tier": tier(ios, 12, 16),
        "browser_chrome_ver_tier": tier(chrome, 80, 100),
        "os_is_very_old": _flag((systems["android"] & (os_version <= 7)) | (systems["ios"] & (ios <= 11))),
        "devinfo_str_len": F.coalesce(F.length(info), F.lit(0)),
        "devinfo_has_build_tag": _flag(F.lower(info).contains("build/")),
        "devinfo_has_samsung": _flag(F.lower(info).contains("samsung")),
        "devinfo_has_iphone": _flag(F.lower(info).contains("iphone")),
        "devinfo_hash_bucket": hash_bucket(info, buckets),
        "device_info_missing": no_device.cast("int"),
    }
    return df.select("*", *[v.alias(k) for k, v in out.items()])
