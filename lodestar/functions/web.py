"""URLs, egress rules, redirects, regions and robots patterns as Column expressions."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce
from operator import or_
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.udf import vectorised
from lodestar.functions.text import col, let

#: Lone subtags read as a country, not a language.
COUNTRIES = (
    "us", "gb", "uk", "ca", "au", "nz", "ie", "jp", "cn", "hk", "tw", "kr", "in", "sg", "my", "th",
    "vn", "id", "ph", "de", "fr", "es", "it", "pt", "nl", "be", "ch", "at", "se", "no", "fi", "dk",
    "pl", "cz", "gr", "tr", "ru", "ua", "br", "mx", "ar", "cl", "co", "za", "eg", "sa", "ae", "il",
)
#: The language that a search region's country implies.
REGION_LANGUAGES = {
    "ae": "ar", "ar": "es", "at": "de", "au": "en", "be": "fr", "br": "pt", "ca": "en", "ch": "de", "cl": "es", "cn": "zh",
    "co": "es", "cz": "cs", "de": "de", "dk": "da", "eg": "ar", "es": "es", "fi": "fi", "fr": "fr", "gb": "en", "gr": "el",
    "hk": "tzh", "id": "id", "ie": "en", "il": "he", "in": "en", "it": "it", "jp": "jp", "kr": "kr", "mx": "es", "my": "ms",
    "nl": "nl", "no": "no", "nz": "en", "ph": "en", "pl": "pl", "pt": "pt", "ru": "ru", "sa": "ar", "se": "sv", "sg": "en",
    "th": "th", "tr": "tr", "tw": "tzh", "ua": "uk", "uk": "en", "us": "en", "vn": "vi", "za": "en",
}
#: Markup found only on pages that ask for a human.
CHALLENGE_MARKUP = (
    'id="b_captcha"', "id='b_captcha'", 'id="captcha-form"', 'class="g-recaptcha"', 'id="challenge-form"',
    'id="cf-challenge-running"', 'id="anomaly-modal"', "anomaly-modal", "anomaly.js", "cf-browser-verification",
    "/recaptcha/api.js", "challenges.cloudflare.com/turnstile", "/cdn-cgi/challenge-platform/", 'name="captcha_answer"',
)
CHALLENGE_TITLES = ("captcha", "unusual traffic", "verify you are human", "just a moment", "checking your browser", "robot check", "are you a robot")
SMALL_PAGE = 8 * 1024
#: IPv4 ranges that must not be fetched.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
)
BLOCKED_V6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8", "2001:db8::/32", "100::/64")
IMAGE_TYPES = {
    "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/avif": "avif",
    "image/bmp": "bmp", "image/x-icon": "ico", "image/tiff": "tiff", "image/svg+xml": "svg",
}
ROBOTS_MOST = 512 * 1024
PAGE_TYPES = ("", "text/html", "application/xhtml+xml", "text/plain")


def part(url: Column | str, name: str) -> Column:
    return F.try_parse_url(col(url), F.lit(name))


def host(url: Column | str) -> Column:
    """The host in lower case, brackets of IPv6 included; also where it is only a number."""
    named = F.regexp_extract(part(url, "AUTHORITY"), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:\[\]]+)(?::\d*)?$", 1)
    return F.lower(F.coalesce(part(url, "HOST"), F.nullif(named, F.lit(""))))


def http_url(url: Column | str) -> Column:
    """The URL in normal form if it is http(s) without credentials, else null: scheme and host in
    lower case, default port dropped, an empty path made ``/``."""
    u = F.trim(col(url))
    scheme, authority = F.lower(part(u, "PROTOCOL")), part(u, "AUTHORITY")
    good = scheme.isin("http", "https") & part(u, "USERINFO").isNull() & ~authority.contains("@") & host(u).isNotNull()
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = part(u, "PATH")
    return F.when(
        good,
        F.concat(
            scheme, F.lit("://"), host(u), F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
            F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(path),
            F.coalesce(F.concat(F.lit("?"), part(u, "QUERY")), F.lit("")), F.coalesce(F.concat(F.lit("#"), part(u, "REF")), F.lit("")),
        ),
    )


def origin(url: Column | str) -> Column:
    u = http_url(url)
    return F.regexp_extract(u, r"^(https?://[^/?#]+)", 1)


def path_query(url: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(http_url(url), r"^https?://[^/?#]+([^#]*)", 1), "^$", "/")


def ipv4_number(address: Column | str) -> Column:
    """A dotted address as a number; null if it is not one."""
    a = col(address)
    good = a.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    octet = lambda i: F.get(F.split(a, r"\."), F.lit(i)).try_cast("bigint")
    return F.when(good, ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3))


def blocked_number(number: Column) -> Column:
    """Whether an IPv4 address, as a number, is out of bounds."""
    nets = [ipaddress.ip_network(text) for text in BLOCKED_V4]
    return let(number, lambda n: reduce(or_, (n.between(int(x.network_address), int(x.broadcast_address)) for x in nets)))


def blocked_ipv4(address: Column | str) -> Column:
    return blocked_number(ipv4_number(address))


def host_number(name: Column | str) -> Column:
    """The IPv4 address that a host means, as a number: one to four parts, each decimal, octal or hex,
    the last one filling what is left. Null for names and for numbers out of range."""
    parts = F.split(F.regexp_replace(col(name), r"\.$", ""), r"\.")

    def value(x: Column) -> Column:
        hexa = F.when(x == "0x", F.lit("0")).otherwise(F.conv(F.substring(x, 3, 99), 16, 10))
        short = F.length(x) < 15
        return F.when(short & x.rlike("^0x[0-9a-f]*$"), hexa).when(short & x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).when(short & x.rlike(r"^(0|[1-9]\d*)$"), x).try_cast("bigint")

    def number(numbers: Column) -> Column:
        n = F.size(numbers)
        head, last = F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), F.element_at(numbers, -1)
        fits = ~F.exists(head, lambda x: x > 255) & (last < F.pow(F.lit(256), 5 - n))
        total = F.aggregate(F.transform(head, lambda x, i: x * F.pow(F.lit(256.0), 3 - i).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when((n <= 4) & ~F.exists(numbers, lambda x: x.isNull()) & fits, total + last)

    return let(F.transform(parts, value), number)


def ipv6_groups(address: Column | str) -> Column:
    """The eight 16-bit groups of an IPv6 address, with ``::`` filled in and a dotted end read; null if it is none."""

    def plain(a: Column) -> Column:
        """With a dotted end as two groups."""
        dotted = ipv4_number(F.regexp_extract(a, r":(\d{1,3}(?:\.\d{1,3}){3})$", 1))
        low = let(dotted, lambda n: F.lower(F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(0xFFFF))))))
        return F.when(a.contains("."), F.concat(F.regexp_extract(a, r"^(.*:)[\d.]+$", 1), low)).otherwise(a)

    def side(a: Column, i: int) -> Column:
        half = F.get(F.split(a, "::", -1), F.lit(i))
        return F.coalesce(F.filter(F.split(half, ":", -1), lambda x: x != ""), F.array().cast("array<string>"))

    def filled(sides: Column) -> Column:
        gap = 8 - F.size(sides["l"]) - F.size(sides["r"])
        fits = F.when(sides["two"], gap >= 1).otherwise(gap == 0)
        return F.when(sides["shape"] & fits, F.concat(sides["l"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), sides["r"]))

    def groups(a: Column) -> Column:
        shape = ~a.rlike(r":::|^:[^:]|[^:]:$|::.*::")
        return let(F.struct(side(a, 0).alias("l"), side(a, 1).alias("r"), a.contains("::").alias("two"), shape.alias("shape")), filled)

    number = lambda x: F.when(x.rlike("^[0-9a-f]{1,4}$"), F.conv(x, 16, 10).cast("bigint"))
    found = let(let(F.lower(col(address)), plain), groups)
    return let(F.transform(found, number), lambda g: F.when(~F.exists(g, lambda x: x.isNull()), g))


def blocked_ipv6(address: Column | str) -> Column:
    """Whether an IPv6 address is out of bounds, by itself or by the IPv4 address inside it; null if it is none."""
    return let(ipv6_groups(address), _blocked_groups)


def _blocked_groups(g: Column) -> Column:
    at = lambda i: F.get(g, F.lit(i))
    out = F.lit(False)
    for text in BLOCKED_V6:
        net = ipaddress.ip_network(text)
        inside = F.lit(True)
        for i in range(-(-net.prefixlen // 16)):
            shift = 16 * (7 - i)
            mask = int(net.netmask) >> shift & 0xFFFF
            inside = inside & (at(i).bitwiseAND(F.lit(mask)) == (int(net.network_address) >> shift & 0xFFFF))
        out = out | inside
    starts = lambda *groups: F.slice(g, 1, len(groups)) == F.array(*(F.lit(x).cast("bigint") for x in groups))
    pair = lambda i: at(i) * 65536 + at(i + 1)
    end = starts(0, 0, 0, 0, 0, 0) | starts(0, 0, 0, 0, 0, 0xFFFF) | starts(0, 0, 0, 0, 0xFFFF, 0) | starts(0x64, 0xFF9B, 0, 0, 0, 0)
    inner = F.when(end, pair(6)).when(starts(0x2002), pair(1)).when(starts(0x2001, 0), F.lit(0xFFFFFFFF) - pair(6))
    return out | F.coalesce(blocked_number(inner), F.lit(False))


def blocked_ip(address: Column | str) -> Column:
    """Whether an address of either family is out of bounds; what is no address is not."""
    a = col(address)
    return F.when(a.isNotNull(), F.coalesce(F.when(a.contains(":"), blocked_ipv6(a)).otherwise(blocked_ipv4(a)), F.lit(False)))


def egress_error(url: Column | str, allow_private: bool = False) -> Column:
    """Why a URL must not be fetched, or null. Hosts that are numbers in any spelling, and IPv6
    addresses, are judged as addresses; those that are malformed are no URLs."""
    u = F.trim(col(url))
    told = F.struct(F.lower(part(u, "PROTOCOL")).alias("scheme"), host(u).alias("name"), (part(u, "USERINFO").isNotNull() | part(u, "AUTHORITY").contains("@")).alias("login"))

    def error(x: Column) -> Column:
        scheme, name = x["scheme"], x["name"]
        out = F.when(scheme.isNull(), "not a URL").when(~scheme.isin("http", "https"), F.concat(F.lit("scheme not allowed: "), scheme))
        out = out.when(x["login"], "credentials in URL").when(name.isNull(), "no host")
        six = F.regexp_replace(name, r"^\[|\]$", "")
        blocked = F.when(name.startswith("["), blocked_ipv6(six)).when(name.rlike(r"(^|\.)(0x[0-9a-f]*|\d+)\.?$"), blocked_number(host_number(name))).otherwise(name.rlike(r"(^|\.)localhost\.?$"))
        return let(F.struct(out.alias("out"), blocked.alias("b")), lambda y: F.coalesce(y["out"], F.when(y["b"].isNull(), "not a URL"), F.lit(None) if allow_private else F.when(y["b"], F.concat(F.lit("refusing to connect to "), name))))

    return let(told, error)


def allowed_addresses(addresses: Column | str) -> Column:
    """The resolved addresses, of either family, that may be connected to."""
    return F.filter(col(addresses), lambda a: ~F.coalesce(blocked_ip(a), F.lit(True)))


def resolve_error(addresses: Column | str) -> Column:
    """Why a resolved name cannot be connected to, or null: it has no address, or only blocked ones."""
    a = col(addresses)
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, "no addresses").when(F.size(allowed_addresses(a)) == 0, "refusing to connect: all addresses are blocked")


def open_error(url: Column | str, any_scheme: bool = False) -> Column:
    scheme = F.lower(part(url, "PROTOCOL"))
    out = F.when(part(url, "USERINFO").isNotNull() | F.coalesce(part(url, "AUTHORITY").contains("@"), F.lit(False)), "credentials in URL")
    return out if any_scheme else out.when(scheme.isNull() | ~scheme.isin("http", "https"), "scheme not allowed")


def unwrap_redirect(href: Column | str, site: str = "duckduckgo.com") -> Column:
    """The target of a ``/l/?uddg=`` link of the site, absolute, relative or without scheme; else null."""
    h = col(href)
    full = F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(F.lit(f"https://{site}"), h)).otherwise(h)
    name = host(full)
    ours = ((name == site) | name.endswith("." + site)) & part(full, "PATH").isin("/l/", "/l")
    return F.when(ours, http_url(F.try_url_decode(F.try_parse_url(full, F.lit("QUERY"), F.lit("uddg")))))


def decode_redirect_b64(href: Column | str, site: str = "bing.com") -> Column:
    """The target of a click-tracking link: parameter ``u``, a marker of a letter and a digit, base64
    in either alphabet, padded or not; else null."""
    h = col(href)
    name = host(h)
    ours = ((name == site) | name.endswith("." + site)) & part(h, "PATH").rlike(r"^/(ck/a|rd)")
    raw = F.regexp_extract(part(h, "QUERY"), r"(?:^|&)u=([^&]*)", 1)
    raw = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    payload = F.translate(F.regexp_replace(raw, r"^a\d", ""), "-_", "+/")
    text = F.try_to_binary(F.rtrim(payload, F.lit("=")), F.lit("base64")).try_cast("string")
    return F.when(ours & (payload != "") & text.rlike(r"^https?://[^/\s]"), text)


def image_format(url: Column | str) -> Column:
    kinds = "jpg|jpeg|png|gif|webp|avif|bmp|ico|tiff"
    found = F.lower(F.regexp_extract(F.regexp_replace(col(url), r"[?#].*$", ""), rf"(?i)\.({kinds})$", 1))
    return F.when(found == "jpeg", "jpg").otherwise(found)


def type_extension(mime: Column | str) -> Column:
    kind = F.lower(F.trim(F.substring_index(col(mime), ";", 1)))
    out = F.lit(None).cast("string")
    for name, ext in IMAGE_TYPES.items():
        out = F.when(kind == name, ext).otherwise(out)
    return out


def sniff_image(data: Column | str) -> Column:
    """The image format that the first bytes announce; null if none."""
    head = F.hex(F.substring(col(data), 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.rlike("^47494638(37|39)61"), "gif")
        .when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^.{8}66747970(61766966|61766973)"), "avif")
        .when(head.startswith("424D"), "bmp").when(head.startswith("00000100"), "ico").when(head.rlike("^(49492A00|4D4D002A)"), "tiff")
    )


def accepts_type(content_type: Column | str) -> Column:
    """Whether a response of this type is read as a page."""
    return F.lower(F.trim(F.substring_index(F.coalesce(col(content_type), F.lit("")), ";", 1))).isin(*PAGE_TYPES)


def is_challenge(body: Column | str) -> Column:
    """A page that asks for a human: tell-tale markup, or a small page with a tell-tale title."""
    low = F.lower(col(body))
    out = F.lit(False)
    for mark in CHALLENGE_MARKUP:
        out = out | low.contains(mark)
    title = F.regexp_extract(low, r"(?s)<title(?:\s[^>]*)?>(.*?)</title>", 1)
    named = F.lit(False)
    for mark in CHALLENGE_TITLES:
        named = named | title.contains(mark)
    return out | ((F.octet_length(col(body)) < SMALL_PAGE) & named)


def channel_name(query: Column | str) -> Column:
    """The public channel that a query names (``@name``, ``name`` or a link), else null."""
    head = F.get(F.split(F.trim(col(query)), r"\s+"), F.lit(0))
    name = F.regexp_replace(F.regexp_replace(head, "^@", ""), r"(?i)^(https?://)?t\.me/(s/)?", "")
    name = F.trim(F.regexp_extract(name, r"^([^?/#]*)", 1))
    return F.when(name.rlike("^[A-Za-z0-9_]{5,32}$"), name)


def channel_keywords(query: Column | str) -> Column:
    """Words behind the channel, else its link's own ``q`` parameter."""
    words = F.array_join(F.slice(F.split(F.trim(col(query)), r"\s+"), 2, 1000), " ")
    own = F.trim(F.try_url_decode(F.regexp_extract(F.get(F.split(F.trim(col(query)), r"\s+"), F.lit(0)), r"[?&]q=([^&]*)", 1)))
    return F.coalesce(F.nullif(words, F.lit("")), F.nullif(own, F.lit("")))


def parse_region(region: Column | str) -> Column:
    """struct(country, language, script) of a lone country or language, or language-Script-country."""
    tags = F.filter(F.split(F.lower(F.replace(F.trim(col(region)), F.lit("_"), F.lit("-"))), "-"), lambda x: x != "")
    first, second, third = (F.get(tags, F.lit(i)) for i in range(3))
    language = first.rlike("^[a-z]{2,3}$")
    script = second.rlike("^[a-z]{4}$")
    is_country = lambda x: x.rlike("^([a-z]{2}|[0-9]{3})$")
    own = F.when(script, third).otherwise(second)
    found = F.get(F.filter(tags, is_country), F.lit(0))
    single = F.size(tags) == 1
    text = F.lit(None).cast("string")
    return F.struct(
        F.when(single, F.when(first.isin(*COUNTRIES), first)).when(language, F.when(is_country(own), own)).otherwise(found).alias("country"),
        F.when(single, F.when(language & ~first.isin(*COUNTRIES), first)).when(language, first).otherwise(text).alias("language"),
        F.when(~single & language & script, F.initcap(second)).alias("script"),
    )


def ddg_region(region: Column | str) -> Column:
    """country-language as the web engine spells it; null without a usable country."""
    loc = parse_region(region)
    country, language = loc["country"], loc["language"]
    implied = F.try_element_at(F.create_map(*(F.lit(x) for pair in REGION_LANGUAGES.items() for x in pair)), country)
    traditional = (language == "zh") & (country.isin("hk", "tw") | F.coalesce(loc["script"] == "Hant", F.lit(False)))
    spelled = F.when(language == "ja", "jp").when(language == "ko", "kr").when(traditional, "tzh").otherwise(language)
    place = F.when(country == "gb", "uk").otherwise(country)
    return (
        F.when((country == "419") & (language == "es"), "xl-es")
        .when(language.isNotNull() & (F.length(country) == 2), F.concat(place, F.lit("-"), spelled))
        .when(language.isNull() & implied.isNotNull(), F.concat(place, F.lit("-"), implied))
    )


def bing_country(region: Column | str) -> Column:
    country = parse_region(region)["country"]
    return F.when(country.rlike("^[a-z]{2}$"), country)


def bing_language(region: Column | str) -> Column:
    return parse_region(region)["language"]


def wiki_language(lang: Column | str) -> Column:
    """The edition's host label: the primary subtag in lower case, English if malformed."""
    primary = F.lower(F.substring_index(F.replace(F.trim(col(lang)), F.lit("_"), F.lit("-")), "-", 1))
    return F.when(primary.rlike("^[a-z]{2,12}$"), primary).otherwise("en")


def robots_regex(pattern: Column | str) -> Column:
    """A robots pattern as a regular expression: ``*`` is anything, a last ``$`` the end."""
    p = col(pattern)
    body = F.regexp_replace(p, r"\$$", "")
    quoted = F.regexp_replace(F.regexp_replace(body, r"([\\.+?()\[\]{}^$|])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("(?s)^"), quoted, F.when(p.endswith("$"), F.lit(r"\z")).otherwise(F.lit("")))


def robots_match(pattern: Column | str, path: Column | str) -> Column:
    return F.regexp_like(col(path), robots_regex(pattern))


def normal_path(path: Column | str) -> Column:
    """A path spelled as robots patterns are: escapes in upper case, characters beyond ASCII escaped."""
    plain = F.array_join(F.transform(F.split(col(path), ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.url_encode(c)).otherwise(c)), "")
    parts = F.split(F.when(col(path).rlike(r"[^\x00-\x7F]"), plain).otherwise(col(path)), "(?=%[0-9a-fA-F]{2})")
    upper = F.transform(parts, lambda x: F.when(x.rlike("^%[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(x, 1, 3)), F.substring(x, 4, 1 << 30))).otherwise(x))
    return F.when(col(path).rlike(r"%[0-9a-fA-F]{2}|[^\x00-\x7F]"), F.array_join(upper, "")).otherwise(col(path))


def encode_robots_text(s: str) -> str:
    """Escapes in upper case, bytes over 0x7F escaped."""
    out = re.sub(r"%([0-9a-fA-F]{2})", lambda m: "%" + m[1].upper(), s)
    return "".join(c if ord(c) < 128 else "".join(f"%{b:02X}" for b in c.encode()) for c in out)


def parse_robots_text(body: str) -> list[tuple[str, bool]]:
    """(pattern, allow) of the groups that bind every agent, in order. Of a body over ROBOTS_MOST bytes
    only the whole lines before that are read."""
    out, ours, naming = [], False, False
    data = body.encode()
    if len(data) > ROBOTS_MOST:
        body = data[: data.rfind(b"\n", 0, ROBOTS_MOST) + 1].decode()
    for line in body.lstrip("﻿").split("\n"):
        key, colon, value = line.split("#", 1)[0].strip().partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            ours = (ours if naming else False) or value == "*"
            naming = True
            continue
        naming = False
        if key in ("allow", "disallow") and ours and value:
            out.append((encode_robots_text(value), key == "allow"))
    return out


@vectorised("array<struct<pattern:string,allow:boolean>>")
def parse_robots(s: pd.Series) -> pd.Series:
    return s.map(lambda b: [{"pattern": p, "allow": a} for p, a in parse_robots_text(b or "")])


def safe_link_text(href: str, base: str | None) -> str | None:
    """An http(s) link without credentials, joined to its base, safe inside markdown."""
    href = href.strip()
    if not href:
        return None
    try:
        full = href if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href) else (urljoin(base, href) if base else "")
        p = urlsplit(full)
        if p.scheme not in ("http", "https") or not p.hostname or "@" in p.netloc:
            return None
        full = urlunsplit((p.scheme, p.netloc.lower(), p.path or "/", p.query, p.fragment))
    except ValueError:
        return None
    return full.replace("\\", "%5C").replace("(", "%28").replace(")", "%29").replace(" ", "%20")
