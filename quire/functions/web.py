"""Web pages and addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.basics import blank, let

#: Named entities that metadata texts use.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "micro": "µ", "ndash": "–", "mdash": "—",
    "times": "×", "plusmn": "±", "deg": "°", "copy": "©", "reg": "®", "alpha": "α", "beta": "β", "gamma": "γ", "mu": "μ",
    "Omega": "Ω", "omega": "ω", "le": "≤", "ge": "≥", "minus": "−",
}
#: Parameters of addresses whose values are secret.
SECRET_PARAMETERS = ("key", "apikey", "api_key", "token", "access_token", "client_secret", "ttbkey", "cert_key")
#: Phrases of pages that ask for proof of not being a robot, and signs of a record or of results.
CHALLENGES = (
    "captcha", "just a moment", "attention required", "access denied", "cf-browser-verification", "cf_chl_", "verify you are human", "unusual traffic",
    "비정상적인 접근", "접근이 제한", "자동 등록 방지", "robot check", "are you a robot", "ddos-guard", "incapsula",
)
LOGINS = ("log in", "login", "sign in", "signin", "로그인", "member login", "authenticate")
RECORD_SIGNS = ("citation_title", "application/ld+json", "dc.title", "isbn")
RESULT_SIGNS = ('id="rso"', 'id="yesschlist"', "data-goods-no=")
ENTITY = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]+);"


def any_of(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a lower-case text has one of the phrases."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def _entity(token: Column) -> Column:
    """The character that an entity stands for; the entity itself if it is unknown, a control character or no character."""
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair)), F.substring(token, F.lit(2), F.char_length(token) - 2))
    hexadecimal = F.regexp_extract(token, "^&#[xX]0*([0-9a-fA-F]{1,6});$", 1)
    decimal = F.regexp_extract(token, "^&#0*([0-9]{1,7});$", 1)
    point = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(decimal).try_cast("int")
    good = (point >= 32) & ~point.between(127, 159) & ~point.between(0xD800, 0xDFFF) & (point <= 0x10FFFF)
    return F.coalesce(F.when(good, F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")), named, token)


def decode_entities(text: Column, passes: int = 3) -> Column:
    """Entities as characters, also those that come to light when others are decoded, ``passes`` deep."""

    def once(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)), _entity)
        woven = F.flatten(F.transform(F.arrays_zip(F.split(t, ENTITY, -1), found), lambda x: F.array(x["0"], F.coalesce(x["1"], F.lit("")))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(woven, "")).otherwise(t)

    for _ in range(passes):
        text = let(text, once)
    return text


def visible_text(html: Column) -> Column:
    """What a reader of a page sees: no scripts, styles or tags, blocks on lines of their own."""
    text = blank(html)
    for tag in ("script", "style", "noscript"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|p|div|li|tr|td|th|h[1-6]|dt|dd|section|article)\b[^>]*>", "\n")
    text = decode_entities(F.regexp_replace(text, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t ]+", " "), r"[ \t\r\n]*\n[ \t\r\n]*", "\n"), F.lit(" \n"))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(blank(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_tags(html: Column) -> Column:
    """The names or properties of a page's meta tags, in lower case, in order."""
    found = F.regexp_extract_all(blank(html), F.lit(r"""(?i)<meta\s+[^>]*?(?:name|property)=["']([^"']+)["']"""), F.lit(1))
    return F.transform(found, F.lower)


def links(html: Column) -> Column:
    """The targets of a page's anchors, in order."""
    return F.regexp_extract_all(blank(html), F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))


def host(url: Column) -> Column:
    """The host in lower case, without user, port and closing dot; empty if there is none."""
    authority = F.regexp_extract(F.trim(blank(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(bare), r"\.$", "")


def _octet(address: Column, n: int) -> Column:
    return F.element_at(F.split(address, r"\."), n).try_cast("int")


def is_private_ipv4(name: Column) -> Column:
    """Addresses that are not for the public network."""
    shaped = name.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    a, b, c = (F.when(shaped, _octet(name, n)) for n in (1, 2, 3))
    ranges = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19)) | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return shaped & F.coalesce(ranges, F.lit(False))


def is_private_ipv6(name: Column) -> Column:
    """Bracketed addresses that are local, of a unique local range, multicast, or wrap a private IPv4 address."""
    inner = F.regexp_replace(name, r"^\[|\]$", "")
    local = inner.isin("", "::", "::1") | inner.rlike(r"^f[cd][0-9a-f]{2}:") | inner.rlike(r"^fe[89a-f][0-9a-f]:") | inner.rlike(r"^ff[0-9a-f]{2}:")
    tail = F.regexp_extract(inner, r"^::(?:ffff:)?(\d+\.\d+\.\d+\.\d+)$", 1)
    pair = r"^::(?:ffff:)?([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    words = [F.conv(F.regexp_extract(inner, pair, n), 16, 10).try_cast("int") for n in (1, 2)]
    dotted = F.concat_ws(".", F.floor(words[0] / 256), words[0] % 256, F.floor(words[1] / 256), words[1] % 256)
    wrapped = F.when(inner.rlike(pair), dotted).otherwise("")
    return name.startswith("[") & (local | is_private_ipv4(tail) | is_private_ipv4(wrapped))


def is_external_url(url: Column) -> Column:
    """http or https, with a host, without a user, without control characters."""
    text = blank(url)
    return (
        ~text.rlike(r"[\x00-\x1f\x7f]") & F.trim(text).rlike(r"(?i)^https?://[^/?#]+") & ~F.trim(text).rlike(r"^[^/]*//[^/?#]*@") & (host(url) != "")
    )


def is_public_url(url: Column) -> Column:
    """An external URL whose host is on the public network."""
    name = host(url)
    local = (name == "localhost") | name.endswith(".localhost") | name.endswith(".local") | (name == "home.arpa") | name.endswith(".home.arpa")
    return is_external_url(url) & ~local & ~is_private_ipv4(name) & ~is_private_ipv6(name)


def redact_url(url: Column) -> Column:
    """A URL with the values of secret parameters masked."""
    return F.regexp_replace(blank(url), rf"(?i)([?&](?:{'|'.join(SECRET_PARAMETERS)})=)[^&#]*", "$1***")


def title_from_slug(url: Column) -> Column:
    """A title from the last part of a path, if it is three words or more; else empty."""
    path = F.element_at(F.split(F.regexp_replace(blank(url), r"^https?://[^/]+", ""), "[?#]"), 1)
    slug = F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), r"\.\w{2,5}$", "")
    parts = F.filter(F.split(slug, "[-_+]"), lambda w: w != "")
    good = (F.size(parts) >= 3) & F.forall(parts, lambda w: w.rlike(r"^[\p{L}\d][\p{L}\d'’]*$")) & F.exists(parts, lambda w: w.rlike(r"^\p{L}{3,}$"))
    sentence = F.array_join(parts, " ")
    return F.when(good, F.concat(F.upper(F.substring(sentence, 1, 1)), F.substring(sentence, F.lit(2), F.char_length(sentence)))).otherwise("")


def is_challenge(html: Column) -> Column:
    """A page that asks for proof of not being a robot, by its start: 20 000 characters, as the reading of such pages is defined."""

    def of(head: Column) -> Column:
        title = F.lower(F.regexp_extract(head, r"(?i)<title>([^<]*)</title>", 1))
        low = F.lower(head)
        book = head.rlike(r"""(?i)og:type["']\s+content=["']book""")
        return ~(any_of(low, RECORD_SIGNS + RESULT_SIGNS) | book) & (any_of(title, CHALLENGES) | any_of(low, CHALLENGES))

    return let(F.left(blank(html), F.lit(20000)), of)


def is_login_wall(html: Column) -> Column:
    """A page whose title asks to log in and that has a field for a password, by its first 40 000 characters."""

    def of(head: Column) -> Column:
        low = F.lower(head)
        title = F.regexp_extract(low, r"<title>([^<]*)</title>", 1)
        book = head.rlike(r"""(?i)og:type["']\s+content=["']book""")
        return ~(any_of(low, RECORD_SIGNS) | book) & any_of(title, LOGINS) & low.rlike(r"""<input[^>]+type\s*=\s*["']?password""")

    return let(F.left(blank(html), F.lit(40000)), of)


def fetch_kind(status: Column, body: Column, timed_out: Column, expect: str = "html") -> Column:
    """The outcome of a request: one of nine kinds, the first that applies."""
    text = blank(body)
    good = {
        "json": F.trim(text).rlike(r"^[{\[]") & F.try_parse_json(F.trim(text)).isNotNull(),
        "xml": text.rlike(r"(?i)^\s*<(?:\?xml|feed\b|rss\b)"),
    }.get(expect, F.lit(False))
    shaped = {
        "json": good,
        "xml": good | text.rlike(r"(?i)<(?:feed\b|rss\b|[a-z])"),
        "html": F.left(text, F.lit(5000)).rlike(r"(?i)<(?:html|head|body|meta|title)"),
        "any": F.lit(True),
    }[expect]
    return (
        F.when(timed_out, "timeout")
        .when(F.coalesce(status, F.lit(0)) == 0, "serverError")
        .when(status.isin(401, 407), "authRequired")
        .when(status == 403, F.when(is_login_wall(body), "authRequired").otherwise("blocked"))
        .when(status == 429, "rateLimited")
        .when(status.isin(404, 410), "noMatch")
        .when(status >= 500, "serverError")
        .when(status >= 300, "rejected")
        .when(good, "record")
        .when(is_challenge(body), "blocked")
        .when(is_login_wall(body), "authRequired")
        .when(~shaped, "parseError")
        .otherwise("record")
    )
