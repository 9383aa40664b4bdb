"""URL and markup screening as regular expressions.

The patterns stay inside the common subset of java.util.regex and RE2.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard import constants as K

HANDLER_ATTR = (
    r"(?i)\s(?:[\w.-]+:)?(?:" + "|".join(K.EVENT_HANDLERS) + r")\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
)
DATA_HTML_ATTR = (
    r"\s[\w:.-]*(?i:href)[\w:.-]*\s*=\s*"
    r"(?:\"\s*data:[^\"]*(?i:text/html)[^\"]*\"|'\s*data:[^']*(?i:text/html)[^']*')"
)
EXTERNAL_HREF_ATTR = (
    r"\s[\w:.-]*(?i:href)[\w:.-]*\s*=\s*(?:\"\s*https?://[^\"]*\"|'\s*https?://[^']*')"
)
DANGEROUS_OPEN = r"(?i)<(?:[\w.-]+:)?(?:" + "|".join(K.DANGEROUS_ELEMENTS) + r")[\s/>]"
DANGEROUS_WHOLE = [
    rf"(?is)<(?:[\w.-]+:)?{name}(?:\s[^>]*)?/>|<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>.*?</(?:[\w.-]+:)?{name}\s*>"
    for name in K.DANGEROUS_ELEMENTS
]
USE_TAG = r"(?i)^<(?:[\w.-]+:)?use[\s/>]"
STYLE_TAG = r"(?i)^<(?:[\w.-]+:)?style(?:\s[^>]*)?>$"
CSS_IMPORT = r"@import\s+url\s*\([^)]*\)\s*;?"
TOKENS = r"<[^<>]*>|[^<]+|<"

URL_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- ids ------------------------------------------------------------------------


def extract_format(case_id: str | Column) -> Column:
    """Format token of ``<name>.<fmt>@<preset>``: before the first @, after the last dot."""
    left = F.substring_index(_c(case_id), "@", 1)
    return F.when(F.contains(left, F.lit(".")), F.lower(F.substring_index(left, ".", -1))).otherwise(
        "unknown"
    )


def case_id(name: Column, fmt: Column, preset: Column) -> Column:
    return F.concat(_c(name), F.lit("."), _c(fmt), F.lit("@"), _c(preset))


# --- URLs -----------------------------------------------------------------------


def url_scheme(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(_c(url), URL_SCHEME, 1))


def url_host(url: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(_c(url), URL_HOST, 1), r"[\[\]]", ""))


def ipv4_number(ip: str | Column) -> Column:
    """IPv4 text as a number, NULL for anything else."""
    parts = F.split(_c(ip), r"\.")
    octet = [F.get(parts, F.lit(i)).cast("bigint") for i in range(4)]
    number = octet[0] * 2**24 + octet[1] * 2**16 + octet[2] * 2**8 + octet[3]
    return F.when(F.regexp_like(_c(ip), F.lit(IPV4)), number)


def _blocked(version: int, address: Column, plain: Callable[[ipaddress._BaseAddress], object]) -> Column:
    """The blocked networks are literals, so containment is a range test, not a join."""
    hit = F.lit(False)
    for block in map(ipaddress.ip_network, K.BLOCKED_NETWORKS):
        if block.version == version:
            hit = hit | address.between(plain(block.network_address), plain(block.broadcast_address))
    return F.coalesce(hit, F.lit(False))


def blocked_number(number: str | Column) -> Column:
    return _blocked(4, _c(number), int)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(side: Column) -> Column:
    return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))


def _hexadecimal_end(text: Column) -> Column:
    """The text with a dotted IPv4 end written as two groups."""

    def replaced(tail: Column) -> Column:
        halves = F.concat_ws(":", F.lower(F.hex(F.shiftright(tail, 16))), F.lower(F.hex(tail.bitwiseAND(0xFFFF))))
        return F.when(tail.isNotNull(), F.concat(F.regexp_extract(text, r"^(.*:)[^:]*$", 1), halves)).otherwise(text)

    return F.when(F.contains(text, F.lit(".")), _bound(ipv4_number(F.regexp_extract(text, r"^.*:([^:]*)$", 1)), replaced)).otherwise(text)


def _expanded(sides: Column) -> Column:
    """Both sides of ``::`` (or one whole address) as 32 digits."""

    def joined(pair: Column) -> Column:
        head, rest = pair["head"], pair["rest"]
        given = F.size(head) + F.size(rest)
        fits = (F.size(sides) <= 2) & F.when(F.size(sides) == 2, given <= 7).otherwise(given == 8)
        whole = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), rest)
        right = F.forall(whole, lambda g: F.regexp_like(g, F.lit("^[0-9a-f]{1,4}$")))
        return F.when(fits & right, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    return _bound(F.struct(_groups(F.get(sides, F.lit(0))).alias("head"), _groups(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))).alias("rest")), joined)


def ipv6_digits(ip: str | Column) -> Column:
    """IPv6 text as 32 hexadecimal digits: any case, padding, one ``::``, a dotted IPv4 end, a zone
    (which is cut off). NULL for anything else."""
    text = _bound(F.lower(F.regexp_replace(_c(ip), "%.*$", "")), _hexadecimal_end)
    return F.when(F.contains(_c(ip), F.lit(":")), _bound(F.split(text, "::"), _expanded))


def blocked_digits(digits: str | Column) -> Column:
    """Containment by 32 digits; an address that stands for an IPv4 one (::ffff:a.b.c.d) is judged by it."""

    def judged(d: Column) -> Column:
        mapped = F.when(F.startswith(d, F.lit("0" * 20 + "ffff")), F.conv(F.substring(d, 25, 8), 16, 10).cast("bigint"))
        return _blocked(6, d, lambda a: f"{int(a):032x}") | _bound(mapped, blocked_number)

    return F.coalesce(_bound(_c(digits), judged), F.lit(False))


def blocked_ipv6(ip: str | Column) -> Column:
    return blocked_digits(ipv6_digits(ip))


def blocked_ip(ip: str | Column) -> Column:
    """True for private, loopback, link-local and unspecified addresses."""
    return blocked_number(ipv4_number(ip)) | blocked_ipv6(ip)


# --- markup ---------------------------------------------------------------------


def _tags(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(<[^<>]*>)"), F.lit(1)), "\n")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def markup_counts(text: str | Column) -> list[Column]:
    """Threat counts of one markup document; attribute patterns look inside tags only."""
    text = _c(text)
    tags = _tags(text)
    use_tags = F.array_join(
        F.regexp_extract_all(text, F.lit(r"(?i)(<(?:[\w.-]+:)?use[\s/>][^<>]*)"), F.lit(1)), "\n"
    )
    styles = F.array_join(
        F.regexp_extract_all(text, F.lit(r"(?is)<(?:[\w.-]+:)?style(?:\s[^>]*)?>(.*?)</"), F.lit(1)), "\n"
    )
    return [
        count_matches(text, DANGEROUS_OPEN).alias("n_dangerous_elements"),
        count_matches(tags, HANDLER_ATTR).alias("n_event_handlers"),
        count_matches(tags, DATA_HTML_ATTR).alias("n_data_html_hrefs"),
        count_matches(use_tags, EXTERNAL_HREF_ATTR).alias("n_external_use"),
        count_matches(styles, CSS_IMPORT).alias("n_css_imports"),
    ]


def markup_tokens(text: str | Column) -> Column:
    """Tags and the text between them, dangerous elements already gone."""
    text = _c(text)
    for pattern in DANGEROUS_WHOLE:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_extract_all(text, F.lit(f"({TOKENS})"), F.lit(1))


def sanitize_tokens(tokens: str | Column) -> Column:
    """The document put together again without handlers, dangerous hrefs and CSS imports. Pass a
    real column: the lambda looks at the token before, so an inlined expression would be
    evaluated once per token."""
    tokens = _c(tokens)

    def clean(token: Column, i: Column) -> Column:
        tag = F.regexp_replace(F.regexp_replace(token, HANDLER_ATTR, ""), DATA_HTML_ATTR, "")
        tag = F.when(F.regexp_like(token, F.lit(USE_TAG)), F.regexp_replace(tag, EXTERNAL_HREF_ATTR, "")).otherwise(tag)
        after_style = F.regexp_like(F.get(tokens, i - 1), F.lit(STYLE_TAG))
        css = F.when(after_style, F.regexp_replace(token, CSS_IMPORT, "")).otherwise(token)
        return F.when(F.startswith(token, F.lit("<")), tag).otherwise(css)

    return F.array_join(F.transform(tokens, clean), "")


def _local(name: str) -> str:
    return name.rpartition("}")[2].lower()


def clean_tree(root: ET.Element) -> ET.Element:
    """Remove dangerous elements, handlers, hrefs and imports from a parsed document in place."""
    import re

    for parent in root.iter():
        for child in [c for c in parent if _local(c.tag) in K.DANGEROUS_ELEMENTS]:
            parent.remove(child)
    for node in root.iter():
        kind = _local(node.tag)
        for name, value in list(node.attrib.items()):
            value = value.strip()
            href = "href" in name.lower()
            data_html = href and value.startswith("data:") and "text/html" in value.lower()
            outside = href and kind == "use" and value.startswith(("http://", "https://"))
            if _local(name) in K.EVENT_HANDLERS or data_html or outside:
                del node.attrib[name]
        if kind == "style" and node.text:
            node.text = re.sub(CSS_IMPORT, "", node.text)
    return root


@F.pandas_udf(T.StructType([T.StructField("svg", T.StringType()), T.StructField("error", T.StringType())]))
def sanitize_svg(documents: pd.Series) -> pd.DataFrame:
    """Well-formed XML is cleaned; malformed XML, or a reference to an external entity (which the
    standard parser never resolves), gives an error and no document."""

    def one(blob):
        if blob is None:
            return None, None
        try:
            return ET.tostring(clean_tree(ET.fromstring(blob)), encoding="unicode"), None
        except ET.ParseError as problem:
            return None, f"malformed: {problem}"

    return pd.DataFrame([one(d) for d in documents], columns=["svg", "error"], dtype=object)
