"""Column functions over identifiers, names, dates, numbers and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check weights of the eight-digit company number.
WEIGHTS = (2, 7, 6, 5, 4, 3, 2, 1)
# Letters that do not decompose, and their usual spelling.
SPELLED = (("æ", "ae"), ("ø", "oe"), ("å", "aa"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
# Second-level labels under which names are registered one level deeper.
SECOND_LEVEL = ("co", "com", "org", "ac", "gov", "net")
TRACKING = r"^(utm_.*|fbclid|gclid|ref|mc_.*)$"


def valid_company_number(number: Column) -> Column:
    """Weighted digit sum divisible by 11, after padding to eight digits; longer or non-digit values fail."""
    padded = F.lpad(number, 8, "0")
    total = sum((F.substring(padded, i + 1, 1).try_cast("int") * w for i, w in enumerate(WEIGHTS)), F.lit(0))
    return F.when(number.rlike("^[0-9]{1,8}$"), total % 11 == 0).otherwise(False)


def normal_identifier(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))


def spelled_out(x: Column) -> Column:
    out = F.lower(x)
    for letter, spelling in SPELLED:
        out = F.replace(out, F.lit(letter), F.lit(spelling))
    return out


def core_tokens(name: Column, noise: tuple[str, ...]) -> Column:
    """Sorted distinct tokens of a name, without single letters and noise words."""
    tokens = F.split(F.regexp_replace(spelled_out(name), "[^a-z0-9]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*noise))))


def continuous(a: Column, b: Column) -> Column:
    """One non-empty token set holds the other."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def normal_text(x: Column) -> Column:
    """Hyphenated line breaks joined, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.replace(x, F.lit("-\n"), F.lit("")), r"\s+", " ")))


def contains_quote(text: Column, quote: Column) -> Column:
    return F.contains(normal_text(text), normal_text(quote))


def share_of(x: Column) -> Column:
    """Exact decimal share with either decimal mark, or null."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("decimal(18,8)")


def day_of(x: Column) -> Column:
    """Date from YYYY-MM-DD, YYYYMMDD or DD.MM.YYYY; null if it is none."""
    parse = lambda fmt: F.try_to_date(x, fmt)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")).when(x.rlike(r"^\d{8}$"), parse("yyyyMMdd")).when(x.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), parse("dd.MM.yyyy"))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")


def registered_domain(host: Column) -> Column:
    """The last two labels, three under the usual second-level labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    deep = (n > 2) & F.element_at(labels, F.greatest(F.lit(1), n - 1)).isin(*SECOND_LEVEL)
    take = F.when(deep, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), n - take + 1), take), ".")


def canonical_url(url: Column) -> Column:
    """Scheme, registered domain, path without a closing slash, and the query without tracking parameters."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING))
    return F.concat(scheme, F.lit("://"), registered_domain(host_of(url)), path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags dropped, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


# How a page states its founding year and its headcount.
FOUNDED = r"(?i)\b(?:grundlagt|etableret|stiftet|founded|established|since|siden|est\.?)\b[^.\n]{0,24}?\b((?:18|19|20)\d{2})\b"
EMPLOYEES = r"(?i)\b(\d{1,3}(?:[.\s]\d{3})*|\d{1,5})\s*\+?\s*\b(?:medarbejdere|ansatte|employees|people|kolleger|specialister)\b"
EMPLOYEES_REV = r"(?i)\b(?:medarbejdere|ansatte|employees|team\s+of)\b[^.\n]{0,12}?\b(\d{1,5})\b"


def founded_years(text: Column) -> Column:
    """Distinct plausible years near a founding word, in the order of the text."""
    years = F.transform(F.regexp_extract_all(text, F.lit(FOUNDED), F.lit(1)), lambda y: y.try_cast("int"))
    return F.array_distinct(F.filter(years, lambda y: (y > 1600) & (y < 2100)))


def employee_statements(text: Column) -> Column:
    """array<struct(n, pattern)>: plausible headcounts, those before the noun, then those after it."""

    def counts(pattern: str, name: str) -> Column:
        numbers = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.regexp_replace(n, r"[.\s]", "").try_cast("int"))
        return F.transform(F.filter(numbers, lambda n: (n > 0) & (n < 500_000)), lambda n: F.struct(n.alias("n"), F.lit(name).alias("pattern")))

    return F.concat(counts(EMPLOYEES, "count_then_noun"), counts(EMPLOYEES_REV, "noun_then_count"))


def employee_counts(text: Column) -> Column:
    """Distinct plausible headcounts: those before the noun, then those after it."""
    return F.array_distinct(F.transform(employee_statements(text), lambda e: e["n"]))


def founded_year(text: Column) -> Column:
    """The first plausible year."""
    return F.get(founded_years(text), F.lit(0))


def employee_count(text: Column) -> Column:
    """The first plausible headcount."""
    return F.get(employee_counts(text), F.lit(0))


# Words that tie a statement to an implicit now, report, negate or hedge.
INDEXICAL = r"\b(currently|now|today|tonight|yesterday|tomorrow|recently|lately|nowadays|presently|at present|these days|no longer|anymore|in recent years|this (year|month|week|quarter)|last (year|month|week|quarter)|next (year|month|week|quarter)|ago|so far|to date|still)\b"
NEGATION = r"(?i)\b(not|never|none|neither|nor|without|denie[sd]|deny|untrue|false that|failed to|refused|ceased)\b|n't"
REPORTING = r"(?i)\b(says?|said|according to|claims? that|claimed|alleged(ly)?|denie[sd]|deny|reported(ly)?|stated|told|argues?|argued|believes?|believed|wrote|writes|announced|confirmed|insists?|rumou?red|seen by|understood to)\b"
HEDGE = r"\b(may|might|could|possibly|probably|likely|approximately|roughly|reputedly|estimated?|appears?|seems?|suggests?|about \d|around \d)"


def text_flags(text: Column) -> dict[str, Column]:
    return {name: text.rlike(pattern) for name, pattern in (("indexical", INDEXICAL), ("negation", NEGATION), ("reporting", REPORTING), ("hedge", HEDGE))}


def is_wall(text: Column, short: int = 3000, least: int = 100) -> Column:
    """Why a page is not a document: ``wall``, ``empty`` or null."""
    marks = r"(?i)(captcha|are you a robot|enable javascript|access denied|checking your browser|verify you are human)"
    return F.when((F.length(text) < short) & text.rlike(marks), "wall").when(F.length(text) < least, "empty")


# Adverse composite states.
ADVERSE = "TVANGSOPLØS|KONKURS"


def is_adverse(status: Column) -> Column:
    return F.coalesce(F.replace(F.upper(status), F.lit(" "), F.lit("")).rlike(ADVERSE), F.lit(False))


# Bulk mail providers and their hosts.
PROVIDERS = (
    ("google", r"(?i)(?:aspmx|googlemail|google)\.com$"),
    ("microsoft", r"(?i)(?:(?:outlook|protection\.outlook|office365|hotmail)\.com|mx\.microsoft)$"),
    ("one.com", r"(?i)one\.com$"),
    ("simply.com", r"(?i)(?:simply|unoeuro)\.com$"),
    ("dandomain", r"(?i)dandomain\.dk$"),
    ("gigahost", r"(?i)gigahost\.dk$"),
    ("curanet", r"(?i)(?:curanet|scannet)\.dk$"),
    ("mailprotect", r"(?i)mailprotect\.[a-z.]+$"),
    ("zoho", r"(?i)zoho(?:cloud)?\.(?:com|eu)$"),
    ("proofpoint", r"(?i)pphosted\.com$"),
    ("mimecast", r"(?i)mimecast\.com$"),
    ("hostnordic", r"(?i)hostnordic\.com$"),
)


def mail_provider(hosts: Column) -> Column:
    """Provider of the first host (sorted) that any pattern names; none without hosts, else other.  Hosts may end in a dot."""
    named = F.transform(F.array_sort(F.transform(hosts, lambda h: F.rtrim(h, F.lit(".")))), _provider)
    first = F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.coalesce(F.size(hosts), F.lit(0)) == 0, "none").otherwise(F.coalesce(first, F.lit("other")))


def _provider(host: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PROVIDERS):
        out = F.when(host.rlike(pattern), name).otherwise(out)
    return out
