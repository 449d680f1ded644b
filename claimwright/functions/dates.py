"""Publication dates that a document states of itself, by where it says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimwright.functions.names import partial_date

# How dates are written, and the keys and fields that hold them.
DATE = r"^\s*(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?(?![\d:])"
META_KEYS = (
    "article:published_time", "datepublished", "og:published_time", "publish-date", "publish_date", "publishdate", "date", "dc.date", "dc.date.issued",
    "citation_date", "citation_online_date", "citation_publication_date",
)
RECORD_FIELDS = ("firstPublicationDate", "pubYear")
NOT_THE_ARTICLE = ("WebSite", "Organization", "WebPage")
ARXIV = "arxiv identifier (month of first version)"

_NONE = "array<struct<basis:string,value:string>>"
_JSON_LD = r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""
_META = r"(?is)<meta\b[^>]*>"
_SILENT = r"(?is)<!--.*?-->|<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>"


def date_value(text: Column) -> Column:
    """The date that a value begins with, at its resolution; null for none or an impossible one."""
    part = lambda i: F.nullif(F.regexp_extract(text, DATE, i), F.lit("")).cast("int")
    return F.when(text.rlike(DATE), partial_date(part(1), part(2), part(3)))


def _stated(basis: Column | str, values: Column) -> Column:
    of = basis if isinstance(basis, Column) else F.lit(basis)
    found = F.transform(values, lambda v: F.struct(of.alias("basis"), date_value(v).alias("value")))
    return F.coalesce(F.filter(found, lambda x: x["value"].isNotNull()), F.array().cast(_NONE))


def _list(text: Column) -> Column:
    """The members of a JSON list, each as it is written; a document that is no list is one member."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))


def _json_ld(html: Column) -> Column:
    scripts = F.regexp_extract_all(html, F.lit(_JSON_LD), F.lit(1))
    tops = F.flatten(F.filter(F.transform(scripts, _list), lambda x: x.isNotNull()))
    graph = lambda d: F.coalesce(F.from_json(F.get_json_object(d, "$['@graph']"), "array<string>"), F.array().cast("array<string>"))
    items = F.flatten(F.transform(tops, lambda d: F.concat(F.array(d), graph(d))))
    kinds = lambda d: F.coalesce(F.transform(_list(F.coalesce(F.get_json_object(d, "$['@type']"), F.lit(""))), lambda k: F.replace(k, F.lit('"'), F.lit(""))), F.array().cast("array<string>"))
    articles = F.filter(items, lambda d: d.isNotNull() & ~F.exists(kinds(d), lambda k: k.isin(*NOT_THE_ARTICLE)))
    return _stated("json-ld datePublished", F.filter(F.transform(articles, lambda d: F.get_json_object(d, "$.datePublished")), lambda v: v.isNotNull()))


def _attribute(tag: Column, name: str) -> Column:
    """A tag's attribute, in any order and quotes; null without it."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(pattern), F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))))


def _meta(html: Column) -> Column:
    # a card in the body cannot date the page, nor can a tag that a script writes
    head = F.regexp_extract(F.regexp_replace(html, _SILENT, " "), r"(?is)^(.*?)(?:</head\b|<body\b|\z)", 1)
    tags = F.regexp_extract_all(head, F.lit(_META), F.lit(0))
    read = F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(*(_attribute(t, a) for a in ("property", "name", "itemprop")))).alias("key"), _attribute(t, "content").alias("value")))
    dated = F.filter(read, lambda r: F.coalesce(r["key"].isin(*META_KEYS), F.lit(False)))
    found = F.transform(dated, lambda r: F.struct(F.when(r["key"].startswith("citation"), "citation meta").otherwise("meta tag").alias("basis"), date_value(r["value"]).alias("value")))
    return F.filter(found, lambda x: x["value"].isNotNull())


def _only(values: Column) -> Column:
    """A record's own value, where there is exactly one: a list of many papers dates none."""
    return F.when(F.size(values) == 1, values).otherwise(F.array().cast("array<string>"))


def _jats(xml: Column) -> Column:
    meta = F.regexp_extract(xml, r"(?s)<(?:\w+:)?article-meta\b[^>]*>(.*?)</(?:\w+:)?article-meta\s*>", 1)
    days = F.regexp_extract_all(meta, F.lit(r"(?s)<(?:\w+:)?pub-date\b[^>]*>(.*?)</(?:\w+:)?pub-date\s*>"), F.lit(1))
    part = lambda d, k: F.nullif(F.regexp_extract(d, rf"<(?:\w+:)?{k}\b[^>]*>\s*(\d+)\s*</", 1), F.lit(""))

    def day(d: Column) -> Column:
        year, month = part(d, "year"), part(d, "month")
        return F.concat_ws("-", year, F.when(year.isNotNull(), month), F.when(month.isNotNull(), part(d, "day")))

    return _stated("jats pub-date", F.transform(days, day))


def _records_xml(xml: Column) -> list[Column]:
    return [_stated(f"record {k}", _only(F.regexp_extract_all(xml, F.lit(rf"<(?:\w+:)?{k}\b[^>]*>([^<]*)</"), F.lit(1)))) for k in RECORD_FIELDS]


def _records_json(text: Column) -> list[Column]:
    results = F.coalesce(F.from_json(F.get_json_object(text, "$.resultList.result"), "array<string>"), F.array().cast("array<string>"))
    records = F.concat(F.array(text), results)

    def values(field: str) -> Column:
        return F.filter(F.transform(records, lambda r: F.get_json_object(r, f"$.{field}")), lambda v: v.isNotNull())

    return [_stated(f"record {k}", _only(values(k))) for k in RECORD_FIELDS]


def date_candidates(text: Column, kind: Column, url: Column) -> Column:
    """array<struct(basis, value)>: all dates that a document states of itself, in the order of where it does.

    ``kind`` is that of ``bodies.kind_of``; impossible dates are dropped.  A PDF's is
    read where its information is not compressed.
    """
    none = F.array().cast(_NONE)
    created = F.regexp_extract(text, r"/CreationDate\s*\(D:(\d{4})(\d{2})(\d{2})", 0)
    pdf = _stated("pdf:creationdate", F.array(F.regexp_replace(created, r"^.*D:(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")))
    number = F.regexp_extract(url, r"^https?://(?:[^/@]*\.)?arxiv\.org/(?:abs|html|pdf)/(\d{4})\.\d{4,5}", 1)
    arxiv = _stated(ARXIV, F.array(F.when(number != "", F.concat(F.lit("20"), F.left(number, F.lit(2)), F.lit("-"), F.right(number, F.lit(2))))))
    of_kind = F.when(kind == "pdf", pdf).when(kind == "html", F.concat(_json_ld(text), _meta(text))).when(kind == "xml", F.concat(_jats(text), *_records_xml(text))).when(kind == "json", F.concat(*_records_json(text)))
    return F.concat(F.coalesce(of_kind, none), F.coalesce(arxiv, none))
