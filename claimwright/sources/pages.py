"""Web pages as they are: text by element with its path, what a reader sees, and what the blocks state.

The tags of a page are read once, with a stack of what is open.  An element's
block is the text that stands directly in it.  Paths are steps from the root; a step is numbered
where its parent has several of its kind.  Scripts, styles and the like are
left out with all they hold; for the visible text hidden elements are, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from claimwright.functions.scalars import employee_statements, founded_years
from claimwright.functions.website import stated_groups, stated_identifiers, stated_people, stated_towns

# Elements without an end, those whose content is not text, and what a new element ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript svg template".split())
ENDS = {"p": {"p"}, "div": {"p"}, "ul": {"p"}, "ol": {"p"}, "table": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, **{f"h{n}": {"p"} for n in range(1, 7)}}
CHARSET = re.compile(rb"""<meta[^>]+charset=["']?\s*([\w-]+)""", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)|font-size\s*:\s*0(?:px|em|rem|%)?\s*(?:;|$)|(?:left|top)\s*:\s*-\d{3,}px", re.IGNORECASE)
BLOCKS = ArrayType(StructType([StructField(n, StringType()) for n in ("text", "tag", "path")]))


class Tree(HTMLParser):
    """Elements (tag, parent, text parts, silent, hidden) in order, and the visible text."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, int, list[str], bool, bool]] = []
        self.open: list[int] = []
        self.shown: list[str] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.open and self.elements[self.open[-1]][0] in ENDS.get(tag, ()):
            self.open.pop()
        above = self.open[-1] if self.open else -1
        silent, hidden = (self.elements[above][3:5] if above >= 0 else (False, False))
        has = dict(attrs)
        hidden = hidden or "hidden" in has or has.get("aria-hidden") == "true" or bool(HIDDEN.search(has.get("style") or ""))
        self.elements.append((tag, above, [], silent or tag in SILENT, hidden))
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        at = next((k for k in reversed(range(len(self.open))) if self.elements[self.open[k]][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if not self.open:
            self.shown.append(data)
            return
        _, _, parts, silent, hidden = self.elements[self.open[-1]]
        if not silent:
            parts.append(data)
            if not hidden:
                self.shown.append(data)

    def path(self, k: int, counts: dict, numbers: list[int]) -> str:
        steps = []
        while k >= 0:
            tag, above = self.elements[k][:2]
            steps.append(f"{tag}[{numbers[k]}]" if counts[above, tag] > 1 else tag)
            k = above
        return "/" + "/".join(reversed(steps))

    def blocks(self) -> list[dict[str, str]]:
        counts: dict[tuple[int, str], int] = {}
        numbers = []
        for tag, above, *_ in self.elements:
            counts[above, tag] = counts.get((above, tag), 0) + 1
            numbers.append(counts[above, tag])
        out = []
        for k, (tag, _, parts, silent, _) in enumerate(self.elements):
            text = " ".join(" ".join(p for p in parts if p.strip()).split())
            if len(text) >= 2 and not silent:
                out.append({"text": text, "tag": tag, "path": self.path(k, counts, numbers)})
        return out


def page_string(body: bytes) -> str:
    """A page's characters: by the charset that it declares, else UTF-8, else the Western code page."""
    said = CHARSET.search(body[:4096])
    for name in [*([said.group(1).decode("ascii", "ignore")] if said else []), "utf-8", "cp1252"]:
        try:
            return body.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("utf-8", errors="replace")


#: Pages whose blocks a worker holds at once.
PAGES_AT_ONCE = 100


def _blocks_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for bodies in batches:
        for at in range(0, len(bodies), PAGES_AT_ONCE):
            yield bodies.iloc[at : at + PAGES_AT_ONCE].map(lambda b: Tree(page_string(bytes(b))).blocks() if b is not None else [])


@F.pandas_udf(BLOCKS)
def element_blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """(text, tag, path) of each element with text of its own, of two characters or more, in the order in which elements begin."""
    return _blocks_of(batches)


@F.pandas_udf(StringType())
def visible_text(bodies: pd.Series) -> pd.Series:
    """What a reader of a page is shown, white space collapsed; null for no page."""
    return bodies.map(lambda b: " ".join("".join(Tree(page_string(bytes(b))).shown).split()) if b is not None else None)


# What can contradict what a page says of its owner.
CHECKS = {"claims_identifier": "has_name", "founded_on": "founded_on", "has_role": "has_role", "employs": "employs", "has_location": "registered_at", "member_of_group": "owns"}
PATTERNS = {"claims_identifier": "cvr_context_checksum", "founded_on": "founded_keyword_year", "member_of_group": "group_phrase", "has_location": "dk_postcode_town", "has_role": "name_role_adjacent"}
CONFIDENCE = {"member_of_group": 0.6, "has_location": 0.7, "has_role": 0.6}


def statements_of(text: Column, longest: int = 8) -> Column:
    """array<struct(predicate, object, pattern, role, distance)>: all that a block states, in the order of the predicates of ``CHECKS`` as pages are read.

    Company numbers have eight digits, or up to ``longest``.
    """
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")

    def plain(predicate: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(predicate).alias("predicate"), v.cast("string").alias("object"), F.lit(PATTERNS[predicate]).alias("pattern"), none.alias("role"), no_number.alias("distance")))

    counts = F.transform(employee_statements(text), lambda e: F.struct(F.lit("employs").alias("predicate"), e["n"].cast("string").alias("object"), e["pattern"].alias("pattern"), none.alias("role"), no_number.alias("distance")))
    people = F.transform(stated_people(text), lambda p: F.struct(F.lit("has_role").alias("predicate"), p["name"].alias("object"), F.lit(PATTERNS["has_role"]).alias("pattern"), p["role"].alias("role"), p["distance"].alias("distance")))
    years = F.transform(founded_years(text), lambda y: F.make_date(y, F.lit(1), F.lit(1)))
    return F.concat(plain("claims_identifier", stated_identifiers(text, longest)), plain("founded_on", years), counts, plain("member_of_group", stated_groups(text)), plain("has_location", stated_towns(text)), people)


def page_statements(pages: DataFrame, key: str = "page_id", body: str = "body", longest: int = 8) -> DataFrame:
    """key, predicate, object, pattern, role, distance, element, source_text, tier, confidence, checks_against: each (predicate, object) of a page once, as it is first stated.

    A page is parsed and its blocks are read in one pass.  Rows that share a key are one page.
    """
    blocks = pages.select(key, F.posexplode(element_blocks(F.col(body).cast("binary"))).alias("b_at", "b"))
    said = blocks.select(key, "b_at", "b.text", "b.path", F.posexplode(statements_of(F.col("b.text"), longest)).alias("s_at", "s"))
    first = F.min(F.struct("b_at", "s_at", F.col("s.pattern").alias("pattern"), F.col("s.role").alias("role"), F.col("s.distance").alias("distance"), F.col("path").alias("element"), F.substring("text", 1, 300).alias("source_text")))
    once = said.groupBy(key, F.col("s.predicate").alias("predicate"), F.col("s.object").alias("object")).agg(first.alias("x"))
    of = lambda values: F.create_map(*(F.lit(v) for kv in values.items() for v in kv))[F.col("predicate")]
    return once.select(key, "predicate", "object", *(f"x.{c}" for c in ("pattern", "role", "distance", "element", "source_text")), F.lit("self_declared").alias("tier"), F.coalesce(of(CONFIDENCE), F.lit(1.0)).alias("confidence"), of(CHECKS).alias("checks_against"))
