"""Register documents (nested JSON) to claims.

One select or explode per field; every version of a field is a claim of its
own, undated ones included, and nothing is merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright import schemas as S
from claimwright.functions.scalars import valid_company_number

_PERIOD = "periode struct<gyldigFra:string,gyldigTil:string>"
_VALUES = f"attributter array<struct<type:string,vaerdier:array<struct<vaerdi:string,{_PERIOD.replace(' ', ':', 1)}>>>>"
_P = _PERIOD.replace(" ", ":", 1)
_A = _VALUES.replace(" ", ":", 1)
# The headcounts of a document, the first stated one counts.
HEADCOUNTS = ("nyesteAarsbeskaeftigelse", "nyesteKvartalsbeskaeftigelse", "nyesteErstMaanedsbeskaeftigelse", "nyesteMaanedsbeskaeftigelse")
_ADDRESSES = f"beliggenhedsadresse:array<struct<vejkode:string,husnummerFra:string,etage:string,sidedoer:string,postnummer:string,kommune:struct<kommuneKode:string>,{_P}>>"
COMPANY = (
    "struct<cvrNummer:bigint,"
    f"virksomhedMetadata:struct<sammensatStatus:string,stiftelsesDato:string,{','.join(f'{k}:struct<antalAnsatte:bigint>' for k in HEADCOUNTS)}>,"
    f"livsforloeb:array<struct<{_P}>>,{_ADDRESSES},hovedbranche:array<struct<branchekode:string,{_P}>>,penheder:array<struct<{_ADDRESSES}>>,"
    f"navne:array<struct<navn:string,{_P}>>,virksomhedsstatus:array<struct<status:string,{_P}>>,"
    f"virksomhedsform:array<struct<langBeskrivelse:string,{_P}>>,hjemmeside:array<struct<kontaktoplysning:string,hemmelig:boolean,{_P}>>,"
    f"elektroniskPost:array<struct<kontaktoplysning:string,hemmelig:boolean,{_P}>>,{_A},"
    "deltagerRelation:array<struct<deltager:struct<enhedsNummer:bigint,enhedstype:string,forretningsnoegle:bigint,navne:array<struct<navn:string>>>,"
    f"organisationer:array<struct<hovedtype:string,organisationsNavn:array<struct<navn:string>>,medlemsData:array<struct<{_P},{_A}>>>>>>>"
)
#: The shapes a stored document may have: bare, a hit, or a whole answer.
WRAPPED = f"Vrvirksomhed {COMPANY}, _source struct<Vrvirksomhed:{COMPANY}>, hits struct<hits:array<struct<Vrvirksomhed:{COMPANY},_source:struct<Vrvirksomhed:{COMPANY}>>>>"

# Attribute types that become claims.
ATTRIBUTES = {
    "REVISION_FRAVALGT": "audit_waived",
    "KAPITAL": "capital_changed",
    "TEGNINGSREGEL": "signing_rule",
    "FORMÅL": "purpose",
    "OMFATTET_AF_LOV_OM_HVIDVASK_OG_TERRORFINANSIERING": "aml_obliged_entity",
    "BØRSNOTERET": "is_listed",
    "GENOPTAGELSE_TVANGSOPLØSNING": "reinstated_after_dissolution",
    "OFFENTLIG_EJERBOG": "publishes_shareholder_register",
    "TILSYN_KATEGORI": "supervisory_category",
    "OPLØSNINGSTRUSSEL_SENESTE": "dissolution_threat",
}
# Organisations whose members have a predicate of their own.
ROLES = {"STIFTERE": "founded_by", "REVISION": "audited_by"}


def unwrapped(documents: DataFrame, col: str = "json") -> DataFrame:
    """A row for each company of a stored document: bare, a hit, a list of either, or an answer with all its hits."""
    # a list reads like the hits of an answer
    text = F.when(F.trim(col).startswith("["), F.concat(F.lit('{"hits":{"hits":'), F.col(col), F.lit("}}"))).otherwise(F.col(col))
    d = documents.withColumn("__d", F.from_json(text, WRAPPED))
    hits = F.transform(F.coalesce("__d.hits.hits", F.array()), lambda h: F.coalesce(h["_source"]["Vrvirksomhed"], h["Vrvirksomhed"]))
    every = F.filter(F.concat(F.array("__d.Vrvirksomhed", "__d._source.Vrvirksomhed"), hits), lambda c: c.isNotNull())
    return d.withColumn("company", F.explode(every)).drop("__d")


def _day(x: Column) -> Column:
    return F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")


def company_key(number: Column) -> Column:
    return F.lpad(number.cast("string"), 8, "0")


def address_key(a: Column) -> Column:
    parts = (a["vejkode"], a["husnummerFra"], a["etage"], a["sidedoer"], a["postnummer"], a["kommune"]["kommuneKode"])
    return F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))


_CLAIM = f"array<struct<predicate:string,object_repr:string,valid_from:date,valid_to:date,share:{S.SHARE},role:string>>"


def _claim(predicate: Column | str, obj: Column, period: Column | None = None, role: str | None = None, start: Column | None = None) -> Column:
    """One claim of a company: dated by a period, by a day, or not at all."""
    day = F.lit(None).cast("date")
    return F.struct(
        (F.lit(predicate) if isinstance(predicate, str) else predicate).alias("predicate"),
        obj.cast("string").alias("object_repr"),
        (_day(period["gyldigFra"]) if period is not None else day if start is None else start).alias("valid_from"),
        (_day(period["gyldigTil"]) if period is not None else day).alias("valid_to"),
        F.lit(None).cast(S.SHARE).alias("share"),
        F.lit(role).cast("string").alias("role"),
    )


def company_claims(docs: DataFrame) -> DataFrame:
    """Names, states, forms, websites, mail domains, addresses, industries, life, founding, headcount and mapped attributes of each company.

    A composite state counts from the newest start of a state.  ``role`` tells
    composite states and the addresses of production units from others.  All
    claims of a document are one array, so it is parsed once.
    """
    c = lambda field: F.col(f"company.{field}")

    def each(values: Column, predicate: str, obj, role: str | None = None) -> Column:
        return F.transform(values, lambda v: _claim(predicate, obj(v), v["periode"], role))

    def one(when: Column, claim: Column) -> Column:
        return F.when(when, F.array(claim))

    shown = lambda field: F.filter(c(field), lambda v: ~F.coalesce(v["hemmelig"], F.lit(False)))  # noqa: E731  secret rows never become claims
    meta = c("virksomhedMetadata")
    starts = F.array_max(F.transform(c("virksomhedsstatus"), lambda v: _day(v["periode"]["gyldigFra"])))
    staff = F.coalesce(*(meta[k]["antalAnsatte"] for k in HEADCOUNTS))
    known = F.create_map(*(F.lit(x) for kv in ATTRIBUTES.items() for x in kv))
    mapped = F.filter(c("attributter"), lambda a: known[a["type"]].isNotNull())
    parts = [
        each(c("navne"), "has_name", lambda v: v["navn"]),
        each(c("virksomhedsstatus"), "has_status", lambda v: v["status"]),
        each(c("virksomhedsform"), "has_form", lambda v: v["langBeskrivelse"]),
        each(shown("hjemmeside"), "has_website", lambda v: v["kontaktoplysning"]),
        each(shown("elektroniskPost"), "has_mail_domain", lambda v: F.lower(F.substring_index(v["kontaktoplysning"], "@", -1))),
        each(c("livsforloeb"), "has_lifecycle", lambda v: F.lit("active")),
        each(c("hovedbranche"), "has_industry", lambda v: v["branchekode"]),
        each(c("beliggenhedsadresse"), "registered_at", address_key, "registered_office"),
        each(F.flatten(F.filter(F.transform(c("penheder"), lambda u: u["beliggenhedsadresse"]), lambda a: a.isNotNull())), "registered_at", address_key, "production_unit"),
        one(meta["sammensatStatus"] != "", _claim("has_status", meta["sammensatStatus"], None, "composite", starts)),
        one(meta["stiftelsesDato"] != "", _claim("founded_on", _day(meta["stiftelsesDato"]))),
        one(staff.isNotNull(), _claim("employs", staff)),
        F.flatten(F.transform(mapped, lambda a: F.coalesce(F.transform(a["vaerdier"], lambda v: _claim(known[a["type"]], v["vaerdi"], v["periode"])), F.array().cast(_CLAIM)))),
    ]
    none = F.array().cast(_CLAIM)
    made = docs.select(company_key(F.col("company.cvrNummer")).alias("subject_key"), F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("x"))
    return made.select("subject_key", "x.*")


# Legal forms at the end of a name.
LEGAL_FORM = r"(?i)(?:\b|\s)(?:A/S|ApS|IVS|K/S|I/S|P/S|S\.?\s?[àa]\.?\s?r\.?\s?l\.?|S\.?A\.?R\.?L\.?|GmbH|AG|mbH|B\.?V\.?|N\.?V\.?|Ltd\.?|Limited|LLC|L\.?L\.?C\.?|Inc\.?|Corp\.?|Corporation|PLC|S\.?A\.?|S\.?p\.?A\.?|AB|Oy|Oyj|AS|ASA|SE|SARL|SAS|Kft|Sp\.? z o\.?o\.?|Pty|Pte)\s*$"


def other_party(name: Column, organs: Column) -> Column:
    """What a party without a number is: members of a management body are persons by law, a legal form tells a company."""
    return F.when(F.coalesce(F.array_contains(organs, "LEDELSESORGAN"), F.lit(False)), "person").when(F.trim(name).rlike(LEGAL_FORM), "company").otherwise("other_party")


def participant_key(p: Column, organs: Column | None = None) -> Column:
    """A company's valid number, a person's unit, or an opaque key that no register resolves.

    ``organs`` are the kinds of organisation that a participant belongs to.
    """
    unit = p["enhedsNummer"].cast("string")
    company = (p["enhedstype"] == "VIRKSOMHED") & valid_company_number(company_key(p["forretningsnoegle"]))
    kind = other_party(F.element_at(p["navne"], -1)["navn"], F.array().cast("array<string>") if organs is None else organs)
    other = F.when(kind == "person", "fp:").when(kind == "company", "fc:").otherwise("anden:")
    return (
        F.when(company, company_key(p["forretningsnoegle"]))
        .when(p["enhedstype"] == "PERSON", F.concat(F.lit("p:"), unit))
        .when(p["enhedstype"] == "ANDEN_DELTAGER", F.concat(other, unit))
        .otherwise(F.concat(F.lit("enh:"), unit))
    )


def relation_claims(docs: DataFrame) -> DataFrame:
    """Ownership, voting and role claims: the participant is the subject, the company the object.

    An owner without a percentage is kept with a null share.  A role's own
    period is cut to the membership's.  All claims of a membership are one
    array, so a document is parsed once.
    """
    me = company_key(F.col("company.cvrNummer"))
    rel = docs.select(me.alias("me"), F.explode("company.deltagerRelation").alias("r"))
    org = rel.select("me", participant_key(F.col("r.deltager"), F.col("r.organisationer.hovedtype")).alias("who"), F.explode("r.organisationer").alias("o"))
    name = F.element_at(F.col("o.organisationsNavn.navn"), -1)
    member = org.select("me", "who", F.col("o.hovedtype").alias("kind"), name.alias("name"), F.explode_outer("o.medlemsData").alias("m"))
    no_share, no_role = F.lit(None).cast(S.SHARE), F.lit(None).cast("string")
    none = F.array().cast("array<struct<predicate:string,valid_from:date,valid_to:date,share:" + S.SHARE + ",role:string>>")

    def claim(predicate: Column | str, period: Column, share: Column = no_share, role: Column = no_role) -> Column:
        first, last = _day(period["gyldigFra"]), _day(period["gyldigTil"])
        return F.struct((F.lit(predicate) if isinstance(predicate, str) else predicate).alias("predicate"), first.alias("valid_from"), last.alias("valid_to"), share.alias("share"), role.alias("role"))

    def values(kind: str, made) -> Column:
        """A claim for each value of the attributes of a kind; an attribute without values has one of nulls."""
        given = lambda a: F.when(F.size(a["vaerdier"]) > 0, a["vaerdier"]).otherwise(F.array(F.get(a["vaerdier"], F.lit(0))))
        some = F.filter("m.attributter", lambda a: a["type"] == kind)
        return F.coalesce(F.flatten(F.transform(some, lambda a: F.transform(given(a), made))), none)

    def states(test) -> Column:
        return F.coalesce(F.exists("m.attributter", test), F.lit(False))

    share = lambda v: F.replace(v["vaerdi"], F.lit(","), F.lit(".")).try_cast(S.SHARE)
    bare = F.when(~states(lambda a: a["type"].startswith("EJERANDEL")), F.array(claim(S.OWNS, F.col("m.periode")))).otherwise(none)
    owner = F.concat(values("EJERANDEL_PROCENT", lambda v: claim(S.OWNS, v["periode"], share(v))), values("EJERANDEL_STEMMERET_PROCENT", lambda v: claim(S.VOTES, v["periode"], share(v))), bare)
    predicate = F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[F.col("kind")], F.lit(S.ROLE))
    outer = F.col("m.periode")
    within = lambda p: F.struct(F.greatest(p["gyldigFra"], outer["gyldigFra"]).alias("gyldigFra"), F.least(p["gyldigTil"], outer["gyldigTil"]).alias("gyldigTil"))
    plain = F.when(~states(lambda a: a["type"] == "FUNKTION"), F.array(claim(predicate, outer, no_share, F.col("name")))).otherwise(none)
    role = F.concat(values("FUNKTION", lambda v: claim(predicate, within(v["periode"]), no_share, v["vaerdi"])), plain)
    made = member.select(F.col("who").alias("subject_key"), F.col("me").alias("object_repr"), F.inline(F.when(F.col("kind") == "REGISTER", owner).when(F.col("kind") != "REGISTER", role)))
    return made.select("subject_key", "predicate", "object_repr", "valid_from", "valid_to", "share", "role")


def silent_drops(documents: DataFrame, claims: DataFrame, required: dict[str, str], ignored: tuple[str, ...], col: str = "json") -> DataFrame:
    """field, documents: present top-level fields that made no claim and have no written reason."""
    fields = documents.select(F.explode(F.map_keys(F.from_json(F.get_json_object(F.col(col), "$.Vrvirksomhed"), "map<string,string>"))).alias("field"))
    present = fields.groupBy("field").agg(F.count(F.lit(1)).alias("documents"))
    made = [r["predicate"] for r in claims.select("predicate").distinct().collect()]  # a closed vocabulary
    covered = [f for f, p in required.items() if p in made]
    return present.filter(~F.col("field").isin(*covered, *ignored, ""))


def import_audit(documents: DataFrame, claims: DataFrame, required: dict[str, str], ignored: dict[str, str], col: str = "json") -> DataFrame:
    """field, documents, outcome, reason for every top-level field: imported, ignored for a written reason, or dropped without one."""
    fields = documents.select(F.explode(F.map_keys(F.from_json(F.get_json_object(F.col(col), "$.Vrvirksomhed"), "map<string,string>"))).alias("field"))
    present = fields.groupBy("field").agg(F.count(F.lit(1)).alias("documents"))
    known = documents.sparkSession.createDataFrame([(f, p, None) for f, p in required.items()] + [(f, None, r) for f, r in ignored.items()], "field string, predicate string, reason string")
    made = claims.select("predicate").distinct().withColumn("__made", F.lit(True))
    rows = present.join(F.broadcast(known), "field", "left").join(made, "predicate", "left")  # two short vocabularies
    outcome = F.when(F.col("__made"), "imported").when(F.col("reason").isNotNull(), "ignored").otherwise("dropped")
    return rows.select("field", "documents", outcome.alias("outcome"), "reason")
