"""Addresses, networks and whose they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.functions.scalars import mail_provider

# Networks that answer for others, and those where machines stand.
EDGE = {"13335": "cloudflare", "209242": "cloudflare", "54113": "fastly", "394192": "fastly", "16625": "akamai", "20940": "akamai", "16509": "aws-cloudfront"}
HOSTING = {"24940": "hetzner", "16276": "ovh", "14618": "aws", "8075": "azure", "15169": "google", "396982": "google-cloud", "13238": "yandex", "63949": "linode", "14061": "digitalocean", "20473": "vultr"}


def _named(asn: Column, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[asn.cast("string")]


def masks_origin(asn: Column) -> Column:
    """Whether a country read off the network says nothing about the machine."""
    return F.coalesce(asn.cast("string").isin(*EDGE), F.lit(False))


def network_provider(asn: Column) -> Column:
    return F.coalesce(_named(asn, EDGE), _named(asn, HOSTING), F.lit(""))


def hosted_by(asn: Column) -> Column:
    return F.coalesce(_named(asn, HOSTING), F.lit(""))


def address_number(ip: Column) -> Column:
    """A dotted address as a number; null if it is none."""
    parts = F.transform(F.split(F.trim(ip), r"\."), lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("long")))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def in_networks(addresses: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """``addresses`` with the columns of the most specific network that holds the address; nulls if none does.

    ``networks``: (prefix, such as ``10.1.0.0/16``, and more columns).  An
    address meets networks by its leading bits, once for each length that occurs (33 at most),
    so nothing is joined by range.  Of equal prefixes the first, by all columns, counts.
    """
    more = [c for c in networks.columns if c != "prefix"]
    bits = F.substring_index("prefix", "/", -1).try_cast("int")
    nets = networks.select(bits.alias("__bits"), address_number(F.substring_index("prefix", "/", 1)).alias("__net"), "prefix", *more).filter("__bits BETWEEN 0 AND 32 AND __net IS NOT NULL")
    lead = lambda number, n: F.expr(f"shiftright({number}, 32 - {n})")
    nets = nets.groupBy("__bits", lead("__net", "__bits").alias("__lead")).agg(F.min(F.struct("prefix", *more)).alias("__found"))
    lengths = nets.groupBy().agg(F.array_sort(F.collect_set("__bits")).alias("__lengths"))  # one row
    known = addresses.select(F.monotonically_increasing_id().alias("__row"), "*").withColumn("__number", address_number(F.col(ip)))
    each = known.select("__number").filter("__number IS NOT NULL").distinct().crossJoin(F.broadcast(lengths)).select("__number", F.explode("__lengths").alias("__bits"))
    met = each.withColumn("__lead", lead("__number", "__bits")).join(nets, ["__bits", "__lead"])
    best = met.groupBy("__number").agg(F.max_by("__found", "__bits").alias("__found"))
    return known.join(best, "__number", "left").select(*addresses.columns, *(F.col(f"__found.{c}").alias(c) for c in ("prefix", *more)))


def host_key(hosts: Column) -> Column:
    """One value for a set of hosts, whatever their order, case and final dots; null for none."""
    plain = F.array_sort(F.array_distinct(F.transform(F.filter(hosts, lambda h: h.isNotNull()), lambda h: F.rtrim(F.lower(h), F.lit(".")))))
    return F.when(F.coalesce(F.size(plain), F.lit(0)) > 0, F.sha2(F.array_join(plain, "|").cast("binary"), 256))


def shared_infrastructure(observed: DataFrame) -> DataFrame:
    """kind, key, hosts, members: subjects that share their mail hosts (those of bulk providers left out) or their name servers with others.

    ``observed``: (subject, mx array, ns array).  Members are counted, not listed; ``key`` leads back to them.
    """
    own = F.when(mail_provider("mx") == "other", F.col("mx"))
    each = observed.select("subject", F.explode(F.array(F.struct(F.lit("mx").alias("kind"), own.alias("hosts")), F.struct(F.lit("ns").alias("kind"), F.col("ns").alias("hosts")))).alias("x"))
    keyed = each.select("subject", "x.kind", host_key(F.col("x.hosts")).alias("key"), F.array_join(F.array_sort("x.hosts"), ",").alias("hosts")).filter("key IS NOT NULL")
    return keyed.groupBy("kind", "key").agg(F.min("hosts").alias("hosts"), F.count_distinct("subject").alias("members")).filter("members > 1")
