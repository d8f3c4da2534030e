"""Sender domains against a table of brands of any size, by equi-joins over distinct domains.

Edit distance becomes an equi-join: two names at most two edits apart have a string in common
once up to two letters are left out of each.  Those strings are the index.  The subdomain rules
look for a domain's label prefixes and single labels among the brands and their first labels.
No pair is compared that shares none of these, and each domain is compared once, however many
mails it has sent.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from mailsieve import fixed_values as V
from mailsieve.functions.shared import cut
from mailsieve.operators import domains
from mailsieve.operators.lookup import BROADCAST_BYTES, lookup


def _shorter(text: Column) -> Column:
    """The strings with one letter left out."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def neighbourhood(text: Column, edits: int = V.MAX_EDITS) -> Column:
    """The distinct strings with up to ``edits`` letters left out, the text itself among them."""
    level, found = F.array(text), F.array(text)
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(level, _shorter)))
        found = F.concat(found, level)
    return F.array_distinct(found)


def near(names: DataFrame, brands: DataFrame, edits: int = V.MAX_EDITS) -> DataFrame:
    """``(name, brand, edits)`` of distinct ``names(name)`` and ``brands(brand)`` one to ``edits`` edits apart.

    Names longer than any brand by more than ``edits`` are near none and get no index.
    """
    known = cut(brands.where("brand IS NOT NULL").select("brand").distinct(), "brands")
    longest = known.agg(F.max(F.length("brand"))).first()[0]
    if longest is None:
        return names.select("name", F.lit("").alias("brand"), F.lit(0).alias("edits")).where("false")
    asked = names.where(F.length("name") <= longest + edits).select("name").distinct()
    index = known.select("brand", F.explode(neighbourhood(F.col("brand"), edits)).alias("part"))
    pairs = asked.select("name", F.explode(neighbourhood(F.col("name"), edits)).alias("part")).join(index, "part")
    alike = pairs.where(F.abs(F.length("name") - F.length("brand")) <= edits).select("name", "brand").distinct()
    return alike.withColumn("edits", F.levenshtein("name", "brand", edits)).where("edits >= 1")


def prefixed(senders: DataFrame, brands: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(domain, brand)``: the domain of ``senders(domain, reg)`` begins with the brand and a dot, but is not the brand's."""
    labels = F.split("domain", "[.]")
    begins = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, F.lit(1), i), "."))
    parts = senders.where("contains(domain, '.')").select("domain", "reg", F.explode(begins).alias("brand"))
    return lookup(parts, brands.select("brand").distinct(), "brand", row_id="domain", limit=limit).where("reg != brand").select("domain", "brand")


def labelled(senders: DataFrame, brands: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(domain, brand)``: a label of the domain is the brand's first, and the domain is neither the
    brand's nor below it.  Labels that many domains share are hot keys, which ``lookup`` splits."""
    parts = senders.select("domain", "reg", F.explode(F.array_distinct(F.split("domain", "[.]"))).alias("label"))
    first = F.substring_index("brand", ".", 1)
    side = brands.where("brand IS NOT NULL").groupBy(first.alias("label")).agg(F.collect_set("brand").alias("_brands"))
    found = lookup(parts, side, "label", row_id="domain", limit=limit).select("domain", "reg", "label", F.explode("_brands").alias("brand"))
    own = "reg != brand AND reg != concat(label, '.com') AND NOT endswith(domain, concat('.', brand))"
    return found.where(own).select("domain", "brand")


def hits(senders: DataFrame, brands: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """What the brand rules need to know of each of ``senders(domain, reg, folded_reg)``: ``exact`` (the
    folded name is a brand), ``typos`` (brands nearby, in order of their names), and the smallest brand that
    it is prefixed or labelled with.  Domains without any of these are left out."""
    known = brands.where("brand IS NOT NULL").select("brand").distinct()
    names = senders.select(F.col("folded_reg").alias("name")).distinct()
    typos = near(names, known).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("brand", "edits"))).alias("typos"))
    exact = names.join(known.select(F.col("brand").alias("name"), F.lit(True).alias("exact")), "name")
    of_name = cut(exact.join(typos, "name", "full").withColumnRenamed("name", "folded_reg"), "names")
    prefix = prefixed(senders, known, limit=limit).groupBy("domain").agg(F.min("brand").alias("prefix"))
    label = labelled(senders, known, limit=limit).groupBy("domain").agg(F.min("brand").alias("label"))
    of_domain = lookup(senders.select("domain", "folded_reg"), of_name, "folded_reg", "inner", row_id="domain", limit=limit).drop("folded_reg")
    return of_domain.join(prefix.join(label, "domain", "full"), "domain", "full")


def add(df: DataFrame, as_of: date, brands: DataFrame, *, to: str = "domains_findings", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``domains.add`` against the table ``brands(brand)`` in place of the built-in list: the same
    findings, those of typosquatting in order of the brands' names.

    Domains are looked up once each; a domain that a third of all mails come from is a hot key,
    which ``lookup`` splits.
    """
    ready = domains.prepare(df, as_of)
    ready = cut(ready, "ready")
    senders = cut(ready.select(F.col("_domain").alias("domain"), F.col("_reg").alias("reg"), F.col("_folded_reg").alias("folded_reg")).distinct(), "senders")
    found = hits(senders, brands, limit=limit).select(
        F.col("domain").alias("_domain"), F.col("exact").alias("_exact"), F.col("typos").alias("_typos"), F.col("prefix").alias("_prefix"), F.col("label").alias("_label")
    )
    joined = lookup(ready, found, "_domain", "left", limit=limit)
    return domains.found(joined, df.columns, to)
