"""Entity resolution of suppliers and consignees: one plan, two parties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.country import extract_country_from_text, port_origin_country
from portolan.functions.text import is_freight_forwarder, is_placeholder_name, normalize_company_name
from portolan.functions.vector import cosine, embed
from portolan.operators.components import connected_components
from portolan.operators.relational import blocking_pairs, top_by
from portolan.session import ship_code
from portolan.sources.tables import append_new


@dataclass(frozen=True)
class Party:
    name: str  # in table and id names
    prefix: str  # of the columns of its tables
    raw_name: str
    raw_address: str
    with_port: bool  # whether the port counts in the most common combination

    @property
    def golden_id(self) -> str:
        return f"golden_{self.name}_id"


PARTIES = {
    "supplier": Party("supplier", "shipper", "shipper_party_name", "shipper_address", True),
    "consignee": Party("consignee", "consignee", "consignee_name", "consignee_address", False),
}
#: A pair's score weighs the embeddings' cosine and one minus the relative edit distance.
EMBED_WEIGHT, MATCH, REVIEW = 0.7, 0.92, 0.80


def name_normalized(bol: DataFrame, party: Party) -> DataFrame:
    """One row per raw name: normalized, with its most common address, the country of that, flags, blocking key and shipments."""
    p = party.prefix
    rows = bol.filter(F.col(party.raw_name).isNotNull()).select(F.col(party.raw_name).alias("raw"), F.col(party.raw_address).alias("address"), F.col("foreign_port_of_lading").alias("port"))
    combo = ["address", "port"] if party.with_port else ["address"]
    counted = rows.groupBy("raw", *combo).count()
    total = counted.groupBy("raw").agg(F.sum("count").alias("shipment_count"))
    best = top_by(counted, ["raw"], [F.desc("count"), *[F.col(c).asc_nulls_last() for c in combo]]).select("raw", "address")
    named = total.join(best, "raw").withColumn("norm", normalize_company_name(F.col("raw"))).withColumn("country", extract_country_from_text(F.col("address")))
    return named.select(
        F.col("raw").alias(f"{p}_name_raw"), F.col("norm").alias(f"{p}_name_norm"), F.col("address").alias(f"{p}_address"), F.col("country").alias(f"{p}_registered_country"),
        is_freight_forwarder(F.col("raw")).alias("is_forwarder"), is_placeholder_name(F.col("norm")).alias("is_placeholder"),
        F.concat(F.left("norm", F.lit(8)), F.lit("|"), F.coalesce("country", F.lit("UNK"))).alias("blocking_key"), "shipment_count",
    )


def embedded(names: DataFrame, party: Party, embedder=None, path: str | None = None) -> DataFrame:
    """(norm, embedding) of distinct normalized names of three characters or more. With ``path``, names that the table there has are never embedded again."""
    ship_code(names.sparkSession)
    n = f"{party.prefix}_name_norm"
    rows = names.select(n).filter(F.length(n) >= 3).distinct()
    made = lambda new: new.withColumn("embedding", embed(embedder)(F.col(n)))
    return made(rows) if path is None else append_new(rows, path, [n], made)


def pair_candidates(names: DataFrame, party: Party, dedupe: bool = False) -> DataFrame:
    """Pairs of normalized names of one block with lengths less than 20 apart.

    The grain is raw names, so a pair comes once for each pair of raw names;
    with ``dedupe``, once. Placeholders and forwarders aren't left out.
    """
    p = party.prefix
    rows = names.select("blocking_key", F.col(f"{p}_name_norm").alias("norm"), F.col(f"{p}_registered_country").alias("country"))
    if dedupe:
        rows = rows.distinct()
    return blocking_pairs(rows, "blocking_key", "norm", 20, keep=("country",))


def pair_scored(pairs: DataFrame, vectors: DataFrame, party: Party, match: float = MATCH, review: float = REVIEW) -> DataFrame:
    """Candidates with embed_sim, char_sim, match_score and match_label."""
    n = f"{party.prefix}_name_norm"
    side = lambda s: vectors.select(F.col(n).alias(f"name_{s}"), F.col("embedding").alias(f"__v{s}"))
    joined = pairs.join(side("a"), "name_a").join(side("b"), "name_b")
    char = F.lit(1.0) - F.levenshtein("name_a", "name_b") / F.greatest(F.length("name_a"), F.length("name_b"))
    scored = joined.withColumn("embed_sim", cosine(F.col("__va"), F.col("__vb"))).withColumn("char_sim", char)
    scored = scored.withColumn("match_score", EMBED_WEIGHT * F.col("embed_sim") + (1 - EMBED_WEIGHT) * F.col("char_sim"))
    label = F.when(F.col("match_score") >= match, "match").when(F.col("match_score") >= review, "review").otherwise("no_match")
    return scored.withColumn("match_label", label).select(*pairs.columns, "embed_sim", "char_sim", "match_score", "match_label")


def golden_map(names: DataFrame, scored: DataFrame, party: Party) -> DataFrame:
    """One row per raw name: its cluster of matched names and the golden entity of that.

    Clusters are connected components over all matches, named by their least
    name; a name without a match is its own cluster. Country: that with most
    shipments, where no country is one too. Representative: the raw name with
    most shipments. The id is a digest of both, so it doesn't depend on how
    clusters are named.
    """
    p = party.prefix
    norm, raw, address, country = f"{p}_name_norm", f"{p}_name_raw", f"{p}_address", f"{p}_registered_country"
    edges = scored.filter(F.col("match_label") == "match").select("name_a", "name_b").distinct()
    clusters = connected_components(edges, "name_a", "name_b").select(F.col("node").alias(norm), F.col("component").alias("__c"))
    member = names.filter(F.col(norm).isNotNull()).join(clusters, norm, "left").withColumn("cluster_key", F.coalesce("__c", norm)).drop("__c")
    votes = member.groupBy("cluster_key", country).agg(F.sum("shipment_count").alias("n"))
    majority = top_by(votes, ["cluster_key"], [F.desc("n"), F.col(country).asc_nulls_last()]).select("cluster_key", F.col(country).alias("country"))
    head = top_by(member, ["cluster_key"], [F.desc("shipment_count"), F.col(raw).asc()]).select("cluster_key", F.col(raw).alias("canonical_name"), F.col(address).alias("sample_address"))
    out = member.join(head, "cluster_key").join(majority, "cluster_key")
    key = F.md5(F.concat("canonical_name", F.lit("|"), F.coalesce("country", F.lit("UNK"))))
    return out.select(raw, norm, "cluster_key", key.alias(party.golden_id), "canonical_name", "country", "sample_address", "is_forwarder", "is_placeholder", "shipment_count")


def golden(mapped: DataFrame, party: Party) -> DataFrame:
    """One row per golden entity."""
    return mapped.groupBy(party.golden_id, "canonical_name", "country").agg(
        F.countDistinct(f"{party.prefix}_name_raw").alias("raw_name_variants_count"), F.sum("shipment_count").alias("total_shipments"), F.min("sample_address").alias("sample_address")
    )


ORIGINS = ("DE", "BE", "VN", "ES", "GB", "FR", "MX", "CN")


def silver_bol_shipments(bol: DataFrame, suppliers: DataFrame, consignees: DataFrame) -> DataFrame:
    """Shipments from the eight origin countries with both parties resolved; a shipment without either name falls away."""
    ships = bol.withColumn("shipment_origin_country", port_origin_country(F.col("foreign_port_of_lading"))).filter(F.col("shipment_origin_country").isin(*ORIGINS))
    s = suppliers.select(F.col("shipper_name_raw").alias("shipper_party_name"), "golden_supplier_id", F.col("canonical_name").alias("supplier_canonical_name"), F.col("country").alias("supplier_registered_country"))
    c = consignees.select(F.col("consignee_name_raw").alias("consignee_name"), "golden_consignee_id", F.col("canonical_name").alias("consignee_canonical_name"), F.col("country").alias("consignee_registered_country"), F.col("is_forwarder").alias("__f"))
    party_type = F.when(F.col("__f"), "freight_forwarder").otherwise("importer")
    out = ships.join(s, "shipper_party_name").join(c, "consignee_name").withColumn("hs_chapter", F.left("harmonized_number_final", F.lit(2))).withColumn("consignee_party_type", party_type)
    return out.select(
        *"identifier container_number trade_update_date description_sequence_number piece_count harmonized_number_final hs_source hs_chapter text".split(),
        *"harmonized_value harmonized_weight harmonized_weight_unit shipment_origin_country foreign_port_of_lading shipper_party_name golden_supplier_id".split(),
        *"supplier_canonical_name supplier_registered_country consignee_name golden_consignee_id consignee_canonical_name consignee_registered_country".split(),
        *"consignee_party_type identified_orgs ingested_at".split(),
    )


def pair_metrics(labelled: DataFrame, row_id: str, ours: str, truth: str) -> DataFrame:
    """Precision, recall and F1 of clusters against labels, over row pairs that agree in one or the other.

    Pairs agreeing in neither aren't looked at, so there are no true
    negatives. Counted from group sizes, not from pairs: a group of n rows has
    n(n-1)/2 pairs, less those of rows with equal ids.
    """

    def pairs(keys: list[str]) -> DataFrame:
        """Unordered pairs with distinct ids within groups of ``keys``."""
        by_id = labelled.dropna(subset=[row_id, *keys]).groupBy(*keys, row_id).agg(F.count("*").alias("m"))
        g = by_id.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("s"))
        return g.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2), F.lit(0.0)).cast("long").alias("p"))

    both = pairs([ours, truth]).withColumnRenamed("p", "true_positive")
    a = pairs([ours]).withColumnRenamed("p", "a")
    b = pairs([truth]).withColumnRenamed("p", "b")
    m = both.crossJoin(a).crossJoin(b).select("true_positive", (F.col("a") - F.col("true_positive")).alias("false_positive"), (F.col("b") - F.col("true_positive")).alias("false_negative"))
    m = m.withColumn("true_negative", F.lit(0).cast("long")).withColumn("total_pairs", F.col("true_positive") + F.col("false_positive") + F.col("false_negative"))
    ratio = lambda x: F.col("true_positive") / F.nullif(F.col("true_positive") + F.col(x), F.lit(0))
    m = m.withColumn("precision", ratio("false_positive")).withColumn("recall", ratio("false_negative"))
    return m.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))
