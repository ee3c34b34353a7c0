"""Schemas of the raw tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    """``name:type`` pairs; a name without a type is a string."""
    kinds = {"long": T.LongType(), "date": T.DateType(), "double": T.DoubleType(), "ntz": T.TimestampNTZType(), "string": T.StringType(), "bool": T.BooleanType()}
    fields = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        fields.append(T.StructField(name, kinds[kind or "string"]))
    return T.StructType(fields)


BOL = _schema(
    "identifier:long trade_update_date:date run_date:date vessel_name port_of_unlading estimated_arrival_date:date foreign_port_of_lading record_status_indicator"
    " place_of_receipt port_of_destination foreign_port_of_destination secondary_notify_party_1 actual_arrival_date:date consignee_name consignee_address"
    " consignee_contact_name consignee_comm_number_qualifier consignee_comm_number shipper_party_name shipper_address shipper_contact_name"
    " shipper_comm_number_qualifier shipper_comm_number container_number description_sequence_number:long piece_count:long text harmonized_number"
    " harmonized_value:long harmonized_weight:long harmonized_weight_unit identified_orgs"
)
HTS = _schema("hts_number description indent:long units general_rate_text special_rate_text column2_rate_text footnotes hs2 hs4 hs6 hs8 hs10")
FILINGS = _schema("cik ticker filing_date:date filing_url item_1a_text item_7_text item_1a_length:long item_7_length:long ingested_at:ntz filing_type")
TARIFF_EVENTS = _schema("event_date:date event_type hs_scope country_scope rate_change_pp:double description source_url")
HS_EVAL = _schema("product_description correct_hs_6 notes")
HS_EVAL_V2 = _schema("product_text classifier_prediction hs_source_final predicted_chapter correct_hs_6 notes")
AGENT_TRACES = _schema("trace_id timestamp:ntz question response tool_calls total_latency_ms:long cost_credits_estimate:double session_id")
