"""Answering questions with three tools: metrics, retrieval and scenarios.

The router is deterministic and reads key words; a language model can take
its place as ``planner``, anything from a question to a list of tool calls.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import ChainMap
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.plans.gold import company_rows, country_rows
from portolan.plans.scenario import simulate_as_json
from portolan.plans.search import SearchIndex
from portolan.plans.semantic import Model, shipment_model
from portolan.schemas import AGENT_TRACES

QUERY, RETRIEVE, SIMULATE = "query_shipments", "retrieve_10k_risk_factors", "simulate_tariff_scenario"
CREDITS_PER_MILLION, USD_PER_CREDIT = 12.0, 2.0
_INTERNAL = {None, "system_execute_sql", "system_agentic_semantic_context"}
_CHAPTERS = {"apparel": ("61", "62"), "auto": ("87",), "electronics": ("84", "85"), "machinery": ("84",), "plastic": ("39",), "steel": ("72", "73"), "aluminum": ("76",), "section 232": ("72", "73", "76")}
_ADJECTIVES = {"chinese": "CN", "german": "DE", "mexican": "MX", "vietnamese": "VN", "french": "FR", "british": "GB", "spanish": "ES", "belgian": "BE"}


@dataclass
class Facts:
    """What a question names."""

    companies: list[tuple[str, str]] = field(default_factory=list)
    chapters: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    points: float | None = None
    limit: int = 10


def read_question(q: str) -> Facts:
    low = q.lower()
    f = Facts()
    for ticker, name in company_rows():
        first = re.sub(r"[^A-Za-z0-9]", "", name.split()[0])
        if re.search(rf"\b{re.escape(first.lower())}\b", low) or re.search(rf"\b{ticker}\b", q):
            f.companies.append((ticker, first))
    for word, chapters in _CHAPTERS.items():
        if word in low:
            f.chapters += [c for c in chapters if c not in f.chapters]
    f.chapters += [m for m in re.findall(r"chapter\s+(\d{2})", low) if m not in f.chapters]
    for code, name, *_ in country_rows():
        if name.lower() in low:
            f.countries.append(code)
    f.countries += [c for a, c in _ADJECTIVES.items() if a in low and c not in f.countries]
    m = re.search(r"(\d+(?:\.\d+)?)\s*(?:pp|percentage points?|points|%)", low)
    f.points = float(m[1]) if m else 25.0 if "doubl" in low else None
    m = re.search(r"top\s+(\d+)", low)
    f.limit = int(m[1]) if m else 10
    return f


def plan_question(q: str) -> list[dict[str, Any]]:
    """The tool calls for a question, in order."""
    low, f = q.lower(), read_question(q)
    calls: list[dict[str, Any]] = []
    says = re.search(r"\b(disclos\w*|say|says|mention\w*|10-ks?|20-f)\b", low)
    what_if = re.search(r"\b(if|what happens|would)\b", low) and (f.points is not None or "rise" in low or "tariffs" in low)
    facts = what_if or not says or re.search(r"\b(concentrat\w*|single[- ]sourced?|compare|consignees|suppliers?)\b", low.split("10-k")[-1] if says else low)
    if facts:
        where: list[list[Any]] = []
        if f.companies:
            where.append(["consignee_name", "like", f.companies[0][1]])
        if f.chapters:
            where.append(["hs_2", "in", f.chapters])
        if f.countries and not what_if:
            where.append(["supplier_country_code" if "supplier" in low else "origin_country_code", "in", f.countries])
        if re.search(r"concentrat|divers", low):
            ask = (["max_supplier_hhi"], ["consignee_name", "dim_hs_code.hs_2"])
        elif "single" in low:
            ask = (["max_supplier_hhi"], ["consignee_name", "dim_hs_code.hs_6"])
            where.append(["is_single_source", "=", True])
        elif "supplier" in low:
            ask = (["total_shipments"], ["supplier_name", "supplier_country_code"])
        elif "exposure" in low and not f.companies:
            ask = (["total_landed_cost_usd"], ["dim_hs_code.hs_2"])
        else:
            ask = (["total_landed_cost_usd", "total_shipments"], ["consignee_name"])
        calls.append({"tool_name": QUERY, "arguments": {"metrics": ask[0], "dimensions": ask[1], "where": where, "limit": f.limit}})
    if what_if:
        calls.append({"tool_name": SIMULATE, "arguments": {"consignee": f.companies[0][1] if f.companies else None, "additional_rate_pp": f.points if f.points is not None else 25.0, "hs_chapters": ",".join(f.chapters), "origin_countries": ",".join(f.countries), "scenario_name": q}})
    if says:
        calls.append({"tool_name": RETRIEVE, "arguments": {"query": q, "ticker": f.companies[0][0] if f.companies else None, "k": 5}})
    return calls


@dataclass
class Agent:
    """``tables`` by name as the semantic model has them; ``index`` over the filings' chunks."""

    tables: Mapping[str, DataFrame]
    index: SearchIndex | None = None
    model: Model = field(default_factory=shipment_model)
    planner: Callable[[str], list[dict[str, Any]]] = plan_question

    def query_shipments(self, metrics, dimensions, where=(), limit: int = 10) -> DataFrame:
        tests = [tuple(w) for w in where if w[1] != "like"]
        tables = ChainMap({}, self.tables)
        for name, _, value in (w for w in where if w[1] == "like"):
            d = self.model.dimension(name)
            tables[d.table] = tables[d.table].withColumn("__hit", F.upper(d.expr).contains(value.upper()))
            model = Model(self.model.keys, self.model.relationships, [*self.model.dimensions, type(d)(d.table, f"{name}_hit", "__hit")], self.model.metrics)
            tests.append((f"{name}_hit", "=", True))
            return model.query(tables, metrics, dimensions, tests).orderBy(F.col(metrics[0]).desc_nulls_last(), *[F.col(d.rpartition(".")[2]).asc_nulls_last() for d in dimensions]).limit(limit)
        return self.model.query(tables, metrics, dimensions, tests).orderBy(F.col(metrics[0]).desc_nulls_last(), *[F.col(d.rpartition(".")[2]).asc_nulls_last() for d in dimensions]).limit(limit)

    def find_consignee(self, word: str | None) -> str | None:
        c = self.tables["dim_consignee"]
        if word:
            c = c.filter(F.upper("consignee_name").contains(word.upper()))
        best = c.orderBy(F.col("total_shipments").desc_nulls_last(), "consignee_key").select("consignee_key").first()
        return best[0] if best else None

    def call(self, tool: str, a: dict[str, Any]) -> Any:
        """A tool's result: rows as dicts, or the scenario's JSON object."""
        if tool == QUERY:
            return [r.asDict() for r in self.query_shipments(**a).collect()]  # at most ``limit`` rows
        if tool == RETRIEVE:
            if self.index is None:
                return []
            eq = {"ticker": a["ticker"]} if a.get("ticker") else None
            return [r.asDict() for r in self.index.search(a["query"], a.get("k", 5), ["chunk_text", "ticker", "filing_year"], eq).collect()]
        if tool == SIMULATE:
            a = dict(a)
            word = a.pop("consignee", None)
            key = a.pop("consignee_key", None) or self.find_consignee(word)
            if key is None:
                return {"scenario_name": a["scenario_name"], "rows": []}
            return json.loads(simulate_as_json(self.tables["fact_shipments"], key, **a))
        raise KeyError(f"no tool {tool}")

    def run(self, question: str) -> dict[str, Any]:
        """The answer in text blocks with each tool's numbers, and the calls made."""
        began = time.time()
        content: list[dict[str, Any]] = []
        for c in self.planner(question):
            content.append({"type": "tool_use", "tool_use": {"name": c["tool_name"], "input": c["arguments"]}})
            result = self.call(c["tool_name"], c["arguments"])
            content.append({"type": "text", "text": f"{c['tool_name']}: {json.dumps(result, default=str)}\n"})
        return parse_response({"content": content}) | {"latency_ms": int((time.time() - began) * 1000)}


def parse_response(data: dict[str, Any]) -> dict[str, Any]:
    """Text blocks joined, tools that were used but for internal ones, and token counts."""
    blocks = data.get("content") or []
    calls = [{"tool_name": b["tool_use"]["name"], "arguments": b["tool_use"].get("input") or {}} for b in blocks if b.get("type") == "tool_use" and b["tool_use"].get("name") not in _INTERNAL]
    usage = ((data.get("metadata") or {}).get("usage") or {}).get("tokens_consumed") or []
    count = lambda k: sum(((u.get(k) or {}).get("total") or 0) for u in usage)
    named = [u["model_name"] for u in usage if "model_name" in u]
    text = "".join(b["text"] for b in blocks if b.get("type") == "text").strip()
    return {"final_answer": text or "(no answer text returned)", "tool_calls": calls, "input_tokens": count("input_tokens"), "output_tokens": count("output_tokens"), "model_name": named[-1] if named else None}


def log_trace(spark: SparkSession, path: str, question: str, response: dict[str, Any], latency_ms: int, session_id: str | None = None) -> None:
    """Append one row to the trace table."""
    tokens = (response.get("input_tokens") or 0) + (response.get("output_tokens") or 0)
    row = (str(uuid.uuid4()), datetime.now(timezone.utc).replace(tzinfo=None), question, response.get("final_answer", ""), json.dumps(response.get("tool_calls", []), default=str), int(latency_ms), tokens / 1e6 * CREDITS_PER_MILLION, session_id)
    spark.createDataFrame([row], AGENT_TRACES).write.mode("append").parquet(path)
