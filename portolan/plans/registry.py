"""Stages with declared inputs, run in order of need."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from portolan.sources.tables import replace_table


@dataclass(frozen=True)
class Stage:
    name: str
    layer: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    stored: bool = True
    kept: bool = False


@dataclass
class Registry:
    stages: dict[str, Stage] = field(default_factory=dict)

    def stage(self, name: str, layer: str, inputs: Iterable[str] = (), stored: bool = True, kept: bool = False):
        """Register a function of its inputs' DataFrames. A stage that isn't stored stays lazy; one that is kept gets the ``path`` of its table and adds to it what is new."""

        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self.stages:
                raise ValueError(f"two stages are called {name}")
            self.stages[name] = Stage(name, layer, tuple(inputs), f, stored, kept)
            return f

        return add

    def order(self, targets: Iterable[str] | None = None) -> list[str]:
        """Stages that ``targets`` need (all, by default), each after its inputs; a cycle is an error."""
        want = set(targets) if targets is not None else set(self.stages)
        todo = list(want)
        while todo:
            s = self.stages.get(todo.pop())
            for i in s.inputs if s else ():
                if i in self.stages and i not in want:
                    want.add(i)
                    todo.append(i)
        graph = {n: [i for i in self.stages[n].inputs if i in self.stages] for n in want if n in self.stages}
        return list(TopologicalSorter(graph).static_order())

    def run(self, spark: SparkSession, sources: dict[str, DataFrame], root: str | None = None, targets: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """Every table by name. With ``root``, stored stages are written to root/layer/name and read back, which cuts the lineage; a later run finds the kept ones there."""
        tables = dict(sources)
        for name in self.order(targets):
            tables[name] = self._build(name, tables, root)
        return tables

    def _build(self, name: str, tables: Mapping[str, DataFrame], root: str | None) -> DataFrame:
        s = self.stages[name]
        missing = [i for i in s.inputs if i not in tables]
        if missing:
            raise KeyError(f"{name} needs {', '.join(missing)}")
        if root and s.kept:
            return s.build(*[tables[i] for i in s.inputs], path=f"{root}/{s.layer}/{name}")
        df = s.build(*[tables[i] for i in s.inputs])
        return replace_table(df, f"{root}/{s.layer}/{name}") if root and s.stored else df

    def on_demand(self, sources: dict[str, DataFrame], root: str | None = None) -> Mapping[str, DataFrame]:
        """The same tables, each built with what it needs when it is first asked for. To put another in one's place, use a ChainMap: a copy asks for all."""
        return _OnDemand(self, dict(sources), root)


class _OnDemand(Mapping):
    def __init__(self, registry: Registry, tables: dict[str, DataFrame], root: str | None):
        self._registry, self._tables, self._root = registry, tables, root

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name not in self._registry.stages:
                raise KeyError(name)
            for n in self._registry.order([name]):
                if n not in self._tables:
                    self._tables[n] = self._registry._build(n, self._tables, self._root)
        return self._tables[name]

    def __contains__(self, name: object) -> bool:
        return name in self._tables or name in self._registry.stages

    def __iter__(self):
        return iter(dict.fromkeys([*self._tables, *self._registry.stages]))

    def __len__(self) -> int:
        return len(self._tables.keys() | self._registry.stages.keys())


def full_registry(embedder=None, completer=None) -> Registry:
    """The whole pipeline from raw tables to marts. Sources: bol_shipments, hts_tariff_schedule, sec_10k_filings, tariff_events."""
    from portolan.plans import bronze, classify, entities, gold, scenario

    r = Registry()
    r.stage("bronze_bol", "bronze", ["bol_shipments"])(bronze.bronze_bol)
    r.stage("bronze_hts", "bronze", ["hts_tariff_schedule"])(bronze.bronze_hts)
    r.stage("bronze_10k", "bronze", ["sec_10k_filings"])(bronze.bronze_10k)
    for party in entities.PARTIES.values():
        p = party.name
        r.stage(f"int_{p}_name_normalized", "silver", ["bronze_bol"])(lambda b, party=party: entities.name_normalized(b, party))
        r.stage(f"int_{p}_embedded", "silver", [f"int_{p}_name_normalized"], kept=True)(lambda n, path=None, party=party: entities.embedded(n, party, embedder, path))
        r.stage(f"int_{p}_pair_candidates", "silver", [f"int_{p}_name_normalized"], stored=False)(lambda n, party=party: entities.pair_candidates(n, party, dedupe=True))
        r.stage(f"int_{p}_pair_scored", "silver", [f"int_{p}_pair_candidates", f"int_{p}_embedded"])(lambda c, e, party=party: entities.pair_scored(c, e, party))
        r.stage(f"int_{p}_golden_map", "silver", [f"int_{p}_name_normalized", f"int_{p}_pair_scored"])(lambda n, s, party=party: entities.golden_map(n, s, party))
        r.stage(f"silver_{p}_golden", "silver", [f"int_{p}_golden_map"])(lambda m, party=party: entities.golden(m, party))
    r.stage("silver_bol_shipments", "silver", ["bronze_bol", "int_supplier_golden_map", "int_consignee_golden_map"])(entities.silver_bol_shipments)
    r.stage("int_product_text_universe", "silver", ["silver_bol_shipments"])(lambda s: classify.product_text_universe(s, embedder))
    r.stage("int_hts_embedded", "silver", ["bronze_hts"])(lambda h: classify.hts_embedded(h, embedder))
    r.stage("int_hs_candidates", "silver", ["int_product_text_universe", "int_hts_embedded"])(classify.hs_candidates)
    r.stage("int_hs_classified_raw", "silver", ["int_hs_candidates"], kept=True)(lambda c, path=None: classify.classified_raw(c, completer, path))
    r.stage("int_hs_classified", "silver", ["int_hs_classified_raw"])(classify.classified)
    r.stage("silver_bol_shipments_classified", "silver", ["silver_bol_shipments", "int_hs_classified"])(classify.shipments_classified)
    r.stage("silver_bol_shipments_scoped", "silver", ["silver_bol_shipments_classified"])(classify.shipments_scoped)
    r.stage("dim_supplier", "gold", ["silver_supplier_golden"])(lambda g: gold.dim_party(g, entities.PARTIES["supplier"]))
    r.stage("dim_consignee", "gold", ["silver_consignee_golden"])(lambda g: gold.dim_party(g, entities.PARTIES["consignee"]))
    r.stage("dim_country", "gold", ["bronze_bol"])(lambda b: gold.dim_country(b.sparkSession))
    r.stage("dim_date", "gold", ["bronze_bol"])(lambda b: gold.dim_date(b.sparkSession))
    r.stage("dim_hs_code", "gold", ["bronze_hts"])(gold.dim_hs_code)
    r.stage("dim_ticker", "gold", ["bronze_10k", "silver_consignee_golden"])(gold.dim_ticker)
    r.stage("fact_shipments", "gold", ["silver_bol_shipments_scoped", "dim_hs_code", "dim_country"])(gold.fact_shipments)
    r.stage("fact_tariff_events", "gold", ["tariff_events"])(gold.fact_tariff_events)
    r.stage("fact_10k_risk_chunks", "gold", ["bronze_10k"])(gold.fact_10k_risk_chunks)
    r.stage("mart_concentration_metrics", "gold", ["fact_shipments"])(gold.mart_concentration_metrics)
    r.stage("mart_scenario_examples", "gold", ["fact_shipments", "dim_consignee"])(scenario.mart_scenario_examples)
    return r
