"""A semantic layer: named dimensions and metrics, compiled to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SemanticError(ValueError):
    """A request the model can't answer."""


class UnknownIdentifierError(SemanticError):
    """Not declared, or declared by more than one table."""


class UnrelatedEntitiesError(SemanticError):
    """A dimension that can't be reached from what is measured."""


@dataclass(frozen=True)
class Relationship:
    """Many rows of ``source`` point to one of ``target``."""

    source: str
    key: str
    target: str
    target_key: str
    name: str = ""


@dataclass(frozen=True)
class Dimension:
    table: str
    name: str
    expr: str
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Metric:
    table: str
    name: str
    agg: str  # count, sum, avg, max or min
    column: str = "*"
    synonyms: tuple[str, ...] = ()

    def of(self) -> Column:
        return F.count("*") if self.column == "*" else getattr(F, self.agg)(self.column)


@dataclass
class Model:
    keys: dict[str, tuple[str, ...]]
    relationships: list[Relationship] = field(default_factory=list)
    dimensions: list[Dimension] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)

    def _find(self, items: list, name: str):
        low = name.lower()
        table, _, short = low.rpartition(".")
        hits = [x for x in items if x.name.lower() == short and table in ("", x.table.lower())] or [x for x in items if low in (s.lower() for s in x.synonyms)]
        if len(hits) != 1:
            raise UnknownIdentifierError(f"{name} is {'ambiguous: ' + ', '.join(f'{x.table}.{x.name}' for x in hits) if hits else 'not declared'}")
        return hits[0]

    def dimension(self, name: str) -> Dimension:
        return self._find(self.dimensions, name)

    def metric(self, name: str) -> Metric:
        return self._find(self.metrics, name)

    def reach(self, table: str) -> dict[str, list[Relationship]]:
        """The tables that one leads to along relationships, with the way."""
        out: dict[str, list[Relationship]] = {table: []}
        todo = [table]
        while todo:
            at = todo.pop(0)
            for r in self.relationships:
                if r.source == at and r.target not in out:
                    out[r.target] = [*out[at], r]
                    todo.append(r.target)
        return out

    def query(self, tables: dict[str, DataFrame], metrics: Sequence[str] = (), dimensions: Sequence[str] = (), where: Sequence[tuple] = ()) -> DataFrame:
        """Metrics by dimensions. ``where``: (dimension or column of a fact, operator, value) with =, !=, <, <=, >, >= or in; filters come before aggregation.

        Facts keep rows without a partner in a dimension. Metrics of two facts
        are aggregated apart and joined over the dimensions, nulls included,
        which must be reached from both.
        """
        ms = [self.metric(m) for m in metrics]
        ds = [self.dimension(d) for d in dimensions]
        fs = [(self.dimension(n), op, v) for n, op, v in where]
        owners = list(dict.fromkeys(m.table for m in ms)) or list(dict.fromkeys(d.table for d in ds if any(r.source == d.table for r in self.relationships))) or [ds[0].table] if ds or ms else []
        if not owners:
            raise SemanticError("nothing is asked for")
        if not ms:
            common = [t for t in self.keys if all(d.table in self.reach(t) for d in [*ds, *[f[0] for f in fs]])]
            if not common:
                raise UnrelatedEntitiesError("no table leads to all of " + ", ".join(sorted({d.table for d in ds})))
            owners = [min(common, key=lambda t: sum(map(len, (self.reach(t)[d.table] for d in ds))))]
        names = [d.name for d in ds]
        if len(set(names)) < len(names):
            raise SemanticError("two dimensions have one name")
        parts = []
        for owner in owners:
            way = self.reach(owner)
            for d in [*ds, *[f[0] for f in fs]]:
                if d.table not in way:
                    raise UnrelatedEntitiesError(f"the requested entities are not related: {owner} doesn't lead to {d.table}")
            parts.append(self._one(tables, owner, way, ds, fs, [m for m in ms if m.table == owner]))
        out = parts[0]
        for p in parts[1:]:
            right = p.select(*[F.col(n).alias(f"__r_{n}") for n in names], *[c for c in p.columns if c not in names])
            on = [F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names]
            joined = out.join(right, on, "full") if on else out.crossJoin(right)
            out = joined.select(*[F.coalesce(n, f"__r_{n}").alias(n) for n in names], *[c for c in joined.columns if c not in names and not c.startswith("__r_")])
        return out.select(*names, *[m.name for m in ms])

    def _one(self, tables, owner, way, ds, fs, ms) -> DataFrame:
        def cols(t: str) -> DataFrame:
            """Only what is asked of a table, under names that can't clash."""
            need = {d.expr for d in [*ds, *[f[0] for f in fs]] if d.table == t} | {r.key for w in used for r in way[w] if r.source == t} | {r.target_key for w in used for r in way[w] if r.target == t}
            need |= {m.column for m in ms if m.table == t and m.column != "*"}
            return tables[t].select(*[F.col(c).alias(f"{t}__{c}") for c in sorted(need)])

        used = list(dict.fromkeys(d.table for d in [*ds, *[f[0] for f in fs]]))
        steps = list(dict.fromkeys(r for t in used for r in way[t]))
        df = cols(owner)
        if not df.columns:
            df = tables[owner].select(F.lit(1).alias("__one"))
        for r in steps:
            df = df.join(cols(r.target), F.col(f"{r.source}__{r.key}") == F.col(f"{r.target}__{r.target_key}"), "left")
        for d, op, v in fs:
            c = F.col(f"{d.table}__{d.expr}")
            tests = {"=": lambda: c == F.lit(v), "!=": lambda: c != F.lit(v), "<": lambda: c < F.lit(v), "<=": lambda: c <= F.lit(v), ">": lambda: c > F.lit(v), ">=": lambda: c >= F.lit(v), "in": lambda: c.isin(*v)}
            if op not in tests:
                raise SemanticError(f"no operator {op}")
            df = df.filter(tests[op]())
        by = [F.col(f"{d.table}__{d.expr}").alias(d.name) for d in ds]
        if not ms:
            return df.select(*by).distinct()
        aggs = [(F.count("*") if m.column == "*" else getattr(F, m.agg)(f"{m.table}__{m.column}")).alias(m.name) for m in ms]
        return df.groupBy(*by).agg(*aggs)


def _dims(table: str, spec: str) -> list[Dimension]:
    """``name(synonym; synonym)`` entries, separated by bars."""
    out = []
    for item in spec.split("|"):
        name, _, syn = item.strip().rstrip(")").partition("(")
        out.append(Dimension(table, name, name, tuple(s.strip() for s in syn.split(";") if s.strip())))
    return out


def shipment_model() -> Model:
    """Facts shipments and concentration over consignees, suppliers, codes, countries and days."""
    fact, mart = "fact_shipments", "mart_concentration_metrics"
    m = Model({"dim_consignee": ("consignee_key",), "dim_country": ("country_code",), "dim_date": ("date_key",), "dim_hs_code": ("hs_6",), "dim_supplier": ("supplier_key",), fact: ("shipment_key",), mart: ("consignee_key", "hs_6")})
    for target, keys in m.keys.items():
        if target.startswith("dim_"):
            m.relationships.append(Relationship(fact, {"country_code": "origin_country_code"}.get(keys[0], keys[0]), target, keys[0]))
    m.relationships += [Relationship(mart, "hs_6", "dim_hs_code", "hs_6", "mart_code"), Relationship(mart, "consignee_key", "dim_consignee", "consignee_key", "mart_consignee")]
    m.dimensions += _dims(fact, "consignee_party_type(importer type; consignee type) | hs_source_final(HS source; classification method) | origin_country_code(source country; country of origin) | hs_6(tariff code; HTS code; HS code)")
    m.dimensions += _dims("dim_consignee", "is_forwarder(freight forwarder; is forwarder) | consignee_name(company name; importer name)")
    m.dimensions += _dims("dim_supplier", "supplier_country_code(supplier country) | supplier_name(exporter; shipper name)")
    m.dimensions += _dims("dim_hs_code", "hs_6_description(tariff description; product description) | hs_6(subheading; HS-6 code) | hs_4_description(heading description) | hs_4(heading; HS heading) | hs_2_description(chapter description) | hs_2(chapter; HS chapter)")
    m.dimensions += _dims("dim_country", "is_section_301_target | is_section_232_target | region | country_name")
    m.dimensions += _dims("dim_date", "month | year | date_day(shipment date; date)")
    m.dimensions += _dims(mart, "is_single_country(geographic concentration; single-country) | is_single_source(sole-source dependency; single-source)")
    for name, agg, col, *syn in (
        ("total_shipments", "count", "*", "number of shipments", "shipment count"), ("total_weight_kg", "sum", "weight_kg", "aggregate weight", "total weight"), ("total_value_usd", "sum", "shipment_value_usd", "customs value", "total value"),
        ("total_landed_cost_usd", "sum", "estimated_landed_cost_usd", "total cost with duties", "tariff exposure", "landed cost"), ("avg_effective_duty_rate", "avg", "effective_duty_rate_pct", "mean tariff rate", "average duty rate"),
    ):
        m.metrics.append(Metric(fact, name, agg, col, tuple(syn)))
    m.metrics += [Metric(mart, "max_country_hhi", "max", "country_hhi", ("geographic HHI", "country concentration")), Metric(mart, "max_supplier_hhi", "max", "supplier_hhi", ("HHI on suppliers", "supplier concentration"))]
    return m


def sample_questions(tables: dict[str, DataFrame], model: Model | None = None) -> dict[str, DataFrame]:
    """Ten questions put to the layer, with what SQL around it would add."""
    from portolan.operators.relational import count_distinct_over

    q = (model or shipment_model()).query
    ask = lambda metrics, dims, where=(): q(tables, metrics.split(), dims.split(), where)
    last = lambda c: F.col(c).desc_nulls_last()
    both = "total_shipments total_landed_cost_usd"
    named = ask("total_shipments", "consignee_name dim_hs_code.hs_6 supplier_name", [("hs_4", "=", "8708")])
    return {
        "s1": ask(both, "consignee_name").orderBy(last("total_landed_cost_usd"), "consignee_name").limit(10),
        "s2": ask("max_supplier_hhi", "consignee_name dim_hs_code.hs_6 is_single_source", [("hs_2", "=", "87"), ("is_single_source", "=", True)]).orderBy(last("max_supplier_hhi"), "consignee_name", "hs_6").limit(10),
        "s3": ask(both, "hs_2 hs_2_description", [("origin_country_code", "=", "CN")]).orderBy(last("total_landed_cost_usd"), "hs_2").limit(10),
        "s4": ask(both, "supplier_name supplier_country_code hs_4", [("supplier_country_code", "=", "DE"), ("hs_4", "=", "8708")]).orderBy(last("total_shipments"), "supplier_name").limit(10),
        "s5": ask(both + " avg_effective_duty_rate", "hs_2 hs_2_description", [("is_section_232_target", "=", True), ("hs_2", "in", ["72", "73", "76"])]).orderBy(last("total_landed_cost_usd"), "hs_2"),
        "s6": ask("total_shipments", "consignee_name", [("is_forwarder", "=", True)]).orderBy(last("total_shipments"), "consignee_name").limit(20),
        "s7": ask("total_shipments", "year month", [("year", "=", 2018)]).orderBy("month"),
        "s8": ask("max_supplier_hhi total_shipments", "consignee_name hs_6_description").filter("total_shipments >= 5").orderBy(last("max_supplier_hhi"), "consignee_name", "hs_6_description").limit(10),
        "s9": ask("total_shipments", "country_name", [("is_section_232_target", "=", True)]).orderBy(last("total_shipments"), "country_name"),
        "s10": count_distinct_over(named, ["consignee_name", "hs_6"], "supplier_name", "supplier_count").filter("supplier_count = 1").drop("supplier_count").orderBy(last("total_shipments"), "consignee_name", "hs_6").limit(10),
    }
