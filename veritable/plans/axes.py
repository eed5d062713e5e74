"""Analysis axes as data: which charts answer a question, and which columns they need.

A chart rule names an axis, a chart builder and the *slots* it takes. A slot is
a role in the analysis (the measure, the date, the product column, ...) that
``fill_slots`` binds to a column of the table, or leaves open. A rule whose
slots are all bound gives a chart; an axis is offered if its need is bound.
So there is no code per axis, only rows in ``CHARTS`` and ``OFFERS``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from veritable.operators import charts as CH
from veritable.operators import profile as P

# Words that tell a column's part in an analysis, by the pool it is looked for in.
WORDS = {
    "sales_channel": ("category", ("channel", "source", "medium")),
    "channel": ("category", ("channel", "source", "campaign", "medium")),
    "customer": ("category", ("customer", "client", "account", "segment")),
    "segment": ("category", ("segment", "tier", "class", "type")),
    "product": ("category", ("product", "category", "item", "sku", "service")),
    "line": ("category", ("product", "category", "item", "service")),
    "sort": ("category", ("product", "category", "item")),
    "range": ("category", ("product", "category", "segment")),
    "region": ("category", ("region", "city", "country", "state", "branch", "area")),
    "place": ("category", ("place", "location", "region", "country", "city", "station", "net")),
    "status": ("category", ("status", "state", "stage", "shipping", "delivery")),
    "quantity": ("measure", ("quantity", "qty", "units")),
    "discount": ("measure", ("discount",)),
    "margin": ("measure", ("margin",)),
    "gain": ("measure", ("profit",)),
    "earnings": ("measure", ("profit", "margin", "cost")),
    "lifetime_value": ("measure", ("customer_total_value",)),
}
PRIMARY_WORDS = (("revenue",), ("sales", "total"), ("amount", "value"), ("profit",))
CALENDAR_NUMBERS = ("year", "month", "day", "week", "day_of_month")
DERIVED_MEASURES = ("profit", "profit_margin_pct", "net_revenue", "revenue_per_unit")
DERIVED_CATEGORIES = ("month_name", "quarter", "day_of_week", "revenue_tier", "year")
SEASONS = ("month_name", "quarter", "day_of_week")
CATEGORY_SIZES = (2, 60)
ENTITY_WORDS = ("customer", "client", "account", "buyer")


@dataclass(frozen=True)
class Rule:
    axis: str
    chart: str
    slots: tuple[str, ...]
    how: str | None = None


# The charts of each axis, in order. "usual" is the measure's own aggregation (mean unless stated).
CHARTS = (
    Rule("sales", "trend", ("date", "measure")), Rule("sales", "bar", ("season", "measure")),
    Rule("sales", "bar", ("sales_channel", "measure")), Rule("sales", "distribution", ("measure",)),
    Rule("customers", "bar", ("customer", "measure")), Rule("customers", "box", ("segment", "measure")),
    Rule("customers", "distribution", ("lifetime_value",)), Rule("customers", "trend", ("date", "measure")),
    Rule("products", "bar", ("product", "measure")), Rule("products", "bar", ("product", "margin"), "mean"),
    Rule("products", "box", ("product", "measure")), Rule("products", "scatter", ("quantity", "measure")),
    Rule("marketing", "bar", ("channel", "measure")), Rule("marketing", "box", ("channel", "measure")),
    Rule("marketing", "pivot", ("channel", "sort", "measure")), Rule("marketing", "scatter", ("discount", "measure")),
    Rule("profits", "trend", ("date", "profit")), Rule("profits", "bar", ("line", "profit")),
    Rule("profits", "distribution", ("margin",)), Rule("profits", "box", ("line", "margin")),
    Rule("profits", "scatter", ("measure", "gain")),
    Rule("regions", "bar", ("region", "measure")), Rule("regions", "box", ("region", "measure")),
    Rule("regions", "pivot", ("region", "range", "measure")), Rule("regions", "trend", ("date", "measure")),
    Rule("operations", "bar", ("status", "measure"), "count"), Rule("operations", "bar", ("weekday", "measure")),
    Rule("operations", "distribution", ("quantity",)), Rule("operations", "trend", ("date", "quantity")),
    Rule("time", "trend", ("date", "measure"), "count"), Rule("time", "trend", ("date", "measure"), "usual"),
    Rule("comparisons", "bar", ("main_category", "measure"), "usual"),
    Rule("comparisons", "bar", ("main_category", "measure"), "count"), Rule("comparisons", "box", ("main_category", "measure")),
    Rule("locations", "bar", ("where", "measure"), "usual"), Rule("locations", "bar", ("where", "measure"), "count"),
    Rule("locations", "box", ("where", "measure")),
    Rule("distributions", "distribution", ("each_measure",)),
    Rule("relationships", "correlation", ("all_measures",)), Rule("relationships", "scatter", ("measure", "second_measure")),
    Rule("quality", "completeness", ()),
    Rule("general", "trend", ("date", "measure"), "general"), Rule("general", "distribution", ("measure",)),
    Rule("general", "correlation", ("all_measures",)), Rule("general", "completeness", ()),
)
AXES = tuple(dict.fromkeys(r.axis for r in CHARTS if r.axis != "general"))

# An axis is offered if one of these groups of slots is bound; the first of each list is the fallback.
OFFERS = {
    True: (("sales", (("measure",),)), ("customers", (("customer",),)), ("products", (("product",),)),
           ("marketing", (("channel",), ("discount",))), ("profits", (("earnings",),)), ("regions", (("region",),)),
           ("operations", (("status",), ("quantity",)))),
    False: (("quality", (("blanks",),)), ("time", (("date", "measure"),)), ("comparisons", (("main_category", "measure"),)),
            ("distributions", (("measure",),)), ("relationships", (("second_measure",),)), ("locations", (("place",),))),
}


@dataclass
class Slots:
    """The table's columns by part: pools, and the column (or columns) each slot is bound to."""

    pools: dict[str, list[str]]
    bound: dict[str, str | list[str] | None]
    distinct: dict[str, int]
    usual: dict[str, str]
    business: bool

    def __getitem__(self, slot: str):
        return self.bound.get(slot)

    def entity(self, *words: str) -> str | None:
        """Of the label columns so named, the one with the most values: it names things, not groups of them."""
        hits = [c for c in self.pools["label"] if any(w in c.casefold() for w in words or ENTITY_WORDS)]
        return max(hits, key=lambda c: self.distinct.get(c, 0), default=None)


def fill_slots(profile_rows: list[dict], present: list[str], business: bool = True, usual: dict[str, str] | None = None,
               preferred: dict[str, str] | None = None) -> Slots:
    """C11: bind the slots from profile rows. ``preferred`` may name the ``measure`` and ``main_category`` to start from."""
    rows = [r for r in profile_rows if r["column_name"] in present]
    low, high = CATEGORY_SIZES

    def pool(test, extra: tuple[str, ...] = ()) -> list[str]:
        own = [r["column_name"] for r in rows if test(r)]
        return list(dict.fromkeys([*own, *(c for c in extra if c in present)]))

    pools = {
        "date": pool(lambda r: r["role"] == "datetime"),
        "measure": pool(lambda r: r["role"] == "measure" and r["column_name"] not in CALENDAR_NUMBERS, DERIVED_MEASURES),
        "category": pool(lambda r: r["role"] in ("category", "boolean") and low <= r["unique_count"] <= high, DERIVED_CATEGORIES),
        "label": pool(lambda r: r["role"] in ("category", "identifier", "text", "boolean")),
        "blanks": pool(lambda r: r.get("missing_count", 0) > 0),
    }

    def first(kind: str, words) -> str | None:
        return next((c for c in pools[kind] if any(w in c.casefold() for w in words)), None)

    preferred = {k: c for k, c in (preferred or {}).items() if c in pools["measure"] + pools["category"]}
    measures, categories = pools["measure"], pools["category"]
    by_name = (first("measure", words) for words in PRIMARY_WORDS)
    measure = preferred.get("measure") or next(filter(None, by_name), None) or next(iter(measures), None)
    bound: dict = {slot: first(*looked) for slot, looked in WORDS.items()}
    bound |= {
        "measure": measure, "date": next(iter(pools["date"]), None), "blanks": next(iter(pools["blanks"]), None),
        "season": next((c for c in SEASONS if c in categories), None),
        "weekday": "day_of_week" if "day_of_week" in categories else None,
        "main_category": preferred.get("main_category") or next(iter(categories), None),
        "each_measure": sorted(measures, key=lambda c: c != measure), "all_measures": measures,
        "second_measure": next((c for c in measures if c != measure), None),
    }
    bound["profit"] = bound["gain"] or measure
    bound["where"] = bound["place"] or bound["main_category"]
    if bound["gain"] == measure:
        bound["gain"] = None
    return Slots(pools, bound, {r["column_name"]: r["unique_count"] for r in rows}, usual or {}, business)


def available_axes(slots: Slots) -> list[str]:
    """The axes the table supports, in the order of ``AXES``; never none."""
    offers = OFFERS[slots.business]
    found = {axis for axis, needs in offers if any(all(slots[s] for s in need) for need in needs)}
    return [a for a in AXES if a in found] or [offers[0][0]]


BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "trend": lambda df, how, date, measure: CH.trend(df, date, measure, how or "sum"),
    "bar": lambda df, how, group, measure: CH.category_bar(df, group, measure, how or "sum"),
    "box": lambda df, how, group, measure: CH.box_summary(df, group, measure),
    "distribution": lambda df, how, measure: CH.distribution(df, measure)[0],
    "scatter": lambda df, how, x, y: CH.scatter_relationship(df, x, y),
    "pivot": lambda df, how, row, column, measure: CH.pivot_sum(df, row, column, measure),
    "correlation": lambda df, how, measures: CH.correlation_matrix(df, measures),
    "completeness": lambda df, how: P.completeness(df),
}


def build_charts(df: DataFrame, slots: Slots, axes: list[str], general: bool = True) -> dict[str, tuple[str, str, DataFrame]]:
    """Chart id -> (axis, kind, table) of the general charts and of each axis; equal charts come once.

    The first axis that has a chart keeps it, general charts come first.
    """
    out: dict[str, tuple[str, str, DataFrame]] = {}
    for axis in [*(["general"] if general else []), *axes]:
        for rule in (r for r in CHARTS if r.axis == axis):
            columns = [slots[s] for s in rule.slots]
            if not all(columns) or (rule.chart == "pivot" and columns[0] == columns[1]):
                continue
            many = rule.slots == ("each_measure",)
            for own in ([[c] for c in columns[0]] if many else [columns]):
                how = {"usual": slots.usual.get(str(own[-1]), "mean"), "general": "sum" if slots.business else "count"}.get(
                    rule.how or "", rule.how) if own else None
                names = [c if isinstance(c, str) else "all" for c in own]
                chart_id = "_".join([rule.chart, *names, *([how or "sum"] if rule.chart in ("trend", "bar") else [])])
                if chart_id not in out:
                    out[chart_id] = (axis, rule.chart, BUILDERS[rule.chart](df, how, *own))
    return out
