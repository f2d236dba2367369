"""Sources: bars from tables, sparse feeds and reference instruments joined to bars."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import KEY, TS
from ..operators.resample import bars_of

#: A reference instrument's series is broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals by priority."""
    return bars_of(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Hourly bars of event values by type."""
    return bars_of(read(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id", unit)


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of shipped prices by supplier."""
    lines = read(spark, sf_dir, "lineitem").withColumn("tie", F.struct("l_orderkey", "l_linenumber"))
    return bars_of(lines, "l_suppkey", "l_shipdate", "l_extendedprice", "tie", "month")


def with_feed(bars: DataFrame, facts: DataFrame, prefix: str, columns: list[str], **where: str) -> DataFrame:
    """Bars with a sparse feed's columns (prefix:column) at equal asset and time; where
    selects the feed's rows (a period or dividend type)."""
    for k, v in where.items():
        facts = facts.where(F.col(k) == v)
    return bars.join(facts.select(KEY, TS, *[F.col(c).alias(f"{prefix}:{c}") for c in columns]), [KEY, TS], "left")


def with_reference(bars: DataFrame, reference: DataFrame, prefix: str, ticker: str) -> DataFrame:
    """Bars with another instrument's o, h, l, c at equal times."""
    one = reference.where(F.col(KEY) == ticker).select(TS, *[F.col(c).alias(f"{prefix}:{ticker}:{c}") for c in ("c", "o", "h", "l")])
    return bars.join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, TS, "left")


@dataclass(frozen=True)
class Feed:
    """A sparse feed: the prefix of its columns, their types, and options that select rows
    by a column (option: its values, the first by default)."""

    prefix: str
    columns: dict[str, str]
    options: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _typed(**kinds: str) -> dict[str, str]:
    return {c: kind for kind, names in kinds.items() for c in names.split()}


def _filing(numbers: str) -> Feed:
    columns = _typed(string="ticker timeframe", timestamp="filing_date period_end", int="fiscal_year fiscal_quarter", double=numbers)
    return Feed("", columns, {"timeframe": ("quarterly", "annual")})


# The feeds' prefixes, columns and options.
FEEDS = {
    "dividends": Feed("D:", _typed(string="ticker id currency dividend_type", double="cash_amount", long="frequency", timestamp="declaration_date record_date pay_date"), {"dividend_type": ("CD", "SC", "LT", "ST")}),
    "short_volume": Feed("SV:", _typed(string="ticker", int="short_volume total_volume exempt_volume non_exempt_volume", double="short_volume_ratio")),
    "short_interest": Feed("SI:", _typed(string="ticker", int="short_interest avg_daily_volume", double="days_to_cover")),
    "news": Feed("N:", _typed(string="id title author description article_url amp_url image_url tickers keywords publisher_name publisher_homepage")),
    "splits": Feed("S:", _typed(string="ticker id", double="split_from split_to split_ratio")),
    "ticker_events": Feed("TE:", _typed(double="event_type_id")),
    "balance_sheet": _filing("accounts_payable accrued_liabilities aoci cash debt_current deferred_revenue goodwill intangible_assets_net inventories lt_debt ppe_net receivables retained_earnings"),
    "income_statement": _filing("basic_eps diluted_eps revenue cogs gross_profit operating_income net_income rd sga"),
    "cash_flow": _filing("cfo change_cash change_assets dda dividends lt_debt_issuances ncf_financing ncf_investing ncf_operating net_income capex"),
    "financial_ratios": Feed("R:", _typed(string="ticker", double="average_volume cash current debt_to_equity dividend_yield earnings_per_share enterprise_value ev_to_ebitda ev_to_sales free_cash_flow market_cap price price_to_book price_to_cash_flow price_to_earnings price_to_free_cash_flow price_to_sales quick return_on_assets return_on_equity")),
}
_FILING_PREFIX = {"balance_sheet": "BS:", "income_statement": "IS:", "cash_flow": "CF:"}
# The kinds of reference instruments and the prefixes of their columns.
REFERENCES = {
    "common_indices": "IDX", "indices": "IDX", "common_reference_stocks": "STK", "reference_stocks": "STK", "common_fx_pairs": "FX", "fx_pairs": "FX", "common_crypto_pairs": "CRYPTO", "crypto_pairs": "CRYPTO",
}


def prefix_of(name: str) -> str:
    return _FILING_PREFIX.get(name, FEEDS[name].prefix)


def with_feed_id(bars: DataFrame, facts: DataFrame, name: str, **options: str) -> DataFrame:
    """Bars with the columns of the feed of that name, whose facts have asset_id, ts and the
    columns of its schema, at equal asset and time. Options select the facts' rows: a
    filing's timeframe, a dividend's type. An option or a value that the feed has not, and
    facts without a column of the schema, are errors."""
    feed = FEEDS[name]
    where = {k: v[0] for k, v in feed.options.items()} | options
    for k, v in where.items():
        if v not in feed.options.get(k, ()):
            raise ValueError(f"{name} has no {k} {v}")
    missing = [c for c in feed.columns if c not in facts.columns]
    if missing:
        raise ValueError(f"{name} lacks {missing}")
    return with_feed(bars, facts, prefix_of(name).rstrip(":"), list(feed.columns), **where)


def economic_indicator(bars: DataFrame, facts: DataFrame, category: str) -> DataFrame:
    """Bars with a macro series, facts(category, ts, observation_date, value, revision), at
    equal times, the same for every asset."""
    one = facts.where(F.col("category") == category).select(TS, *[F.col(c).alias(f"ECON:{category}:{c}") for c in ("observation_date", "value", "revision")])
    return bars.join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, TS, "left")


def with_reference_id(bars: DataFrame, reference: DataFrame, name: str, ticker: str) -> DataFrame:
    """Bars with the o, h, l, c of a reference instrument of that kind."""
    return with_reference(bars, reference, REFERENCES[name], ticker)
