"""Fundamental metrics from company statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cagr, growth, mean_of, number, ratio, truthy

ANNUAL_LAG, QUARTER_LAG = 75, 50

#: Concept: line items that vendors name it by, the best first (fixed values).
ALIASES = {
    "rev": ["Total Revenue", "Operating Revenue"],
    "ebit": ["EBIT", "Operating Income"],
    "opinc": ["Operating Income", "EBIT"],
    "ebitda": ["EBITDA", "Normalized EBITDA"],
    "ni": ["Net Income Common Stockholders", "Net Income", "Net Income From Continuing Operation Net Minority Interest"],
    "pbt": ["Pretax Income"],
    "intr": ["Interest Expense", "Interest Expense Non Operating", "Total Other Finance Cost"],
    "eps": ["Diluted EPS", "Basic EPS"],
    "dep": ["Reconciled Depreciation", "Depreciation And Amortization", "Depreciation Amortization Depletion"],
    "oth": ["Other Non Operating Income Expenses", "Other Income Expense"],
    "eq": ["Stockholders Equity", "Common Stock Equity", "Total Equity Gross Minority Interest"],
    "debt": ["Total Debt"],
    "cash": ["Cash Cash Equivalents And Short Term Investments", "Cash And Cash Equivalents"],
    "cur_a": ["Current Assets"],
    "cur_l": ["Current Liabilities"],
    "recv": ["Accounts Receivable", "Receivables", "Gross Accounts Receivable"],
    "inv": ["Inventory"],
    "ta": ["Total Assets"],
    "nppe": ["Net PPE"],
    "gppe": ["Gross PPE"],
    "shares_a": ["Ordinary Shares Number", "Share Issued"],
    "cfo": ["Operating Cash Flow", "Cash Flow From Continuing Operating Activities"],
    "capex": ["Capital Expenditure"],
    "fcf": ["Free Cash Flow"],
    "divp": ["Cash Dividends Paid", "Common Stock Dividend Paid"],
    "nii": ["Net Interest Income"],
    "prov": ["Credit Losses Provision", "Provision For Loan Lease And Other Losses"],
}


def resolve(lines: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Long lines (symbol, stmt, item, period_end, value) to (symbol, stmt, concept, period_end, value).

    A concept takes the first of its aliases that has any value in that statement, and takes that alias's whole series.
    """
    pairs = [(c, a, i) for c, names in (aliases or ALIASES).items() for i, a in enumerate(names)]
    known = lines.sparkSession.createDataFrame(pairs, "concept string, item string, place int")
    named = lines.withColumn("value", number(F.col("value"))).where("value is not null").join(F.broadcast(known), "item")
    best = F.min("place").over(Window.partitionBy("symbol", "stmt", "concept"))
    return named.withColumn("best", best).where("place = best").select("symbol", "stmt", "concept", "period_end", "value")


def wide(resolved: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """(symbol, period_end) rows with a column a concept; the list of concepts is given, so no pass looks for them."""
    return resolved.groupBy("symbol", "period_end").pivot("concept", concepts or list(ALIASES)).agg(F.first("value"))


def point_in_time(statements: DataFrame, asof: Column, quarterly: bool) -> DataFrame:
    """Statements that were out by a day: annual ones 75 days after their period, quarterly ones 50."""
    return statements.where(F.col("period_end") <= F.date_sub(asof, QUARTER_LAG if quarterly else ANNUAL_LAG))


def newest_first(items: list[str]) -> Column:
    """As an aggregate: a company's statements, newest first; sorted once for all concepts."""
    return F.sort_array(F.collect_list(F.struct("period_end", *items)), False)


def series(statements: str, x: str) -> Column:
    """A concept's values of ``newest_first``, without those missing: positions, not dates, align them."""
    return F.filter(F.transform(statements, lambda r: r[x]), lambda v: v.isNotNull())


def dated(x: str) -> Column:
    return F.map_from_entries(F.collect_list(F.when(F.col(x).isNotNull(), F.struct(F.col("period_end").cast("string"), F.col(x)))))


def year_before(day: Column) -> Column:
    """By text: 29 February has none."""
    return F.concat((F.substring(day, 1, 4).cast("int") - 1).cast("string"), F.substring(day, 5, 6))


def is_lender(sector: Column, industry: Column) -> Column:
    s, i = F.lower(F.coalesce(sector, F.lit(""))), F.lower(F.coalesce(industry, F.lit("")))
    other = i.contains("capital markets") | i.contains("asset management") | i.contains("exchange")
    words = ["bank", "credit", "mortgage", "insurance", "financial conglomerate", "lending", "finance"]
    named = F.lit(False)
    for w in words:
        named = named | i.contains(w)
    return s.contains("financial") & ~other & (named | ((s == "financial services") & (i == "")))


def best_shares(built: Column, sheet: Column, income: Column, eps: Column) -> Column:
    """The count of shares nearest, by ratio, to what income per share implies; else the built one."""
    implied = F.when((eps != 0) & (income / eps > 0), income / eps)
    far = lambda c: F.abs(F.log(c / implied))
    b, s = F.when(built > 0, built), F.when(sheet > 0, sheet)
    return F.when(implied.isNull() | (b.isNull() & s.isNull()), built).when(b.isNull(), s).when(s.isNull(), b).when(far(s) < far(b), s).otherwise(b)


def shares_note(built: Column, used: Column) -> Column:
    return F.when((used / built > 1.25) | (used / built < 0.8), F.format_string("Share count %.0f used instead of %.0f", used, built))


def fx(equity: Column, book: Column, shares: Column) -> Column:
    """Rate of statements in another currency: where book value times shares is 40 to 150 times the equity; else 1."""
    r = F.when(equity > 0, book * shares / equity)
    return F.coalesce(F.when((r > 40) & (r < 150), F.round(r, 2)), F.lit(1.0))


def _ttm(fy: str, quarters: str) -> tuple[Column, Column]:
    """Newest year, plus the quarters after it, less the same quarters a year earlier, if all those exist; and whether quarters were used."""
    m, year, end = F.col(quarters), F.get(F.col(fy), F.lit(0)), F.col("fy_latest").cast("string")
    after = F.filter(F.map_keys(m), lambda d: d > end)
    known = F.forall(after, lambda d: F.map_contains_key(m, year_before(d)))
    change = F.aggregate(F.array_sort(after), F.lit(0.0), lambda acc, d: acc + F.element_at(m, d) - F.try_element_at(m, year_before(d)))
    used = F.coalesce((F.size(after) > 0) & known & year.isNotNull(), F.lit(False))
    return F.when(used, year + change).otherwise(year), used


def _yoy(quarters: str, k: int) -> Column:
    m = F.col(quarters)
    day = F.get(F.sort_array(F.map_keys(m), False), F.lit(k))
    return growth(F.try_element_at(m, day), F.try_element_at(m, year_before(day)))


ANNUAL = ["rev", "ni", "ebit", "ebitda", "intr", "pbt", "oth", "dep", "cfo", "capex", "divp", "recv", "inv", "ta", "eq", "cash", "cur_a", "cur_l", "debt", "shares_a", "gppe", "nii", "prov", "fcf", "eps"]
QUARTERS = ["rev", "ni", "ebit"]


def fundamentals(annual: DataFrame, quarterly: DataFrame, companies: DataFrame, prices: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All metrics, one row a company that has statements: companies ⋈ annual and quarterly statements ⋈ prices (symbol, price). ``by``: columns of statements and prices, such as a day they are known on, that rows are kept apart by.

    Annual series are positional arrays, quarters maps by date; everything else is plain column algebra over that row.
    """
    key = [*by, "symbol"]
    a = annual.groupBy(*key).agg(newest_first(ANNUAL).alias("_annual"), F.max(F.when(F.col("rev").isNotNull(), F.col("period_end"))).alias("fy_latest"))
    a = a.select(*key, *[series("_annual", x).alias(x) for x in ANNUAL], "fy_latest")
    q = quarterly.groupBy(*key).agg(*[dated(x).alias("q_" + x) for x in QUARTERS], F.max(F.when(F.col("rev").isNotNull(), F.col("period_end"))).alias("q_latest"), F.count("rev").alias("n_q"))
    return metrics(companies.join(a, "symbol").join(q, key, "left").join(prices, key, "left"))


def histories(annual: DataFrame, quarterly: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies that have annual statements, one row each, with all their statements, newest first: ``_annual`` and ``_quarters``."""
    a, q = annual.groupBy("symbol").agg(newest_first(ANNUAL).alias("_annual")), quarterly.groupBy("symbol").agg(newest_first(QUARTERS).alias("_quarters"))
    return companies.join(a, "symbol").join(q, "symbol", "left")


def known_on(histories: DataFrame, prices: DataFrame, day: str) -> DataFrame:
    """``fundamentals`` of each row of ``prices`` (symbol, ``day``, price) from the statements that were out on its day; companies without an annual one then are left out.

    A company's statements stay one row until they meet its days, so none is shuffled once a day.
    """
    out = lambda c, lag: F.filter(c, lambda r: r["period_end"] <= F.date_sub(F.col(day), lag))
    d = prices.join(histories, "symbol").withColumns({"_annual": out("_annual", ANNUAL_LAG), "_quarters": out("_quarters", QUARTER_LAG)}).where(F.size("_annual") > 0)
    d = d.withColumn("_quarters", F.when(F.size("_quarters") > 0, F.col("_quarters")))
    dates = lambda c: F.transform(F.filter(c, lambda r: r["rev"].isNotNull()), lambda r: r["period_end"])
    entries = lambda x: F.transform(F.filter("_quarters", lambda r: r[x].isNotNull()), lambda r: F.struct(r["period_end"].cast("string"), r[x]))
    d = d.withColumns({x: series("_annual", x) for x in ANNUAL} | {"q_" + x: F.map_from_entries(entries(x)) for x in QUARTERS} | {"fy_latest": F.get(dates("_annual"), F.lit(0)), "q_latest": F.get(dates("_quarters"), F.lit(0)), "n_q": F.size(dates("_quarters"))})
    return metrics(d.drop("_annual", "_quarters"))


def metrics(d: DataFrame) -> DataFrame:
    """All metrics by column algebra over companies with their price, ``ANNUAL`` as arrays, newest first, and ``QUARTERS`` as maps by date."""
    at = lambda x, k=0: F.get(F.col(x), F.lit(k))
    n = lambda x: F.size(F.col(x))
    col = F.col
    d = d.withColumn("stmt_fx", fx(at("eq"), at("eq") / col("shares") * col("book_fx"), col("shares")))
    d = d.withColumns({x: F.transform(x, lambda v: v * F.col("stmt_fx")) for x in ANNUAL if x != "shares_a"})
    d = d.withColumns({x: F.transform_values(x, lambda _, v: v * F.col("stmt_fx")) for x in ("q_rev", "q_ni", "q_ebit")})
    d = d.withColumn("shares_used", best_shares(col("shares"), at("shares_a"), at("ni"), at("eps")))
    d = d.withColumn("mcap", col("price") * col("shares_used"))
    rev_ttm, _ = _ttm("rev", "q_rev")
    pat_ttm, used = _ttm("ni", "q_ni")
    margin = F.when(n("ebitda") > 0, col("ebitda")).otherwise(col("ebit"))
    capital = lambda k: at("eq", k) + F.coalesce(at("debt", k), F.lit(0.0))
    three = lambda f: mean_of(*[f(k) for k in range(3)])
    n3 = F.least(F.lit(3), n("cfo"), n("ni"))
    total = lambda x: F.aggregate(F.slice(x, 1, n3), F.lit(0.0), lambda s, v: s + v)
    flows = F.when(n("fcf") > 0, col("fcf")).otherwise(F.zip_with(F.slice("cfo", 1, F.least(n("cfo"), n("capex"))), F.slice("capex", 1, F.least(n("cfo"), n("capex"))), lambda x, y: x + y))
    d = d.withColumns({
        "n_fy": n("rev"), "rev_ttm": rev_ttm, "pat_ttm": pat_ttm, "ttm_from_q": used, "m": margin, "flows": flows,
        "rev_fy": at("rev"), "pat_fy": at("ni"), "ebit_fy": at("ebit"), "ebitda_fy": at("ebitda"),
        "sales_g1": growth(at("rev"), at("rev", 1)), "pat_g1": growth(at("ni"), at("ni", 1)),
        "sales_g3": F.when(n("rev") > 3, cagr(at("rev"), at("rev", 3), 3)).when(n("rev") > 2, cagr(at("rev"), at("rev", 2), 2)),
        "pat_g3": F.when(n("ni") > 3, cagr(at("ni"), at("ni", 3), 3)).when(n("ni") > 2, cagr(at("ni"), at("ni", 2), 2)),
        "eps_g3": F.when(n("eps") > 3, cagr(at("eps"), at("eps", 3), 3)),
        "q_rev_yoy": _yoy("q_rev", 0), "q_pat_yoy": _yoy("q_ni", 0), "q_rev_yoy_prev": _yoy("q_rev", 1), "q_pat_yoy_prev": _yoy("q_ni", 1),
        "fcf_now": F.when(n("fcf") > 0, at("fcf")).otherwise(at("cfo") + at("capex")),
    })
    dq = F.get(F.sort_array(F.map_keys("q_rev"), False), F.lit(0))
    q_margin = lambda day: ratio(F.try_element_at("q_ebit", day), F.try_element_at("q_rev", day))
    opm = lambda k: ratio(at("m", k), at("rev", k))
    days = lambda x, k=0: ratio(at(x, k), at("rev", k)) * 365
    ev = col("mcap") + F.coalesce(at("debt"), F.lit(0.0)) - F.coalesce(at("cash"), F.lit(0.0))
    d = d.withColumns({
        "q_rev_accel": col("q_rev_yoy") - col("q_rev_yoy_prev"), "q_pat_accel": col("q_pat_yoy") - col("q_pat_yoy_prev"),
        "q_pat_qoq": F.lit(None).cast("double"),  # no quarter is held against the one before
        "ttm_pat_vs_fy": F.when(col("ttm_from_q"), growth(col("pat_ttm"), col("pat_fy"))),
        "opm": opm(0), "opm_3y_avg": three(opm), "opm_delta": opm(0) - three(opm), "opm_1y_delta": opm(0) - opm(1),
        "ebit_margin": ratio(at("ebit"), at("rev")), "npm": ratio(at("ni"), at("rev")), "q_opm": q_margin(dq), "q_opm_yoy_delta": q_margin(dq) - q_margin(year_before(dq)),
        "roe": ratio(at("ni"), truthy(mean_of(at("eq"), at("eq", 1)))), "roa": ratio(at("ni"), mean_of(at("ta"), at("ta", 1))), "roce": ratio(at("ebit"), capital(0)),
        "roce_3y_avg": three(lambda k: ratio(at("ebit", k), capital(k))), "roe_3y_avg": three(lambda k: ratio(at("ni", k), at("eq", k))),
        "de": F.when((n("debt") > 0) & (at("eq") > 0), ratio(at("debt"), at("eq"))).when((n("eq") > 0) & (n("debt") == 0), 0.0),
        "net_debt_ebitda": F.when(at("ebitda") > 0, ratio(at("debt") - F.coalesce(at("cash"), F.lit(0.0)), at("ebitda"))),
        "int_cover": F.when(at("intr") > 0, ratio(at("ebit"), at("intr"))), "current_ratio": ratio(at("cur_a"), at("cur_l")),
        "dilution_3y": F.when(n("shares_a") > 1, growth(at("shares_a"), F.get("shares_a", F.least(F.lit(3), n("shares_a") - 1)))),
        "debt_change_1y": F.when(at("debt", 1) > 0, growth(at("debt"), at("debt", 1))),
        "cfo_pat": F.when(at("ni") > 0, ratio(at("cfo"), at("ni"))), "cfo_pat_3y": F.when((n3 >= 2) & (total("ni") > 0), ratio(total("cfo"), total("ni"))),
        "fcf_yield": ratio(col("fcf_now"), truthy(col("mcap"))), "fcf_pos_years": F.when(n("flows") > 0, F.size(F.filter(F.slice("flows", 1, 3), lambda v: v > 0))),
        "capex_dep": F.when(at("dep") > 0, ratio(-at("capex"), at("dep"))), "capex_sales": ratio(-at("capex"), at("rev")), "div_payout": F.when(at("ni") > 0, ratio(-at("divp"), at("ni"))), "other_inc_pbt": F.when(at("pbt") > 0, ratio(at("oth"), at("pbt"))),
        "rec_days": days("recv"), "rec_days_prev": days("recv", 1), "rec_days_delta": days("recv") - days("recv", 1), "inv_days": days("inv"), "inv_days_delta": (ratio(at("inv"), at("rev")) - ratio(at("inv", 1), at("rev", 1))) * 365,
        "gross_block_g1": growth(at("gppe"), at("gppe", 1)),
        "pe": F.when(col("pat_ttm") > 0, ratio(col("mcap"), col("pat_ttm"))), "pe_yahoo": col("trailing_pe"), "pe_fwd": col("forward_pe"), "analyst_rec": col("recommended"), "promoter": F.coalesce(truthy(col("promoter")), col("promoter_held")), "institutions": F.coalesce(truthy(col("institutions")), col("institutions_held")), "pb": F.when(at("eq") > 0, ratio(col("mcap"), at("eq"))),
        "ev_ebitda": F.when(at("ebitda") > 0, ratio(ev, at("ebitda"))), "ev_sales": ratio(ev, truthy(col("rev_ttm"))), "ps": ratio(col("mcap"), truthy(col("rev_ttm"))),
        "analyst_upside": ratio(truthy(col("target_price")), truthy(col("current_price"))) - 1, "analyst_n": col("analysts"),
        "nii_g1": F.when(col("lender"), growth(at("nii"), at("nii", 1))), "prov_pct_nii": F.when(col("lender"), ratio(at("prov"), at("nii"))), "leverage": F.when(col("lender"), ratio(at("ta"), at("eq"))),
    })
    g = F.coalesce("pat_g3", "pat_g1")
    paid = F.coalesce(ratio(truthy(col("dividend_rate")), truthy(col("current_price"))), col("dividend_yield"))
    return d.withColumns({
        "peg": F.when(g > 0, ratio(truthy(col("pe")), g * 100)), "earnings_yield": F.coalesce(ratio(F.lit(1.0), truthy(col("pe"))), ratio(col("pat_ttm"), col("mcap"))),
        "div_yield": F.when(paid > 0.25, paid / 100).otherwise(paid), "shares_note": shares_note(col("shares"), col("shares_used")),
    })


# The items of a block, of years, of quarters, and of lenders alone.
BLOCK_YEARS = ["rev", "ebit", "ebitda", "ni", "eps", "intr", "oth", "eq", "debt", "cash", "recv", "inv", "shares_a", "gppe", "ta", "cfo", "capex", "fcf", "divp"]
BLOCK_QUARTERS = ["rev", "ebit", "ni", "eps"]
BLOCK_LENDER = ["nii", "prov"]


def financial_block(annual: DataFrame, quarterly: DataFrame, lenders: DataFrame, years: int = 4, quarters: int = 6) -> DataFrame:
    """The newest years' and quarters' figures, long: symbol, kind, k (0 = newest), period_end and the items; those of lenders for them alone, null where a kind has no such item.

    ``lenders``: symbol, lender.
    """

    def newest(df, kind, k, items):
        no = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end"))) - 1
        have = [F.col(x) if x in items and x in df.columns else F.lit(None).cast("double").alias(x) for x in BLOCK_YEARS + BLOCK_LENDER]
        return df.withColumn("k", no).where(F.col("k") < k).select("symbol", F.lit(kind).alias("kind"), "k", "period_end", *have)

    out = newest(annual, "a", years, BLOCK_YEARS + BLOCK_LENDER).unionByName(newest(quarterly, "q", quarters, BLOCK_QUARTERS)).join(lenders, "symbol", "left")
    return out.withColumns({x: F.when(F.col("lender"), F.col(x)) for x in BLOCK_LENDER}).drop("lender")


def share_growth(counts: DataFrame) -> DataFrame:
    """symbol, dilution_hist: growth from the oldest to the newest known count of shares. ``counts``: symbol, day, shares."""
    ends = counts.where("shares is not null").groupBy("symbol").agg(F.min_by("shares", "day").alias("a"), F.max_by("shares", "day").alias("b"))
    return ends.select("symbol", growth(F.col("b"), F.col("a")).alias("dilution_hist"))
