"""Schemas of the landed files."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_NEWS = "ticker string, title string, date string, content string, url string"
TRANSLATED_NEWS = "id bigint, ticker string, date string, title string, content string, url string"
LABELLED_NEWS = "ticker string, title string, date string, content string, url string, sentiment string"
ARTICLE_NEWS = "title string, date string, link string, content string"
FEED_ITEM = "title string, link string, pubDate string"

ANALYSIS = (
    "meta struct<symbol: string, analysis_date: string, news_period: string, news_count: bigint, model: string>, "
    "sentiment_summary map<string, bigint>, "
    "sentiment_by_date map<string, map<string, bigint>>, "
    "news_with_sentiment array<struct<date: string, title: string, url: string, sentiment: string>>, "
    "analyst_context struct<news_block: string, sentiment_block: string, analyst_block: string>, "
    "investment_judgment string"
)


# fixed values: fields kept of each endpoint's records, by section
ENDPOINT_FIELDS: dict[str, dict[str, dict[str, str]]] = {
    "analyst": {
        "grades_consensus": {
            "symbol": "string",
            "strongBuy": "bigint",
            "buy": "bigint",
            "hold": "bigint",
            "sell": "bigint",
            "strongSell": "bigint",
        },
        "price_target_consensus": {
            "symbol": "string",
            "targetHigh": "double",
            "targetLow": "double",
            "targetConsensus": "double",
            "targetMedian": "double",
        },
        "analyst_estimates": {
            "symbol": "string",
            "date": "string",
            "estimatedRevenueLow": "double",
            "estimatedRevenueHigh": "double",
            "estimatedRevenueAvg": "double",
            "estimatedEpsLow": "double",
            "estimatedEpsHigh": "double",
            "estimatedEpsAvg": "double",
            "estimatedEbitdaAvg": "double",
            "numberAnalystEstimatedRevenue": "bigint",
            "numberAnalystsEstimatedEps": "bigint",
        },
        "stock_grades": {
            "symbol": "string",
            "date": "string",
            "gradingCompany": "string",
            "previousGrade": "string",
            "newGrade": "string",
            "action": "string",
        },
        "stock_grades_historical": {
            "symbol": "string",
            "date": "string",
            "gradingCompany": "string",
            "previousGrade": "string",
            "newGrade": "string",
            "action": "string",
        },
        "price_target_summary": {
            "symbol": "string",
            "lastMonth": "bigint",
            "lastMonthAvgPriceTarget": "double",
            "lastQuarter": "bigint",
            "lastQuarterAvgPriceTarget": "double",
            "lastYear": "bigint",
            "lastYearAvgPriceTarget": "double",
            "allTime": "bigint",
            "allTimeAvgPriceTarget": "double",
        },
    },
    "fundamental": {
        "key_metrics_ttm": {
            "symbol": "string",
            "peRatioTTM": "double",
            "pbRatioTTM": "double",
            "evToEbitdaTTM": "double",
            "evToSalesTTM": "double",
            "priceToSalesRatioTTM": "double",
            "priceToFreeCashFlowsRatioTTM": "double",
            "roeTTM": "double",
            "roicTTM": "double",
            "returnOnTangibleAssetsTTM": "double",
            "debtToEquityTTM": "double",
            "netDebtToEBITDATTM": "double",
            "freeCashFlowPerShareTTM": "double",
            "dividendYieldTTM": "double",
            "earningsYieldTTM": "double",
            "freeCashFlowYieldTTM": "double",
            "revenuePerShareTTM": "double",
            "netIncomePerShareTTM": "double",
            "marketCapTTM": "double",
            "enterpriseValueTTM": "double",
        },
        "financial_ratios_ttm": {
            "symbol": "string",
            "grossProfitMarginTTM": "double",
            "operatingProfitMarginTTM": "double",
            "netProfitMarginTTM": "double",
            "returnOnAssetsTTM": "double",
            "returnOnEquityTTM": "double",
            "currentRatioTTM": "double",
            "quickRatioTTM": "double",
            "debtRatioTTM": "double",
            "debtEquityRatioTTM": "double",
            "interestCoverageTTM": "double",
            "assetTurnoverTTM": "double",
            "dividendYieldTTM": "double",
            "payoutRatioTTM": "double",
            "priceEarningsRatioTTM": "double",
            "priceToBookRatioTTM": "double",
            "priceToSalesRatioTTM": "double",
            "freeCashFlowPerShareTTM": "double",
        },
        "financial_statement_growth": {
            "symbol": "string",
            "date": "string",
            "period": "string",
            "revenueGrowth": "double",
            "grossProfitGrowth": "double",
            "operatingIncomeGrowth": "double",
            "netIncomeGrowth": "double",
            "epsgrowth": "double",
            "freeCashFlowGrowth": "double",
            "operatingCashFlowGrowth": "double",
            "dividendsperShareGrowth": "double",
            "revenueGrowth3Y": "double",
            "netIncomeGrowth3Y": "double",
            "epsgrowth3Y": "double",
        },
        "income_statement_annual": {
            "symbol": "string",
            "date": "string",
            "period": "string",
            "revenue": "double",
            "grossProfit": "double",
            "operatingIncome": "double",
            "netIncome": "double",
            "eps": "double",
            "epsDiluted": "double",
            "ebitda": "double",
            "grossProfitRatio": "double",
            "operatingIncomeRatio": "double",
            "netIncomeRatio": "double",
            "researchAndDevelopmentExpenses": "double",
            "weightedAverageShsOut": "double",
        },
        "cash_flow_statement_annual": {
            "symbol": "string",
            "date": "string",
            "period": "string",
            "operatingCashFlow": "double",
            "capitalExpenditure": "double",
            "freeCashFlow": "double",
            "netCashProvidedByOperatingActivities": "double",
            "netCashUsedForInvestingActivites": "double",
            "netCashUsedProvidedByFinancingActivities": "double",
            "cashAtEndOfPeriod": "double",
            "dividendsPaid": "double",
            "commonStockRepurchased": "double",
        },
    },
    "valuation": {
        "ratings_snapshot": {
            "symbol": "string",
            "date": "string",
            "rating": "string",
            "ratingScore": "bigint",
            "ratingDetailsDCFScore": "bigint",
            "ratingDetailsDCFRecommendation": "string",
            "ratingDetailsROEScore": "bigint",
            "ratingDetailsROERecommendation": "string",
            "ratingDetailsROAScore": "bigint",
            "ratingDetailsROARecommendation": "string",
            "ratingDetailsDEScore": "bigint",
            "ratingDetailsDERecommendation": "string",
            "ratingDetailsPEScore": "bigint",
            "ratingDetailsPERecommendation": "string",
            "ratingDetailsPBScore": "bigint",
            "ratingDetailsPBRecommendation": "string",
        },
        "financial_scores": {
            "symbol": "string",
            "altmanZScore": "double",
            "piotroskiScore": "double",
            "workingCapital": "double",
            "totalAssets": "double",
            "retainedEarnings": "double",
            "ebit": "double",
            "marketCap": "double",
            "totalLiabilities": "double",
            "revenue": "double",
        },
        "dcf_valuation": {
            "symbol": "string",
            "date": "string",
            "dcf": "double",
            "stockPrice": "double",
        },
        "enterprise_values": {
            "symbol": "string",
            "date": "string",
            "stockPrice": "double",
            "numberOfShares": "double",
            "marketCapitalization": "double",
            "minusCashAndCashEquivalents": "double",
            "addTotalDebt": "double",
            "enterpriseValue": "double",
        },
        "owner_earnings": {
            "symbol": "string",
            "date": "string",
            "averagePPE": "double",
            "maintenanceCapex": "double",
            "ownersEarnings": "double",
            "growthCapex": "double",
            "ownersEarningsPerShare": "double",
        },
    },
    "market_context": {
        "sector_pe_snapshot": {
            "date": "string",
            "sector": "string",
            "exchange": "string",
            "pe": "double",
        },
        "treasury_rates": {
            "date": "string",
            "month1": "double",
            "month3": "double",
            "month6": "double",
            "year1": "double",
            "year2": "double",
            "year5": "double",
            "year10": "double",
            "year30": "double",
        },
        "earnings_report": {
            "symbol": "string",
            "date": "string",
            "eps": "double",
            "epsEstimated": "double",
            "revenue": "double",
            "revenueEstimated": "double",
            "period": "string",
        },
    },
}
SHARED_ENDPOINTS = ("sector_pe_snapshot", "treasury_rates")


def record_type(fields: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"`{name}`: {kind}" for name, kind in fields.items()) + ">"


def fundamentals_schema() -> T.StructType:
    """One nested document per symbol: meta and four sections of endpoints."""
    sections = [
        f"{section} struct<" + ", ".join(
            f"{name}: struct<description: string, data: array<{record_type(fields)}>>"
            for name, fields in endpoints.items()
        ) + ">"
        for section, endpoints in ENDPOINT_FIELDS.items()
    ]
    meta = "meta struct<symbol: string, sector: string, collected_at: string, api_version: string>"
    return T.StructType.fromDDL(", ".join([meta, *sections]))
