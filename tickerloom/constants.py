"""Names, word lists and formats that results depend on."""

# --- fixed values: article labels -------------------------------------------
LABELS = ["Positive", "Growth", "Neutral", "Mixed", "Risk", "Negative"]
DASHBOARD_LABELS = ["Growth", "Positive", "Neutral", "Mixed", "Risk", "Negative"]
DEFAULT_LABEL = "Neutral"
LABEL_DISPLAY = {
    "Growth": "성장 기대",
    "Positive": "긍정",
    "Neutral": "중립",
    "Mixed": "혼재",
    "Risk": "리스크",
    "Negative": "부정",
}

# --- fixed values: grade change actions --------------------------------------
ACTION_DISPLAY = {
    "upgrade": "🟢 상향",
    "downgrade": "🔴 하향",
    "initiation": "🔵 신규",
    "reiterated": "⚪ 유지",
}
GRADE_CHANGE_COLUMNS = {
    "date": "날짜",
    "gradingCompany": "증권사",
    "previousGrade": "이전 등급",
    "newGrade": "현재 등급",
    "action": "변경",
}

# --- fixed values: sectors and company names ----------------------------------
SECTOR_SYMBOLS = {
    "테크·AI": ["NVDA", "MSFT", "TSM"],
    "금융·핀테크": ["JPM", "V", "GS"],
    "에너지·원자재": ["XOM", "CVX"],
    "헬스케어·바이오": ["ABBV", "UNH"],
}
COMPANY_NAMES = {
    "NVDA": "Nvidia",
    "MSFT": "Microsoft",
    "TSM": "TSMC",
    "JPM": "JPMorgan",
    "V": "Visa",
    "GS": "Goldman Sachs",
    "XOM": "ExxonMobil",
    "CVX": "Chevron",
    "ABBV": "AbbVie",
    "UNH": "UnitedHealth",
}

# --- fixed values: word lists and patterns of the cleaning steps ----------------
NOISE_KEYWORDS = ["cloudflare", "security service", "ray id", "access denied"]
BLOCKED_KEYWORDS = [
    "security service",
    "banned you",
    "cookie tech",
    "Cloudflare",
    "you are using automation",
    "Please make sure your browser",
    "access to this page has been denied",
]
JUNK_TITLES = ["url", ""]
BOILERPLATE_PATTERNS = [
    r"Sign up for free newsletters.*",
    r"Got a confidential news tip.*",
    r"© \d{4}.*All rights reserved.*",
    r"Cookie.*Notice.*",
    r"Privacy Policy.*",
    r"This site is now part of.*",
    r"Making the world smarter.*",
    r"Invest better with.*",
    r"\*Average returns.*",
    r"Market data powered by.*",
    r"Data is a real-time snapshot.*",
]
BODY_COLUMNS = [
    "body_ko", "body", "summary_ko", "summary",
    "content_ko", "content", "text_ko", "text",
]

# --- fixed values: sizes ----------------------------------------------------------
WINDOW_DAYS = 3
SNIPPET_CHARS = 800
ARTICLE_CHARS = 3000
MIN_PARAGRAPH_CHARS = 50
MIN_ARTICLE_CHARS = 200
CHUNK_ROWS = 5

# --- fixed values: judgment headings and verdict words -------------------------------
SECTIONS = [
    "핵심 요약",
    "전체 흐름 분석",
    "긍정 요인",
    "부정 요인",
    "투자 인사이트",
    "투자 판단",
    "판단 근거",
]
VERDICT_SECTION = "투자 판단"
VERDICT_NO_WORD = "비투자"
VERDICT_YES_WORD = "투자"

# --- fixed values: placeholder record of an unreadable article reply ------------------
REPLY_PARSE_FAILED = "분석실패"
REPLY_CALL_FAILED = "오류"

# --- fixed values: records asked per symbol and endpoint -------------------------------
ENDPOINT_LIMITS = {
    "analyst_estimates": 3,
    "stock_grades": 10,
    "stock_grades_historical": 20,
    "financial_statement_growth": 3,
    "income_statement_annual": 1,
    "cash_flow_statement_annual": 1,
    "enterprise_values": 1,
    "owner_earnings": 1,
    "earnings_report": 8,
}

# --- fixed values: lines shown per endpoint, {field:style|default} --------------------------
ANALYST_LINES = {
    ("analyst", "grades_consensus"):
        "▶ 애널리스트 등급 합산\n"
        "  Strong Buy: {strongBuy|0}  Buy: {buy|0}  Hold: {hold|0}  Sell: {sell|0}  Strong Sell: {strongSell|0}",
    ("analyst", "price_target_consensus"):
        "▶ 목표주가 컨센서스\n"
        "  High: ${targetHigh}  Low: ${targetLow}  Consensus: ${targetConsensus}  Median: ${targetMedian}",
    ("analyst", "analyst_estimates"):
        "▶ 실적 추정치 ({date:month|})\n"
        "  예상 매출: ${estimatedRevenueAvg:billions|0.0B}  예상 EPS: ${estimatedEpsAvg:cents|0.00}",
    ("valuation", "dcf_valuation"):
        "▶ DCF 내재가치\n  DCF: ${dcf}  현재가: ${stockPrice}",
    ("valuation", "ratings_snapshot"):
        "▶ FMP 종합 등급\n  등급: {rating}  점수: {ratingScore}",
    ("fundamental", "key_metrics_ttm"):
        "▶ 핵심 밸류에이션 (TTM)\n"
        "  P/E: {peRatioTTM}  P/B: {pbRatioTTM}  EV/EBITDA: {evToEbitdaTTM}  ROE: {roeTTM}",
}
MISSING_FIELD = "N/A"
# the endpoints of the shorter variant
SHORT_ANALYST_ENDPOINTS = ["grades_consensus", "price_target_consensus", "dcf_valuation", "key_metrics_ttm"]
