"""Configuration for the guarded-retrieval pipelines.

Every knob is a frozen dataclass field, so a configuration is a plain value that
can be passed to DataFrame builders and closed over by Spark expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the behaviour being reproduced, verbatim.
# Keyword lists, canned texts, regex patterns, placeholders and type names.
# ---------------------------------------------------------------------------

FINANCIAL_KEYWORDS: tuple[str, ...] = (
    "stock", "stocks", "share", "shares", "equity", "equities",
    "bond", "bonds", "gilt", "gilts", "etf", "fund", "funds",
    "index", "indices", "futures", "options", "derivative", "commodity",
    "forex", "currency", "crypto", "cryptocurrency",
    "revenue", "profit", "earnings", "ebitda", "ebit", "margin", "margins",
    "dividend", "dividends", "yield", "eps", "p/e", "valuation",
    "balance sheet", "cash flow", "income statement", "annual report",
    "quarterly", "q1", "q2", "q3", "q4", "fiscal", "ipo",
    "acquisition", "merger", "takeover", "buyback",
    "invest", "investment", "portfolio", "asset", "allocation",
    "return", "returns", "performance", "benchmark", "alpha", "beta",
    "volatility", "risk", "sharpe", "drawdown", "nav",
    "bank", "banking", "loan", "mortgage", "interest rate", "inflation",
    "pension", "annuity", "isa", "sipp", "savings", "deposit",
    "credit", "debit", "debt", "leverage", "capital",
    "fca", "sec", "basel", "solvency", "gdp", "cpi", "rpi",
    "monetary policy", "quantitative easing", "central bank",
    "bank of england", "federal reserve", "ecb",
    "financial", "finance", "market", "markets", "trading", "trader",
    "analyst", "forecast", "projection", "outlook", "guidance",
    "report", "results", "quarter", "annual", "fiscal year",
)

DISCLAIMER_TRIGGER_KEYWORDS: tuple[str, ...] = (
    "invest", "investment", "portfolio", "return", "returns", "recommend",
    "recommendation", "buy", "sell", "fund", "dividend", "yield", "equity",
    "bond", "shares", "stock", "pension", "annuity", "risk", "forecast",
    "projection", "growth", "performance", "asset", "allocation",
)

DISCLAIMER_TEXT = (
    "\n\n---\n⚠️ **Important:** This information is provided for general knowledge purposes only "
    "and does not constitute financial advice. Past performance is not a reliable indicator of "
    "future results. Please consult a qualified financial adviser before making any investment decisions."
)

LOW_CONFIDENCE_RESPONSE = (
    "I was unable to find sufficiently relevant information in the knowledge base "
    "to answer your question confidently. Please rephrase your query or consult a "
    "qualified financial adviser."
)

QUERY_TOO_LONG_RESPONSE = (
    "Your query is too long. Please shorten your question to under {0} characters and try again."
)

OFF_TOPIC_RESPONSE = (
    "This assistant is designed to answer questions about financial topics only. "
    "Please ask a question related to finance, investments, markets, or financial documents."
)

EMPTY_QUERY_REASON = "Query was empty."
NO_KEYWORD_REASON = (
    "Query did not match any financial domain keywords (required: {required}, found: {found})."
)
TRUNCATED_QUERY_MARKER = "[QUERY TRUNCATED — {n} chars]"
ANSWER_TEMPLATE = "Your question: {question} matches those answers: {context}"
AUDIT_LABELS = (
    "AUDIT | CorrelationId=", " Timestamp=", " TopScore=", " LowConfidence=", " InputPiiRedactions=", " OutputPiiRedactions=",
    " DisclaimerAppended=", " SourceCount=", " Query=", " Response=", " Sources=",
)

# The constant embedding returned for every text by the stub embedder.
CONSTANT_EMBEDDING: tuple[float, ...] = (0.02, 0.36, 0.91)

# PII patterns, in application order: (type name, placeholder, case-insensitive, regex).
# Each pattern runs on the output of the previous one.
PII_PATTERNS: tuple[tuple[str, str, bool, str], ...] = (
    ("UkIban", "[UK-IBAN REDACTED]", True,
     r"\bGB\d{2}[A-Z]{4}\d{14}\b"),
    ("CreditCardNumber", "[CARD-NUMBER REDACTED]", False,
     r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12})(?:[-\s]?[0-9]{4}){0,2}\b"),
    ("UkNationalInsuranceNumber", "[NI-NUMBER REDACTED]", True,
     r"\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b"),
    ("UkSortCode", "[SORT-CODE REDACTED]", False,
     r"\b\d{2}[-\s]\d{2}[-\s]\d{2}\b"),
    ("UkBankAccountNumber", "[ACCOUNT-NUMBER REDACTED]", False,
     r"(?i)(?:account\s*(?:number|no\.?|#)\s*:?\s*)\b\d{8}\b"),
    ("UkPostcode", "[POSTCODE REDACTED]", True,
     r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"),
    ("UkPhoneNumber", "[PHONE-NUMBER REDACTED]", False,
     r"(?:(?:\+44\s?|0)(?:7\d{3}|\d{2,4})[\s-]?\d{3,4}[\s-]?\d{3,4})\b"),
    ("EmailAddress", "[EMAIL REDACTED]", True,
     r"\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"),
)

# Retrieval depth used by the ask pipeline.
TOP_K = 5

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class QueryOptions:
    confidence_threshold: float = 0.6
    max_query_length: int = 1000
    low_confidence_response: str = LOW_CONFIDENCE_RESPONSE
    query_too_long_response: str = QUERY_TOO_LONG_RESPONSE
    top_k: int = TOP_K


@dataclass(frozen=True)
class RelevanceOptions:
    enabled: bool = True
    min_keyword_matches: int = 1
    keywords: tuple[str, ...] = FINANCIAL_KEYWORDS
    off_topic_response: str = OFF_TOPIC_RESPONSE


@dataclass(frozen=True)
class DisclaimerOptions:
    enabled: bool = True
    trigger_keywords: tuple[str, ...] | None = DISCLAIMER_TRIGGER_KEYWORDS
    text: str = DISCLAIMER_TEXT


@dataclass(frozen=True)
class ChunkingOptions:
    separator: str = "\n\n"
    max_chunk_length: int = 500
    overlap: int = 50


@dataclass(frozen=True)
class IngestionOptions:
    source_path: str = ""
    file_extensions: tuple[str, ...] = (".txt", ".md")
    polling_interval_seconds: int = 60
    skip_already_ingested: bool = True


@dataclass(frozen=True)
class RetrievalOptions:
    """Physical knobs for the exact top-k scan.

    ``chunk_block_rows`` / ``query_block_rows`` bound the rows of each side that
    meet in one task, so task memory stays fixed however large both tables grow.
    """

    chunk_block_rows: int = 200_000
    query_block_rows: int = 20_000
    # Sample fraction for the exact probe bound; None = automatic for large stores, 0 = off.
    probe_fraction: float | None = None
    # Largest question block (vectors + ids, bytes) broadcast in one piece.
    broadcast_query_bytes: int = 64 << 20


@dataclass(frozen=True)
class AskOptions:
    query: QueryOptions = field(default_factory=QueryOptions)
    relevance: RelevanceOptions = field(default_factory=RelevanceOptions)
    disclaimer: DisclaimerOptions = field(default_factory=DisclaimerOptions)
    retrieval: RetrievalOptions = field(default_factory=RetrievalOptions)
    # The off-topic audit row stores the raw query when False (exact behaviour),
    # the scrubbed query when True (what the audit interface promises).
    scrub_rejected: bool = True
    # Fresh random correlation ids (original behaviour) instead of md5(query_id).
    random_correlation_ids: bool = False
