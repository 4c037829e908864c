"""Term lists and vocabularies of the domain: fixed values, in natural order."""

from __future__ import annotations

DIRECTIONS = ("lower", "maintain", "raise")
ACTIONS = ("no_rate_signal", "lower", "maintain", "raise")
DIRECTION_OF = {
    "fall": "lower", "lower": "lower", "cut": "lower", "decrease": "lower",
    "maintain": "maintain", "hold": "maintain", "unchanged": "maintain",
    "raise": "raise", "rise": "raise", "increase": "raise", "hike": "raise",
}
QUALITY_FLAGS = ("no_text", "pdf_unreadable", "html_structure_unknown", "http_404", "http_error", "short_body", "partial")
BLOCKING_FLAGS = ("no_text", "pdf_unreadable", "stub")
POLICY_WEIGHTS = {
    "federal funds": 4.0, "target range": 4.0, "interest rate": 3.0, "interest rates": 3.0, "policy rate": 3.0, "monetary policy": 3.0,
    "fomc": 2.5, "inflation": 2.0, "price stability": 2.0, "maximum employment": 2.0, "labor market": 1.5, "unemployment": 1.5,
    "tightening": 1.5, "easing": 1.5, "rate hike": 2.0, "rate cut": 2.0, "balance sheet": 1.0, "outlook": 0.75,
}
HAWKISH = (
    "inflation elevated", "inflation remains elevated", "inflation remains too high", "inflation is too high", "unacceptably high inflation",
    "persistent inflation", "restrictive", "restrictive stance", "restrictive policy", "keep policy restrictive", "sufficiently restrictive",
    "tightening", "further tightening", "additional policy firming", "policy firming", "raise rates", "rate hikes", "higher rates",
    "higher for longer", "price pressures", "upside risks to inflation", "tight labor market", "labor market remains strong",
)
DOVISH = (
    "downside risks", "downside risks to employment", "weak demand", "recession", "rate cuts", "rate reductions", "lowering rates",
    "lower rates", "easing", "less restrictive", "reduce restriction", "easing restraint", "accommodative", "softening labor",
    "labor market has cooled", "cooling labor market", "progress on inflation", "confidence that inflation", "disinflation",
    "normalization of policy", "policy normalization", "gradual normalization",
)
HOLD = (
    "data dependent", "incoming data", "proceed carefully", "careful approach", "wait and see", "well positioned", "balanced risks",
    "balance of risks", "hold rates", "keep rates", "maintain the target range", "target range unchanged", "remain restrictive",
)
UNCERTAIN = ("uncertainty", "uncertain", "risks", "headwinds", "mixed", "volatility", "geopolitical", "tariff", "tariffs")
EXPLICIT_CUES = (
    "decided to maintain", "maintain the target range", "keep the target range", "leave the target range unchanged", "raise the target range",
    "increase the target range", "lower the target range", "decrease the target range", "cut interest rates", "raise interest rates",
    "lower interest rates", "hold rates",
)
MACRO_TOPICS = {
    "inflation": ("inflation", "prices", "price stability", "disinflation", "price pressures"),
    "labor_market": ("labor market", "employment", "jobs", "wages", "unemployment"),
    "growth": ("growth", "activity", "demand", "consumption", "investment", "slowdown", "recession"),
    "policy": ("policy", "rate", "rates", "federal funds", "tightening", "easing", "restrictive", "accommodative"),
}
KEYWORDS = (
    "inflation", "employment", "labor market", "policy rate", "federal funds", "accommodation", "disinflation", "recession", "growth",
    "outlook", "uncertainty",
)
#: Series of the macro context and the columns they become.
MACRO_SERIES = {
    "FEDFUNDS": "funds_rate", "T10Y2Y": "curve", "UNRATE": "unemployment", "CPIAUCSL": "prices", "DFEDTARL": "target_lower", "DFEDTARU": "target_upper",
}
