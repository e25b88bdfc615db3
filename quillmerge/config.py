"""Thresholds and vocabularies of the record pipeline; every operator takes them as data."""

from __future__ import annotations

# ---- fixed values: results depend on them, so they are stated as they are ----

INGEST_DATE = "2026-08-18"

CTC_LAKH_THRESHOLD = 1000.0
CTC_PLAUSIBLE = (50_000, 100_000_000)
BILLABLE_HOURS_PER_MONTH = 160
RATE_PLAUSIBLE_MONTHLY = (8_000, 400_000)
EXPERIENCE_PLAUSIBLE = (0.0, 50.0)

CITY_CANON = {
    "bengaluru": "Bengaluru",
    "bangalore": "Bengaluru",
    "blr": "Bengaluru",
    "gurgaon": "Gurugram",
    "gurugram": "Gurugram",
    "ggn": "Gurugram",
    "noida": "Noida",
    "new delhi": "Delhi",
    "delhi": "Delhi",
    "delhi ncr": "Delhi",
    "ncr": "Delhi",
    "pune": "Pune",
    "puna": "Pune",
}
CITY_REGION_ONLY = ("delhi ncr", "ncr")
CITY_REGION = {
    "Delhi": "Delhi NCR",
    "Gurugram": "Delhi NCR",
    "Noida": "Delhi NCR",
    "Bengaluru": "Bengaluru Urban",
    "Pune": "Pune Metro",
}

SKILL_CANON = {
    "n8n": "n8n",
    "langchain": "LangChain",
    "lang chain": "LangChain",
    "rest apis": "REST APIs",
    "rest api": "REST APIs",
    "restapi": "REST APIs",
    "mongodb": "MongoDB",
    "mongo db": "MongoDB",
    "mongo": "MongoDB",
    "sql": "SQL",
    "mysql": "MySQL",
    "my sql": "MySQL",
    "docker": "Docker",
    "zapier": "Zapier",
    "javascript": "JavaScript",
    "js": "JavaScript",
    "react": "React",
    "reactjs": "React",
    "react.js": "React",
    "python": "Python",
    "selenium": "Selenium",
    "web scraping": "Web Scraping",
    "webscraping": "Web Scraping",
    "scraping": "Web Scraping",
    "fastapi": "FastAPI",
    "fast api": "FastAPI",
    "pandas": "Pandas",
}

STATUS_CANON = {
    "active": "active",
    "inactive": "inactive",
    "in-active": "inactive",
    "paused": "paused",
    "on hold": "paused",
    "on-hold": "paused",
}
TRUTHY = ("y", "yes", "true", "1", "t")
FALSY = ("n", "no", "false", "0", "f")

SOURCE_PRIORITY = ("naukri", "cbnexus", "gig", "audio_app")
SOURCE_ORDER = ("naukri", "gig", "cbnexus", "audio_app")

MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS = {spelt: i for i, m in enumerate(MONTH_NAMES, 1) for spelt in (m, m[:3])}
EMAIL_ALIAS_PREFIXES = ("alt.", "alt_", "new.", "dup.")
#: A whole domain, or a suffix where it starts with a dot.
RESERVED_DOMAINS = ("example.com", "example.org", "example.net", "example.in", ".example", ".test", ".invalid", ".localhost")
OUTLIER_FACTOR = 3.0
PROJECTS_TRUST = 10

TAG_CATEGORIES = ("automation-heavy", "web-dev", "data", "backend-api", "qa-automation", "generalist")
STUB_WEIGHTS = {
    "automation-heavy": {"n8n": 3, "Zapier": 3, "LangChain": 2},
    "web-dev": {"React": 3, "JavaScript": 2},
    "data": {"Pandas": 3, "SQL": 2, "MySQL": 1, "MongoDB": 1},
    "backend-api": {"FastAPI": 3, "REST APIs": 2, "Docker": 2, "MongoDB": 1, "MySQL": 1},
    "qa-automation": {"Selenium": 3, "Web Scraping": 2},
}
