"""Four disagreeing sources derived from the ``customer`` table.

Plain SQL that Spark and DuckDB both run, so that a test can hold the operators'
results against an independent evaluation of the same rows.  Who appears where
follows the customer key: A has name, e-mail and phone, B name and e-mail, C name
and phone, D (made outside the files) name and phone.  Spellings, aliases and damage
follow it too; some rows name nobody and some have no skills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "Asha,Bina,Chetan,Deepa,Esha,Farid,Gita,Harish,Indra,Jaya,Kiran,Leela,Mohan,Nisha,Omkar,Priya,Ravi,Sita,Tara,Uma"
LAST = "Anand,Bose,Chopra,Das,Easwar,Fernandes,Ghosh,Hegde,Iyer,Joshi,Kapoor,Lal,Mehta,Nair,Ojha,Patel,Qureshi,Rao,Shah,Thomas,Unni,Verma,Wagle,Xavier,Yadav,Zaveri,Arora,Bhat,Chawla,Dutta"
CITIES = "Bengaluru,Gurugram,Noida,Delhi,Pune"
ALIASES = "blr,GGN,noida,New Delhi,puna"
DOMAINS = "mail.test,example.com,work.example.org"
SKILLS = "n8n;python, SQL;React,js;Pandas,sql,Mongo;FastAPI,rest api,docker;Selenium,scraping;zapier, n8n,Cobol;javascript,React"

BASE = f"""
base AS (
  SELECT k, f, l, city, alias,
         lower(f) || '.' || lower(l) || CAST(k AS STRING) || '@' || dom AS mail,
         '9' || lpad(CAST(k AS STRING), 9, '0') AS tel, skill
  FROM (
    SELECT c_custkey AS k,
           split_part('{FIRST}', ',', CAST(c_custkey % 20 + 1 AS INT)) AS f,
           split_part('{LAST}', ',', CAST(floor(c_custkey / 20) % 30 + 1 AS INT)) AS l,
           split_part('{CITIES}', ',', CAST(floor(c_custkey / 7) % 5 + 1 AS INT)) AS city,
           split_part('{ALIASES}', ',', CAST(floor(c_custkey / 7) % 5 + 1 AS INT)) AS alias,
           split_part('{DOMAINS}', ',', CAST(c_custkey % 3 + 1 AS INT)) AS dom,
           split_part('{SKILLS}', ';', CAST(c_custkey % 8 + 1 AS INT)) AS skill
    FROM customer
  ) named
)"""

CITY_TEXT = "CASE k % 6 WHEN 0 THEN alias WHEN 1 THEN upper(city) WHEN 2 THEN city || ' ' WHEN 3 THEN lower(city) ELSE city END"

#: Repeated applicant rows are numbered so much higher: a multiple of every period below.
AGAIN = 9_765_000

APPLICANTS = f"""
once AS (
  SELECT 'naukri' AS source, CAST(k AS INT) AS row_number,
         CASE WHEN k % 61 = 0 THEN '' ELSE CASE k % 7 WHEN 0 THEN upper(f || ' ' || l) WHEN 1 THEN lower(f || ' ' || l)
                    WHEN 2 THEN substring(f, 1, 1) || '. ' || l ELSE f || '  ' || l END END AS full_name,
         CASE WHEN k % 61 = 0 THEN 'none' WHEN k % 50 = 0 THEN 'alt.' || mail WHEN k % 5 = 0 THEN upper(mail) WHEN k % 31 = 0 THEN f || ' at ' || l ELSE mail END AS email,
         CASE WHEN k % 61 = 0 THEN '' ELSE CASE k % 4 WHEN 0 THEN '+91' || tel WHEN 1 THEN '0' || tel WHEN 2 THEN tel ELSE '91' || tel END END AS phone,
         {CITY_TEXT} AS city,
         CAST(k % 9 AS STRING) || '.5' AS experience,
         CASE k % 2 WHEN 0 THEN CAST(k % 40 + 2 AS STRING) || '.5' ELSE CAST(300000 + k * 10 AS STRING) END AS ctc,
         CASE k % 4 WHEN 0 THEN '2026-0' || CAST(k % 9 + 1 AS STRING) || '-1' || CAST(k % 10 AS STRING)
                    WHEN 1 THEN '2' || CAST(k % 9 AS STRING) || '-0' || CAST(k % 9 + 1 AS STRING) || '-2026'
                    WHEN 2 THEN '0' || CAST(k % 9 + 1 AS STRING) || '/0' || CAST(k % 7 + 1 AS STRING) || '/2026'
                    ELSE CAST(k % 31 + 1 AS STRING) || ' Feb 2026' END AS applied,
         CASE WHEN k % 73 = 0 THEN '' ELSE skill END AS skills
  FROM base WHERE k % 10 <= 5
), applicants AS (
  SELECT * FROM once UNION ALL
  SELECT source, CAST(row_number + {AGAIN} AS INT), full_name, email, phone, city, CASE WHEN row_number % 194 = 0 THEN '31.5' ELSE experience END, ctc, applied, skills
  FROM once WHERE row_number % 97 = 0
)"""

WORKERS = f"""
workers AS (
  SELECT 'gig' AS source, CAST(k AS INT) AS row_number, CASE WHEN k % 59 = 0 THEN 'n/a' ELSE mail END AS email, CASE WHEN k % 59 = 0 THEN ' ' ELSE f || ' ' || l END AS full_name,
         CASE k % 3 WHEN 0 THEN CAST(100 + k % 900 AS STRING) || '/hr' WHEN 1 THEN CAST(10 + k % 60 AS STRING) || 'k/month'
                    ELSE CAST(1000 + k % 500 AS STRING) || ' per day' END AS rate,
         CASE WHEN k % 11 = 0 THEN 'Delhi NCR' ELSE {CITY_TEXT} END AS city,
         CASE k % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'on hold' WHEN 3 THEN 'inactive' ELSE 'gone' END AS status,
         CASE WHEN k % 53 = 0 THEN '' WHEN k % 9 = 0 THEN 'Python,Docker' ELSE skill END AS skills
  FROM base WHERE k % 10 BETWEEN 3 AND 8
)"""

CONTACTS = f"""
contacts AS (
  SELECT 'cbnexus' AS source, CAST(k AS INT) AS row_number, CASE WHEN k % 67 = 0 THEN '' ELSE f || ' ' || l END AS full_name,
         CASE WHEN k % 67 = 0 THEN '12' WHEN k % 37 = 0 THEN translate(tel, '0123456789', '０１２３４５６７８９') WHEN k % 3 = 0 THEN '0091' || tel WHEN k % 3 = 1 THEN '+91-' || tel ELSE substring(tel, 1, CAST(10 - CASE WHEN k % 29 = 0 THEN 2 ELSE 0 END AS INT)) END AS phone,
         {CITY_TEXT} AS city,
         CASE k % 6 WHEN 0 THEN 'Y' WHEN 1 THEN 'yes' WHEN 2 THEN 'No' WHEN 3 THEN 'N' WHEN 4 THEN 'maybe' ELSE '' END AS verified,
         CAST(k % 25 AS STRING) AS projects
  FROM base WHERE k % 10 IN (0, 1, 2, 3, 4, 7, 8, 9)
)"""

APPS = """
apps AS (
  SELECT 'audio_app' AS source, CAST(k AS INT) AS row_number, CASE WHEN k % 7 = 0 THEN '' ELSE f || ' ' || l END AS full_name,
         CASE WHEN k % 4 = 1 THEN '12' ELSE tel END AS phone, CASE WHEN k % 3 = 0 THEN NULL ELSE alias END AS city
  FROM base WHERE k % 23 = 5
)"""

CTES = f"WITH {BASE}, {APPLICANTS}, {WORKERS}, {CONTACTS}, {APPS}"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``applicants``, ``workers``, ``contacts``, ``apps``."""
    text = f"{CTES} SELECT * FROM {name}".replace("FROM customer", "FROM {customer}")
    return spark.sql(text, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
