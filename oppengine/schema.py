"""The record contract: column lists, Spark schemas and ``conform``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a result record, in order.
RESULT_COLUMNS = [
    "fund_url", "fund_name", "applicant_types", "geographic_scope", "us_state_scope", "beneficiary_focus",
    "funding_range", "restrictions", "application_status", "deadline", "notes", "grant_type", "eligibility",
    "evidence", "pages_scraped", "visited_urls_count", "pdf_read", "pdf_url", "pdf_pages", "pdf_text",
    "extraction_timestamp", "error", "discovery_source",
]
#: The columns of the CSV export, in order.
EXPORT_COLUMNS = [
    "fund_url", "fund_name", "applicant_types", "geographic_scope", "beneficiary_focus", "funding_range",
    "restrictions", "application_status", "deadline", "notes", "eligibility", "evidence", "pages_scraped",
    "visited_urls_count", "pdf_read", "pdf_url", "pdf_pages", "pdf_text", "extraction_timestamp", "error",
    "source_folder", "Processed",
]
#: Eligibility labels, best first.
ELIGIBILITY = ["Highly Eligible", "Eligible", "Possibly Eligible", "Low Match", "Not Eligible"]


def strings(*names: str) -> T.StructType:
    out = T.StructType()
    for n in names:
        out = out.add(n, "string")
    return out


RESULTS = strings(*RESULT_COLUMNS)
SCRAPE_JOBS = strings("id").add("urls", T.ArrayType(T.StringType())).add("done", "boolean").add("progress_percent", "integer").add("total_urls", "integer").add("completed_urls", "integer").add("current_url", "string").add("started_at", "timestamp").add("finished_at", "timestamp")
ORGANIZATIONS = strings("name", "ein", "city", "state", "location", "mission").add("services", T.ArrayType(T.StringType())).add("annual_income", "long").add("staff_count", "integer").add("volunteer_count", "integer").add("website", "string").add("ai_system_prompt", "string").add("ai_user_prompt", "string")
DISCOVERY_CONFIG = T.StructType().add("id", "string").add("enabled", "boolean").add("cron_expression", "string").add("states", T.ArrayType(T.StringType())).add("keywords", T.ArrayType(T.StringType())).add("sources", T.MapType(T.StringType(), T.BooleanType())).add("max_per_source", "integer").add("updated_at", "timestamp")
DISCOVERY_RUNS = strings("id", "started_at", "finished_at", "status", "trigger", "config_snapshot").add("urls_discovered", "integer").add("urls_new", "integer").add("scrape_job_id", "string").add("error_message", "string")


def conform(df: DataFrame, columns: list[str] = RESULT_COLUMNS) -> DataFrame:
    """Exactly ``columns``, all strings: missing ones are filled with '', unknown ones dropped, nulls kept."""
    have = set(df.columns)
    return df.select(*[(df[c].cast("string") if c in have else F.lit("")).alias(c) for c in columns])
