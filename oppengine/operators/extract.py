"""Text to record: prompts, a pluggable extractor, and the checks before and after it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.html import by_row
from ..functions.url import netloc
from ..schema import ELIGIBILITY

_RAW = T.StructType()
for _f in X.RECORD_DEFAULTS:
    _RAW = _RAW.add(_f, "string")


def rule_extractor(text: str) -> str:
    """A deterministic stand-in for a language model: a JSON record found by plain patterns."""
    t = text or ""
    amount = re.search(r"\$\s?\d[\d,.]*(?:\s*[km])?(?:\s*(?:-|to)\s*\$?\s?\d[\d,.]*(?:\s*[km])?)?", t, re.I)
    deadline = re.search(r"\b\d{4}-\d{2}-\d{2}\b|\brolling\b", t, re.I)
    status = next((s for s in ("closed", "paused", "rolling", "seasonal", "open") if re.search(rf"\b{s}\b", t, re.I)), "unclear")
    kind = next((k for k in ("federal", "foundation", "corporate", "community") if re.search(rf"\b{k}\b", t, re.I)), "other")
    return json.dumps({"funding_range": amount.group() if amount else "", "deadline": deadline.group() if deadline else "", "application_status": status, "grant_type": kind, "applicant_types": ["nonprofits"] if re.search("nonprofit", t, re.I) else [], "eligibility": "Possibly Eligible" if amount else "Low Match", "evidence": t[:120]})


def json_fields(raw: Column, ddl: str, defaults: dict[str, object]) -> list[Column]:
    """The fields of a JSON object, each with its default where it is missing or null."""
    parsed = F.from_json(raw, ddl)
    return [F.coalesce(parsed[c], F.lit(v)).alias(c) for c, v in defaults.items()]


def flag_short(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``error`` set where the text is too short to extract from."""
    return df.withColumn("error", F.when(F.coalesce(F.length(text), F.lit(0)) < X.MIN_TEXT, X.SHORT_TEXT_ERROR).otherwise(""))


def record_from_json(raw: Column) -> Column:
    """The twelve fields of a JSON record: defaults, lists joined with "; ", labels checked; unreadable: the error record."""
    parsed = F.from_json(raw, _RAW, {"mode": "PERMISSIVE"})
    ok = raw.isNotNull() & F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{")
    fields = []
    for name, default in X.RECORD_DEFAULTS.items():
        v = parsed[name]
        if name in X.LIST_FIELDS:
            v = F.when(v.startswith("["), X.join_list(F.from_json(v, T.ArrayType(T.StringType())))).otherwise(v)
        v = F.coalesce(v, F.lit(default))
        if name == "eligibility":
            v = X.valid_eligibility(v)
        error = F.concat(F.lit("JSON parsing error: "), F.left(F.coalesce(raw, F.lit("")), F.lit(80))) if name in ("notes", "evidence") else F.lit(default)
        fields.append(F.when(ok, v).otherwise(error).alias(name))
    return F.struct(*fields)


def error_record(message: str, evidence: str | None = None) -> Column:
    return F.struct(*[F.lit(message if k == "notes" else (evidence or message) if k == "evidence" else v).alias(k) for k, v in X.RECORD_DEFAULTS.items()])


def is_thin(record: Column) -> Column:
    """At least three of five key fields empty, or a label out of the list."""
    blanks = sum((X.empty(record[k]).cast("int") for k in X.KEY_FIELDS), F.lit(0))
    return (blanks >= 3) | ~F.coalesce(record["eligibility"].isin(*ELIGIBILITY), F.lit(False))


def extract(pages: DataFrame, extractor: Callable[[str], str] = rule_extractor, fallback: Callable[[str], str] | None = None, prompt: str = "{text}", profile: Column | None = None) -> DataFrame:
    """``pages`` (…, text) with ``record`` and ``error``: too short texts are tagged, not dropped.

    The prompt is built natively, the extractor runs on Arrow batches; ``fallback`` is asked again where the first
    answer is thin and the text is longer than 2000 characters.
    """
    ask = _asker(extractor)
    text = X.truncate_middle(F.col("text"))
    filled = X.fill_template(prompt, org_profile=profile if profile is not None else F.lit(""), text=text)
    short = F.coalesce(F.length("text"), F.lit(0)) < X.MIN_TEXT
    out = pages.withColumn("_short", short).withColumn("_prompt", filled).withColumn("record", record_from_json(ask(F.col("_prompt"))))
    if fallback is not None:
        again = is_thin(F.col("record")) & (F.length("text") > 2000)
        out = out.withColumn("record", F.when(again, record_from_json(_asker(fallback)(F.when(again, F.col("_prompt"))))).otherwise(F.col("record")))
    return out.withColumn("error", F.when(F.col("_short"), X.SHORT_TEXT_ERROR).otherwise("")).withColumn("record", F.when(~F.col("_short"), F.col("record"))).drop("_short", "_prompt")


def _asker(extractor: Callable[[str], str]):
    @F.arrow_udf("string")
    def ask(prompt: pa.Array) -> pa.Array:
        return by_row(lambda t: None if t is None else extractor(t), prompt, pa.string())

    return ask


def fund_name(name: Column, url: Column) -> Column:
    return F.coalesce(X.first_nonempty(F.trim(name)), netloc(url))


def failed(results: DataFrame) -> DataFrame:
    """Rows to prepare again."""
    return results.where(F.coalesce("error", F.lit("")) != "")
