"""Text, amount and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ELIGIBILITY

#: Words that derived keywords leave out, and the phrase used where nothing is left.
STOP_WORDS = ["the", "a", "an", "and", "or", "to", "for", "of", "in", "is", "we", "our"]
DEFAULT_KEYWORDS = "workforce development employment training nonprofit"
#: Text limits and markers.
TEXT_LIMIT, TEXT_MARKER = 30_000, "\n...[content truncated]...\n"
PDF_LIMIT, PDF_MARKER = 20_000, "\n...[pdf text truncated]..."
MIN_TEXT, SHORT_TEXT_ERROR = 100, "Insufficient text extracted"
#: What an extracted record holds where a field is missing.
RECORD_DEFAULTS = {
    "applicant_types": "", "geographic_scope": "", "us_state_scope": "", "beneficiary_focus": "", "funding_range": "",
    "restrictions": "", "application_status": "unclear", "deadline": "", "notes": "", "grant_type": "other",
    "eligibility": "Low Match", "evidence": "",
}
LIST_FIELDS = ["applicant_types", "us_state_scope", "beneficiary_focus", "restrictions"]
KEY_FIELDS = ["applicant_types", "geographic_scope", "beneficiary_focus", "funding_range", "evidence"]


def empty(c: Column) -> Column:
    """Null or ''."""
    return F.coalesce(c, F.lit("")) == ""


def first_nonempty(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def _scaled(number: Column, unit: Column) -> Column:
    return number.cast("double") * F.when(F.trim(unit) == "k", 1_000.0).when(F.trim(unit) == "m", 1_000_000.0).otherwise(1.0)


def currency_input(text: Column) -> Column:
    """Amount at the start of the text, without commas, with k or m; else null."""
    t = F.lower(F.trim(F.replace(text, F.lit(","), F.lit(""))))
    p = r"^(\d+(?:\.\d+)?)(\s*[km])?"
    return F.when(t.rlike(p), _scaled(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)))


def funding_max(text: Column, strict_commas: bool = False) -> Column:
    """Largest amount in the text. Commas part numbers ("10,000" is 10 and 0), unless ``strict_commas``."""
    t = F.lower(text.cast("string"))
    if strict_commas:
        t = F.regexp_replace(t, r"(?<=\d),(?=\d{3})", "")
    p = r"(\d+(?:\.\d+)?)(\s*[km])?"
    return F.array_max(F.transform(F.regexp_extract_all(t, F.lit(p), 0), lambda x: _scaled(F.regexp_extract(x, p, 1), F.regexp_extract(x, p, 2))))


def last_integer(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(\d+)"), 0), F.lit(-1)).cast("long")


def truncate_middle(text: Column, limit: int = TEXT_LIMIT, marker: str = TEXT_MARKER) -> Column:
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half)))).otherwise(text)


def truncate_head(text: Column, limit: int = PDF_LIMIT, marker: str = PDF_MARKER) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def join_list(items: Column, separator: str = "; ") -> Column:
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def valid_eligibility(label: Column) -> Column:
    return F.when(label.isin(*ELIGIBILITY), label).otherwise("Low Match")


def eligibility_rank(label: Column, order: list[str] = ELIGIBILITY) -> Column:
    """0 for the best; unknown labels come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.coalesce(label, F.lit("")))
    return F.when(at == 0, len(order)).otherwise(at - 1).cast("int")


def loose_boolean(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "yes", "1", "y"), F.lit(False))


def mask_secret(key: Column) -> Column:
    return F.when(F.length(key) > 11, F.concat(F.left(key, F.lit(7)), F.lit("…"), F.right(key, F.lit(4)))).otherwise("***")


def derive_keywords(mission: Column, services: Column, configured: Column | None = None) -> Column:
    words = lambda c, n: F.coalesce(F.slice(F.filter(F.split(c, r"\s+"), lambda w: w != ""), 1, n), F.array().cast("array<string>"))
    parts = F.concat(words(mission, 8), words(F.try_element_at(services, F.lit(1)), 4))
    clean = F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"^[.,;:()]+|[.,;:()]+$", ""))
    kept = F.array_distinct(F.filter(clean, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS)))
    derived = first_nonempty(F.array_join(F.slice(kept, 1, 6), " "), F.lit(DEFAULT_KEYWORDS))
    return derived if configured is None else F.when(F.size(configured) > 0, F.array_join(configured, " ")).otherwise(derived)


def search_queries(keywords: Column, state: Column | None = None, year: int = 2026) -> Column:
    """The five query texts."""
    base = first_nonempty(F.trim(keywords), F.lit("nonprofit grants"))
    at = F.lit("") if state is None else F.when(empty(state), "").otherwise(F.concat(F.lit(" "), state))
    return F.array(
        F.concat(base, F.lit(f" grants {year} open applications nonprofit"), at),
        F.concat(base, F.lit(" foundation grants 501c3 RFP deadline"), at),
        F.concat(base, F.lit(f" grant opportunities apply {year}"), at),
        F.concat(base, F.lit(" grants funding available nonprofit"), at, F.lit(" site:.org")),
        F.concat(base, F.lit(f" grants {year} site:.gov OR site:.org")),
    )


def org_profile_text() -> Column:
    """Labelled lines of the organisation columns; empty ones are left out."""
    line = lambda label, c: F.when(~empty(c), F.concat(F.lit(label + ": "), c))
    place = F.concat_ws(", ", F.nullif(F.trim("city"), F.lit("")), F.nullif(F.trim("state"), F.lit("")))
    number = lambda c: F.nullif(F.col(c).cast("long"), F.lit(0))
    return F.concat_ws(
        "\n",
        line("Organization", F.col("name")), line("EIN", F.col("ein")), line("Location", place), line("Mission", F.col("mission")),
        line("Services", F.array_join("services", ", ")), F.concat(F.lit("Annual income: $"), F.format_number(number("annual_income"), 0)),
        F.concat(F.lit("Staff: "), number("staff_count").cast("string")), F.concat(F.lit("Volunteers: "), number("volunteer_count").cast("string")),
    )


def csv_cell(value: Column) -> Column:
    v = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike('[",\n]'), quoted).otherwise(v)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(v) for v in values])


def highlight(text: Column, query: str) -> Column:
    return F.regexp_replace(text, r"(?i)(\Q" + query.replace(r"\E", "") + r"\E)", "<mark>$1</mark>") if query else text


def email_initials(email: Column) -> Column:
    parts = F.filter(F.split(F.substring_index(email, "@", 1), r"[._-]"), lambda p: p != "")
    return F.upper(F.array_join(F.transform(F.slice(parts, 1, 2), lambda p: F.left(p, F.lit(1))), ""))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_setting(text: Column) -> Column:
    """Trimmed, without one pair of quotes around it; empty is null."""
    return F.nullif(F.regexp_replace(F.trim(text), "^([\"'])(.*)\\1$", "$2"), F.lit(""))


def clamp_percent(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def fill_template(template: str, **values: Column) -> Column:
    """A prompt template with its ``{name}`` slots replaced."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


#: Names of weekdays, from 0 on.
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _leading_int(text: Column) -> Column:
    return F.regexp_extract(text, r"^([+-]?[0-9]+)", 1).try_cast("int")


def parse_cron(cron: Column) -> Column:
    """struct(mode, hour, minute, dow, dom) of ``m h dom mon dow``: the mode by which of dom and dow are open; what is no number has its default."""
    f = F.split(F.trim(cron), r"\s+")
    mode = (
        F.when(F.size(f) != 5, "custom").when((f[4] != "*") & (f[2] == "*"), "weekly").when((f[2] != "*") & (f[4] == "*"), "monthly")
        .when((f[4] == "*") & (f[2] == "*"), "daily").otherwise("custom")
    )
    whole = F.size(f) == 5
    day = lambda i, m: F.when(mode == m, F.coalesce(F.nullif(_leading_int(f[i]), F.lit(0)), F.lit(1))).otherwise(1)
    number = lambda i, default: F.coalesce(F.when(whole, _leading_int(f[i])), F.lit(default))
    return F.struct(mode.alias("mode"), number(1, 2).alias("hour"), number(0, 0).alias("minute"), day(4, "weekly").alias("dow"), day(2, "monthly").alias("dom"))


def build_cron(mode: Column, hour: Column, minute: Column, dow: Column, dom: Column, custom: Column) -> Column:
    day = F.when(mode == "daily", "* * *").when(mode == "weekly", F.concat(F.lit("* * "), dow)).otherwise(F.concat(dom, F.lit(" * *")))
    return F.when(mode == "custom", custom).otherwise(F.concat_ws(" ", minute, hour, day))


def describe_schedule(mode: Column, hour: Column, minute: Column, dow: Column, dom: Column) -> Column:
    two = lambda c: F.when(F.length(c.cast("string")) < 2, F.concat(F.lit("0"), c)).otherwise(c.cast("string"))
    at = F.concat(two(hour), F.lit(":"), two(minute), F.lit(" UTC"))
    weekday = F.coalesce(F.try_element_at(F.array(*map(F.lit, WEEKDAYS)), F.when(dow >= 0, dow + 1)), F.lit("undefined"))
    return (
        F.when(mode == "daily", F.concat(F.lit("Every day at "), at)).when(mode == "weekly", F.concat(F.lit("Every "), weekday, F.lit(" at "), at))
        .when(mode == "monthly", F.concat(F.lit("Day "), dom, F.lit(" of every month at "), at)).otherwise("")
    )


def describe_cron(cron: Column) -> Column:
    """daily, weekly, monthly or custom."""
    return parse_cron(cron)["mode"]
