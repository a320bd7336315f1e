"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}"
# Domains whose addresses are never real, and ends of sentences.
BLOCKED_DOMAINS = ["example.com"]
SENTENCE_ENDS = [". ", "। ", "。", "…", "\n"]
# Labels of stop reasons.
REASONS = {
    "time_budget_exhausted": "Time budget reached", "max_pages_reached": "Max pages reached", "max_depth_reached": "Max depth reached",
    "robots_disallowed": "Blocked by robots.txt", "network_timeout": "Network timeout", "http_error": "HTTP error", "render_error": "Rendering failed",
    "crawl_completed": "Completed", "duplicate_detected": "Duplicate URL", "user_cancelled": "Cancelled by user", "rate_limited": "Rate limited",
    "server_error": "Server error; please try again",
}


def words(text: Column) -> Column:
    """Number of words between runs of white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def first_sentence(text: Column, limit: int) -> Column:
    """Up to the first separator that occurs, in the separators' order; cut to ``limit`` with an ellipsis."""
    whole = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), r"\s+$", "")
    out = whole
    for separator in reversed(SENTENCE_ENDS):
        out = F.when(F.instr(whole, separator) > 0, F.substring_index(whole, separator, 1)).otherwise(out)
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit - 1), F.lit("…"))).otherwise(out)


def emails(text: Column) -> Column:
    """Distinct addresses in lower case, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({EMAIL})"), F.lit(1)), lambda e: F.lower(e)))


def is_valid_email(email: Column) -> Column:
    """Structural checks of the local part and of the domain's labels."""
    local, domain = F.substring_index(email, "@", 1), F.regexp_replace(email, "^[^@]*@", "")
    labels = F.split(domain, r"\.")
    top = F.element_at(labels, -1)
    numeric = F.transform(labels, lambda x: x.rlike("^[0-9]+$"))
    address = F.exists(
        F.sequence(F.lit(0), F.greatest(F.size(labels) - 4, F.lit(0))), lambda i: F.size(F.filter(F.slice(numeric, i + 1, F.lit(4)), lambda x: x)) == 4
    )
    blocked = F.lit(False)
    for name in BLOCKED_DOMAINS:
        blocked = blocked | (domain == name) | domain.endswith("." + name)
    good_local = (F.length(local) >= 2) & ~local.rlike(r"^[.\-]|[.\-]$|\.\.|^[0-9]+$")
    good_domain = domain.contains(".") & ~domain.rlike(r"^[.\-]|[.\-]$|\.\.") & (F.length(top) >= 2) & (F.length(F.element_at(labels, -2)) >= 2)
    return F.coalesce(email.contains("@") & good_local & good_domain & ~top.rlike("^[0-9]+$") & (F.length(top) <= 8) & ~address & ~blocked, F.lit(False))


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[email]")


def truncated(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def safe_filename(name: Column) -> Column:
    """Letters, digits, dots and hyphens, neither of the latter at an end; ``site`` where nothing is left."""
    slug = F.regexp_replace(F.lower(F.when(F.coalesce(name, F.lit("")) == "", F.lit("site")).otherwise(name)), "[^a-z0-9.\\-]+", "-")
    short = F.substring(F.regexp_replace(slug, "^[.\\-]+|[.\\-]+$", ""), 1, 80)
    return F.when(short == "", F.lit("site")).otherwise(short)


def markdown_spacing(text: Column) -> Column:
    """Links on lines of their own where they touch, blanks about them, and no more than one empty line."""
    out = F.replace(text, F.lit(")["), F.lit(")\n["))
    out = F.regexp_replace(out, r"\)([^\s\[\])])", ") $1")
    out = F.regexp_replace(out, r"([^\s(\[!])\[(?!\()", "$1 [")
    return F.regexp_replace(out, "\n{3,}", "\n\n")


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def score_text(score: Column) -> Column:
    """One decimal, halves to the even digit, an em dash for null."""
    return F.when(score.isNull(), F.lit("—")).otherwise(F.format_string("%.1f", F.bround(score.cast("double"), 1)))


def delta_text(delta: Column) -> Column:
    """One decimal with a sign, an em dash for null."""
    return F.when(delta > 0, F.concat(F.lit("+"), score_text(delta))).otherwise(score_text(delta))


def elapsed_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago ``then`` was; a time to come is now."""
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(then), F.lit(0))
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(s < 60, ago(s, "s ago")).when(s < 3600, ago(s / 60, "m ago")).when(s < 86400, ago(s / 3600, "h ago")).otherwise(ago(s / 86400, "d ago"))


def friendly_reason(code: Column) -> Column:
    """Known codes by table; others with spaces and title case; N/A for none."""
    key = F.trim(code)
    out = F.initcap(F.regexp_replace(F.lower(key), "_+", " "))
    for name, label in REASONS.items():
        out = F.when(F.lower(key) == name, F.lit(label)).otherwise(out)
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("N/A")).otherwise(out)


def public_error_label(error: Column) -> Column:
    key = F.lower(F.trim(error))
    return (
        F.when(F.coalesce(error, F.lit("")) == "", F.lit(""))
        .when(key.startswith("crawl blocked:"), F.lit("Site blocked the crawler (bot protection)"))
        .when(key == "time_budget_exceeded", F.lit("Time budget reached"))
        .when(key == "cancelled_by_user", F.lit("Cancelled by the owner"))
        .otherwise(F.lit("Analysis failed"))
    )


def neutral_tags(text: Column) -> Column:
    """Closing tags broken up, so that quoted text can't end a section."""
    return F.regexp_replace(text, "</", "<​/")


def byte_capped(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, a broken last character dropped."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.replace(F.try_validate_utf8(F.make_valid_utf8(cut.cast("string"))), F.lit("�"), F.lit("")))


def key_digest(token: Column) -> Column:
    return F.sha2(token, 256)


def grouped(n: Column) -> Column:
    """A whole number with its thousands parted by commas."""
    return F.format_number(n, 0)
