"""Small texts: cleaning, quoting, addresses, numbers and times as people read them, banners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The wording of the banners.
SKIPPED = "Visual Diff Skipped"
FAILED = "Visual Capture Failed"
NO_REASON = "No reason provided."
MISMATCH = "Page State Mismatch"
QUIET_STATES = ["success", "completed", "devtools-blocked"]
# End of fixed values.


def clean_text(text: Column) -> Column:
    """White space runs become one space; the ends are trimmed; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty (a breadcrumb is the first of selector, path and label)."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def escape_xpath(text: Column) -> Column:
    """A text as an XPath literal; one with both kinds of quotes is put together by concat()."""
    single, double = F.lit("'"), F.lit('"')
    parts = F.concat(F.lit("concat('"), F.replace(text, single, F.lit("', \"'\", '")), F.lit("')"))
    quoted = F.when(~text.contains("'"), F.concat(single, text, single)).when(~text.contains('"'), F.concat(double, text, double)).otherwise(parts)
    return F.coalesce(quoted, F.lit("''"))


def escape_css(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"""([!"#$%&'()*+,./:;<=>?@\[\\\]^`{|}~])""", r"\\$1"), F.lit(""))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


_ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The host in lower case; what is no address stays as it is."""
    return F.when(url.rlike(_ADDRESS), F.lower(F.regexp_extract(url, _ADDRESS, 1))).otherwise(url)


def last_segment(url: Column) -> Column:
    """/segment of the path's last part that is not empty, / for none; an empty text for what is no address."""
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(~F.coalesce(url.rlike(_ADDRESS), F.lit(False)), "").when(F.size(segments) == 0, "/").otherwise(F.concat(F.lit("/"), F.try_element_at(segments, F.lit(-1))))


def relative_time(then: Column, now: Column) -> Column:
    """just now, 5m ago, 3h ago, 2d ago."""
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / 60)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(minutes < 1440, ago(F.floor(minutes / 60), "h")).otherwise(ago(F.floor(minutes / 1440), "d"))


def file_time(time: Column) -> Column:
    """A time as part of a file name: 2024-01-31T12-30-05."""
    return F.date_format(time, "yyyy-MM-dd'T'HH-mm-ss")


def fixed(value: Column, places: int) -> Column:
    """A number with a fixed count of decimals."""
    return F.format_string(f"%.{places}f", value.cast("double"))


def capture_banner(status: Column, reason: Column) -> Column:
    """Title and reason of a failed or skipped capture; null where there is nothing to say."""
    title = F.when(status == "failed", FAILED).otherwise(SKIPPED)
    return F.when(status.isNotNull() & ~status.isin(QUIET_STATES), F.concat(title, F.lit(": "), first_given(reason, F.lit(NO_REASON))))


def mismatch_banner(classification: Column, base_hash: Column, compare_hash: Column, keys: Column) -> Column:
    """What differs between two addresses of one view; null unless the classification is CAUTION."""
    parts = F.array_compact(
        F.array(
            F.when(~base_hash.eqNullSafe(compare_hash), F.concat(F.lit("SPA hash mismatch: "), base_hash, F.lit(" vs "), compare_hash)),
            F.when(F.size(keys) > 0, F.concat(F.lit("Query differences: "), F.array_join(keys, ", "))),
        )
    )
    return F.when(classification == "CAUTION", F.concat(F.lit(f"{MISMATCH}: "), F.array_join(parts, " · ")))


def devtools_banner(role: Column, outer_height: Column, height: Column, outer_width: Column, width: Column) -> Column:
    """The line about a tab whose DevTools were open; null where they were not."""
    from ..operators.visual import devtools

    seen = devtools(outer_height, height, outer_width, width)
    text = F.format_string("%s tab: DevTools was open (viewport reduced to %dpx). Screenshots taken at %dpx using virtual viewport override.", role, height, seen["bypass_height"])
    return F.when(seen["detected"], text)
