"""Text functions: hashing, chunk text, tokens, labels and rendering, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that lexical search skips.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def collapsed(c: Column) -> Column:
    """Runs of white space, no-break spaces included, become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def segment_hash(*parts: Column) -> Column:
    """Hash of the parts that aren't empty, one per line, with white space collapsed."""
    return F.sha2(collapsed(F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])), 256)


def estimate_tokens(c: Column) -> Column:
    return F.least(F.lit(32767), F.greatest(F.lit(1), F.ceil(F.length(c) / 4))).cast("int")


def rough_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("int")


def chunk_text(title: Column, meta: list[Column], description: Column, audience: Column, prerequisites: Column) -> Column:
    """Title, joined meta line, description, audience and prerequisites, one per line; absent parts leave no line."""
    line = lambda label, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(label), c))
    joined = F.nullif(F.concat_ws(" · ", *[F.nullif(m, F.lit("")) for m in meta]), F.lit(""))
    return F.concat_ws("\n", F.nullif(title, F.lit("")), joined, F.nullif(description, F.lit("")), line("Audience: ", audience), line("Prerequisites: ", prerequisites))


def context_prefix(title: Column, unit: Column, most: int = 500) -> Column:
    """A deterministic stand-in for generated context: null without a title."""
    return F.substring(collapsed(F.concat(title, F.lit(" is offered by "), F.coalesce(unit, F.lit("the school")), F.lit("."))), 1, most)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def remove_query_param(url: Column, name: str) -> Column:
    """The url without parameters of that name (a trailing '*' matches any ending)."""
    key = name[:-1] + "[^=&#]*" if name.endswith("*") else name
    inner = F.regexp_replace(url, rf"([?&]){key}=[^&#]*(?=&|#|$)", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"\?&+", "?"), r"&&+", "&"), r"[?&]+(?=#|$)", "")


def substring_between(c: Column, before: str, after: str) -> Column:
    """The text between the first ``before`` and the next ``after``; null where either is missing."""
    start = F.instr(c, before)
    rest = c.substr(start + len(before), F.length(c))
    return F.when((start > 0) & (F.instr(rest, after) > 0), F.substring_index(rest, after, 1))


def dollars(cents: Column) -> Column:
    """$1,234 for whole dollars, else $1,234.50."""
    return F.when(cents % 100 == 0, F.concat(F.lit("$"), F.format_number(cents / 100, 0))).otherwise(F.concat(F.lit("$"), F.format_number(cents / 100, 2)))


def month_year(day: Column) -> Column:
    return F.date_format(day, "MMMM yyyy")


def and_list(items: Column) -> Column:
    """'a', 'a and b', 'a, b, and c'."""
    n = F.size(items)
    return F.when(n == 0, "").when(n <= 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def whole_seconds(since: Column, until: Column) -> Column:
    """Seconds from one time to another, both cut to their second."""
    return F.timestamp_diff("SECOND", F.date_trunc("SECOND", since), F.date_trunc("SECOND", until))


def freshness(checked: Column, now: Column) -> Column:
    minutes = F.floor(whole_seconds(checked, now) / 60)
    return (
        F.when(checked.isNull(), "not checked yet")
        .when(minutes < 1, "checked just now")
        .when(minutes < 60, F.concat(F.lit("checked "), minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.lit("checked "), F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.lit("checked "), F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")


def prose_deltas(c: Column, words: int = 6) -> Column:
    """The text in parts of some words each; their concatenation is the text again."""
    return F.regexp_extract_all(c, F.lit(rf"\s*(?:\S+\s*){{1,{words}}}"), F.lit(0))


def cost_usd(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * F.lit(0.10e-6) + tokens_out * F.lit(0.40e-6)


def canonical_filter(entries: Column) -> Column:
    """JSON of a map with sorted keys; a null map gives '', an empty one '{}'."""
    return F.when(entries.isNull(), "").otherwise(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the text's UTF-8 bytes."""
    digits = F.hex(c.cast("binary"))
    parts = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")), lambda i: F.conv(F.substr(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    folded = F.aggregate(parts, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296)
    return F.when(F.length(digits) == 0, F.lit(2166136261).cast("long")).otherwise(folded)
