"""Deterministic derivations of listing facts from page text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = r"^[\s ]+|[\s ]+$"
# Texts that stand for no value.
SENTINELS = ("", "n/a", "na", "n\\a", "-", "--", "tbd", "tba", "none", "null")
# Page wordings of a listing's status.
STATUS = {"registration available": "open", "course full": "full", "waitlist": "waitlist", "registration closed": "closed"}
# Words for the day counts of deadline rules.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "seven": 7, "ten": 10}
# Wordings of a place that name its campus, read in this order.
CAMPUS = {
    "Online": r"\bonline\b|\bon-line\b|distance education",
    "Newark": r"\bnewark\b",
    "Camden": r"\bcamden\b",
    "New Brunswick": r"\bnew brunswick\b|\bpiscataway\b|\bbusch\b|\bcook\b|\blivingston\b|\bcollege ave|\bdouglass\b|rockafeller|100 rock",
}


def trimmed(c: Column) -> Column:
    """White space at the ends goes, no-break spaces included."""
    return F.regexp_replace(c, _BLANK, "")


def sentinel_to_null(c: Column) -> Column:
    return F.when(~F.lower(trimmed(c)).isin(*SENTINELS), trimmed(c))


def parse_fee_cents(c: Column) -> Column:
    """Digits and points of the text read as dollars, up to a second point, in cents rounded half up; null without digits."""
    number = F.regexp_extract(F.regexp_replace(c, "[^0-9.]", ""), r"^\d*\.?\d*", 0)
    return F.floor(F.when(number.rlike(r"\d"), number).try_cast("double") * 100 + F.lit(0.5)).cast("long")


def is_total_label(c: Column) -> Column:
    return c.rlike(r"(?i)\btotal\b")


def derive_fees(fees: Column) -> Column:
    """Array of (amount, label) texts to (ord, label, amount_cents, is_total, alert): an unreadable amount counts 0 and is flagged."""
    return F.transform(
        fees,
        lambda f, i: F.struct(
            i.cast("int").alias("ord"),
            f["label"].alias("label"),
            F.coalesce(parse_fee_cents(f["amount"]), F.lit(0)).cast("long").alias("amount_cents"),
            F.coalesce(is_total_label(f["label"]), F.lit(False)).alias("is_total"),
            parse_fee_cents(f["amount"]).isNull().alias("alert"),
        ),
    )


def total_fee_cents(rows: Column) -> Column:
    """The first total line's amount, else the largest; null without lines."""
    return F.coalesce(F.try_element_at(F.filter(rows, lambda r: r["is_total"]), F.lit(1))["amount_cents"], F.array_max(F.transform(rows, lambda r: r["amount_cents"])))


def map_status(c: Column) -> Column:
    out = F.lit("unknown")
    for wording, status in STATUS.items():
        out = F.when(F.lower(trimmed(c)) == wording, status).otherwise(out)
    return out


def status_alert(c: Column) -> Column:
    return F.when((map_status(c) == "unknown") & sentinel_to_null(c).isNotNull(), F.concat(F.lit("unknown status: "), c))


def split_format(c: Column) -> Column:
    """(category, platform): leading dashes go, then the text before and after the first colon."""
    text = F.regexp_replace(sentinel_to_null(c), r"^-+\s*", "")
    at = F.instr(text, ":")
    return F.struct(
        sentinel_to_null(F.when(at > 0, F.substring_index(text, ":", 1)).otherwise(text)).alias("category"), sentinel_to_null(F.when(at > 0, text.substr(at + 1, F.length(text)))).alias("platform")
    )


def delivery_mode(c: Column, hint: Column) -> Column:
    """By precedence; 'asynchronous' holds 'synchronous', so both markers fit it and the first online rule decides."""
    text = F.lower(F.coalesce(sentinel_to_null(c), F.lit("")))
    sync, asynchronous = text.contains("synchronous"), text.contains("asynchronous")
    has = lambda *words: F.greatest(*[text.contains(w) for w in words], F.lit(False))
    return (
        F.when(text == "", hint)
        .when(has("hybrid"), "hybrid")
        .when(has("classroom", "in person", "in-person"), "in_person")
        .when(asynchronous & ~sync, "online_async")
        .when(has("online", "distance", "e-college", "virtual"), F.when(sync | ~asynchronous, "online_sync").otherwise("online_async"))
        .otherwise(hint)
    )


def derive_campus(c: Column, hint: Column) -> Column:
    """The first campus whose wording stands in the place; ', XX' with another state's letters is elsewhere; else the hint."""
    text = sentinel_to_null(c)
    out = F.when(text.isNull(), hint)
    for campus, wording in CAMPUS.items():
        out = out.when(text.rlike(f"(?i){wording}"), campus)
    return out.when(text.rlike(r",\s*(?!NJ\b)[A-Z]{2}\b"), "Other").otherwise(hint)


def split_location(c: Column) -> Column:
    """(site, room): the text before the first comma, and the number after 'room' or 'rm'."""
    return F.struct(sentinel_to_null(F.substring_index(c, ",", 1)).alias("site"), F.nullif(F.regexp_extract(c, r"(?i)\b(?:room|rm)\.?\s*([A-Za-z]?\d[\w-]*)", 1), F.lit("")).alias("room"))


def season_of(month: Column) -> Column:
    """December, January and February are the calendar year's Winter."""
    return F.element_at(F.array(*map(F.lit, ("Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer", "Summer", "Fall", "Fall", "Fall", "Winter"))), month.cast("int"))


def derive_term(day: Column) -> Column:
    season = season_of(F.month(day))
    return F.struct(F.year(day).alias("year"), season.alias("season"), F.concat_ws(" ", season, F.year(day).cast("string")).alias("label"))


def is_evening(times: Column, form: Column, hint: Column) -> Column:
    """A format that says so, else a first clock time at or after 17:00; without a time the hint."""
    hour = F.regexp_extract(times, r"(?i)(\d{1,2}):\d{2}\s*([ap])\.?m", 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(times, r"(?i)(\d{1,2}):\d{2}\s*([ap])\.?m", 2)) == "p", 12).otherwise(0)
    return F.when(F.coalesce(form.rlike(r"(?i)\bevening\b"), F.lit(False)), True).when(sentinel_to_null(times).isNull(), hint).otherwise(F.coalesce(hour >= 17, hint))


def contact_hours(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"(?i)(\d+(?:\.\d+)?)\s*-?\s*hours?\b", 1), F.lit("")).try_cast("double")


def normalized_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s-]+", " "))


def business_days_before(day: Column, n: Column) -> Column:
    """The date n working days before; Saturdays and Sundays don't count."""
    working = F.filter(F.transform(F.sequence(F.lit(1), n * 2 + 4), lambda k: F.date_sub(day, k.cast("int"))), lambda d: F.weekday(d) < 5)
    return F.when(n > 0, F.try_element_at(working, n)).otherwise(day)


def derive_deadline(rule: Column, start: Column) -> Column:
    """'N (business) days prior', N in digits or as a word, before the start date."""
    found = F.lower(F.regexp_extract(rule, r"(?i)\b(\d+|one|two|three|four|five|seven|ten)\s+(business\s+)?days?\s+(?:prior|before)", 1))
    n = found.try_cast("int")
    for word, number in NUMBERS.items():
        n = F.when(found == word, number).otherwise(n)
    working = rule.rlike(r"(?i)business\s+days?")
    return F.when(n.isNull() | start.isNull(), F.lit(None).cast("date")).when(working, business_days_before(start, n)).otherwise(F.date_sub(start, n))


# Month names of written dates.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NUMERIC = r"(\d{1,2})/(\d{1,2})/(\d{4})"
_WRITTEN = rf"(?i)\b({'|'.join(m[:3] for m in MONTHS)})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?"


def parse_date_range(c: Column) -> Column:
    """(starts_on, ends_on, failure) of 'M/D/YYYY - M/D/YYYY', 'Month D, YYYY', 'Month D & D, YYYY' and lists of such dates.

    A date without a year borrows the next one's; an end before its start is the start; the failure is
    empty, tbd, cancelled or unparseable.
    """
    text = trimmed(c)
    numeric = F.transform(F.regexp_extract_all(text, F.lit(_NUMERIC), F.lit(0)), lambda d: F.try_to_date(d, "M/d/yyyy"))
    spread = F.regexp_replace(text, r"(?i)\b([a-z]{3,9})\.?\s+(\d{1,2})\s*(?:&|and|-|to)\s*(\d{1,2})\b(?!\s*[:/])", "$1 $2, $1 $3")
    year = F.regexp_extract_all(spread, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))
    month = lambda name: F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    written = F.transform(
        F.regexp_extract_all(spread, F.lit(_WRITTEN), F.lit(0)),
        lambda d: F.try_to_date(
            F.concat(F.coalesce(F.nullif(F.regexp_extract(d, _WRITTEN, 3), F.lit("")), F.try_element_at(year, F.lit(-1))), F.lit("-"), month(F.regexp_extract(d, _WRITTEN, 1)).cast("string"), F.lit("-"), F.regexp_extract(d, _WRITTEN, 2)),
            "yyyy-M-d",
        ),
    )
    days = F.filter(F.when(F.size(numeric) > 0, numeric).otherwise(written), lambda d: d.isNotNull())
    start, end = F.try_element_at(days, F.lit(1)), F.try_element_at(days, F.lit(-1))
    failure = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(F.lower(text).rlike(r"\bcancel+ed\b"), "cancelled")
        .when(F.lower(text).rlike(r"\b(tbd|tba|to be (determined|announced))\b"), "tbd")
        .when(start.isNull(), "unparseable")
    )
    return F.struct(F.when(failure.isNull(), start).alias("starts_on"), F.when(failure.isNull(), F.greatest(start, end)).alias("ends_on"), failure.alias("failure"))


def parse_start_end(a: Column, b: Column) -> Column:
    """(starts_on, ends_on, failure) of a start cell and an end cell; an absent or earlier end is the start."""
    first, last = parse_date_range(a), parse_date_range(b)
    failure, start = first["failure"], first["starts_on"]
    return F.struct(start.alias("starts_on"), F.when(failure.isNull(), F.greatest(start, last["ends_on"])).alias("ends_on"), failure.alias("failure"))


def derive_relations(relations: Column) -> Column:
    """Sentinels go; of relations with one raw text the first stays."""
    clean = F.filter(F.transform(relations, lambda r: F.struct(sentinel_to_null(r["raw_text"]).alias("raw_text"), r["kind"].alias("kind"))), lambda r: r["raw_text"].isNotNull())
    texts = F.transform(clean, lambda r: r["raw_text"])
    return F.filter(clean, lambda r, i: F.array_position(texts, r["raw_text"]) == i + 1)


def derive_instructors(people: Column) -> Column:
    """People without any name, and page wordings that leaked into names, go; the rest are numbered from 0."""
    named = F.transform(people, lambda p: F.struct(sentinel_to_null(p["last_name"]).alias("last_name"), sentinel_to_null(p["first_name"]).alias("first_name")))
    real = F.filter(named, lambda p: F.coalesce(p["last_name"], p["first_name"]).isNotNull() & ~F.coalesce(F.lower(p["last_name"]).rlike("^(staff|instructor|faculty)$"), F.lit(False)))
    return F.transform(real, lambda p, i: F.struct(i.cast("int").alias("ord"), p["last_name"].alias("last_name"), p["first_name"].alias("first_name")))


def misalignment(code: Column, section: Column) -> Column:
    """An alert where a course code stands in the section's place."""
    return F.when(sentinel_to_null(code).isNull() & section.rlike(r"^[A-Za-z]{2,}-?\d"), F.concat(F.lit("course code in section slot: "), section))


def derive_rows(df: DataFrame) -> DataFrame:
    """Extracted fields and page fields of one page per row to listing facts: the page wins for status, fees and dates,
    the extractor for format and location; differing dates raise an alert.

    Reads page_status, page_dates, fees, format, location, times, title, deadline_rule, extracted_starts_on.
    """
    rows = derive_fees(F.col("fees"))
    dated = df.withColumn("range", parse_date_range(F.col("page_dates"))).withColumn("starts_on", F.coalesce("range.starts_on", "extracted_starts_on"))
    return dated.select(
        *[c for c in df.columns],
        "starts_on",
        F.col("range.ends_on").alias("ends_on"),
        map_status(F.col("page_status")).alias("status"),
        rows.alias("fee_rows"),
        total_fee_cents(rows).alias("total_fee_cents"),
        delivery_mode(F.col("format"), F.lit("unknown")).alias("delivery_mode"),
        derive_campus(F.col("location"), F.lit("unknown")).alias("campus"),
        is_evening(F.col("times"), F.col("format"), F.lit(None).cast("boolean")).alias("is_evening"),
        contact_hours(F.col("title")).alias("contact_hours"),
        normalized_title(F.col("title")).alias("title_normalized"),
        derive_deadline(F.col("deadline_rule"), F.col("starts_on")).alias("registration_deadline"),
        derive_term(F.col("starts_on")).alias("term"),
        (F.col("range.starts_on") != F.col("extracted_starts_on")).alias("date_conflict"),
    )
