"""Crawl ingest as table rewrites: discovery, robots, upsert, snapshots, gated sweep, resume lists, field extraction."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, remove_query_param, segment_hash

LINK = r'(?is)<a\b[^>]*?href="([^"#]+)'


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(page: DataFrame) -> DataFrame:
    """Distinct (page_id, link) of a page's anchors."""
    return page.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link")).distinct()


def absolute(href: Column, base: Column) -> Column:
    """The link as seen from a page: with its own scheme as it is, from '//' under the page's scheme, from '/' under its
    host, else beside the page. Fragments go."""
    bare = F.regexp_replace(href, "#.*$", "")
    host = F.regexp_extract(base, r"(?i)^[a-z]+://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"(?i)^[a-z]+://[^?#]*/", 0)
    beside = F.when(F.length(folder) > F.length(host), folder).otherwise(F.concat(host, F.lit("/")))
    return (
        F.when(bare.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, r"(?i)^[a-z]+:", 0), bare))
        .when(bare.startswith("/"), F.concat(host, bare))
        .otherwise(F.concat(beside, bare))
    )


def index_links(page: DataFrame, element: str | None = None) -> DataFrame:
    """(page_id, place, link): a page's links as absolute urls, each once, in the order of their first place; with
    ``element`` only those inside elements of that name."""
    html = F.col("html") if element is None else F.array_join(F.regexp_extract_all("html", F.lit(rf"(?is)<{element}\b.*?</{element}>"), F.lit(0)), " ")
    found = page.select("page_id", "url", F.posexplode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("place", "href"))
    return found.groupBy("page_id", absolute(F.col("href"), F.col("url")).alias("link")).agg(F.min("place").alias("place")).select("page_id", "place", "link")


def html_text(html: Column) -> Column:
    """Visible text by pattern: scripts, styles, navigation and tags go, white space collapses."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


class _Fields(HTMLParser):
    """Label and value cells of a page's tables, its heading, paragraphs outside tables, and anchors."""

    def __init__(self):
        super().__init__()
        self.rows, self.cells, self.depth, self.prose, self.anchors = [], None, 0, [], []
        self.title, self.heading, self.where, self.href = "", "", None, None

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "table":
            self.depth += 1
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag == "br" and self.cells:
            self.cells[-1] += "\n"
        elif tag in ("title", "h1", "p"):
            self.where = tag
            if tag == "p" and not self.depth:
                self.prose.append("")
        elif tag == "a":
            self.href = named.get("href")
            if self.href:
                self.anchors.append([self.href, named.get("title") or ""])
        elif tag == "img" and self.href and self.anchors:
            self.anchors[-1][1] += f" {named.get('alt') or ''} {named.get('title') or ''}"

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif tag == "tr" and self.cells is not None:
            self.rows.append([c.strip() for c in self.cells])
            self.cells = None
        elif tag == self.where:
            self.where = None
        elif tag == "a":
            self.href = None

    def handle_data(self, data):
        if self.href and self.anchors:
            self.anchors[-1][1] += data
        if self.cells:
            self.cells[-1] += data
        elif self.where == "p" and self.prose:
            self.prose[-1] += data
        elif self.where == "h1":
            self.heading += data
        elif self.where == "title":
            self.title += data


# Page labels with a key of their own; others are camel-cased.
KEYS = {"course id": "courseId", "section id": "sectionId", "session": "session", "dates": "dates", "days": "days", "instructor": "instructor", "instructor(s)": "instructor", "location": "location", "status": "status", "registration status": "status", "format": "format", "registration deadline": "registrationDeadline"}


def key_for(label: str) -> str:
    name = re.sub(r"[\s\xa0:]+", " ", label).strip().lower()
    if name in KEYS:
        return KEYS[name]
    words = re.findall("[a-z0-9]+", name)
    return "".join(w if not i else w.capitalize() for i, w in enumerate(words))


def page_fields(html: str, base: str = "") -> dict:
    """One page's title, fields, fee lines, prose, and the link to more offerings of its group."""
    parser = _Fields()
    parser.feed(html or "")
    found, fees = {}, []
    for row in parser.rows:
        if len(row) != 2:
            continue
        if m := re.fullmatch(r"\$\s*([\d.,]+)", row[0]):
            fees.append({"amount": m[1], "label": re.sub(r"\s+", " ", row[1])})
            continue
        labels = [x for x in row[0].split("\n") if x.strip()]
        values = [x.strip() for x in row[1].split("\n")]
        for i, label in enumerate(labels):
            value = values[i] if len(labels) > 1 and i < len(values) else " ".join(v for v in values if v) if len(labels) == 1 else ""
            if key_for(label) and value:
                found[key_for(label)] = re.sub(r"\s+", " ", value)
    group = next((urljoin(base, href) for href, text in parser.anchors if re.search("more offerings like this", text, re.I)), None)
    return {"title": (parser.heading or parser.title).strip(), "fields": found, "fees": fees, "prose": "\n".join(p.strip() for p in parser.prose if p.strip()), "group_url": group}


_text = T.StringType()
FIELDS = T.StructType(
    [
        T.StructField("title", _text),
        T.StructField("fields", T.MapType(_text, _text)),
        T.StructField("fees", T.ArrayType(T.StructType([T.StructField("amount", _text), T.StructField("label", _text)]))),
        T.StructField("prose", _text),
        T.StructField("group_url", _text),
    ]
)


_string = pa.string()
_FIELDS = pa.struct([("title", _string), ("fields", pa.map_(_string, _string)), ("fees", pa.list_(pa.struct([("amount", _string), ("label", _string)]))), ("prose", _string), ("group_url", _string)])
#: Pages of a batch that are Python objects at once.
SOME = 64


@F.arrow_udf(FIELDS)
def extract_fields(html: pa.Array, base: pa.Array) -> pa.Array:
    """Arrow batches through the standard HTML parser, a few pages at a time; a null page gives empty fields."""
    done = [pa.array([], _FIELDS)]
    for at in range(0, len(html), SOME):
        pages = (page_fields(h or "", b or "") for h, b in zip(html[at : at + SOME].to_pylist(), base[at : at + SOME].to_pylist(), strict=True))
        done.append(pa.array([page | {"fields": list(page["fields"].items())} for page in pages], _FIELDS))
    return pa.concat_arrays(done)


def segments(fields: DataFrame) -> DataFrame:
    """Course and listing hashes: a status flip moves the second only, a description edit the first only."""
    f = lambda k: F.col("page.fields")[k]
    fees = F.array_join(F.transform("page.fees", lambda x: F.concat_ws(" ", x["amount"], x["label"])), "\n")
    course = segment_hash(F.col("page.title"), F.col("page.prose"), f("prerequisites"), f("audience"), f("courseId"))
    listing = segment_hash(f("status"), f("session"), f("days"), f("dates"), f("instructor"), f("location"), f("sectionId"), f("format"), f("registrationDeadline"), fees)
    return fields.withColumn("course_hash", course).withColumn("listing_hash", listing)


def robots_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the most specific group that names the agent; none without such a group."""
    groups, names, rules, open_ = [], [], [], False
    for line in text.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_:
                names, rules = [], []
                groups.append((names, rules))
            names.append(value.lower())
            open_ = True
        elif key in ("allow", "disallow") and groups:
            open_ = False
            if value:
                rules.append((key == "allow", value))
    fit = [(max((len(n) for n in names if n != "*" and n in agent.lower()), default=0 if "*" in names else -1), rules) for names, rules in groups]
    best = max((n for n, _ in fit), default=-1)
    return [r for n, rules in fit if n == best for r in rules] if best >= 0 else []


def robots_pattern(pattern: str) -> str:
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in pattern.rstrip("$" if end else "").split("*")) + ("$" if end else "")


def robots_allowed(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The longest matching rule decides, Allow wins ties, and without a match the path is allowed."""
    longest = lambda allow: F.greatest(F.lit(-1), F.lit(-1), *[F.when(path.rlike(robots_pattern(p)), len(p)) for a, p in rules if a == allow])
    return longest(True) >= longest(False)


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key, the new one's columns first; columns of ``keep_old`` take the new value only where it isn't null.

    Parquet tables have no MERGE: the result replaces the table by a staged write.
    """
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in keep_old else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def observe(state: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """Page state after a crawl. ``fetched`` has (url, content_hash, not_modified): a page that is seen again is live again,
    and keeps its hash where the server said it hadn't changed."""
    both = state.alias("o").join(fetched.alias("n"), "url", "full_outer")
    seen = F.col("n.not_modified").isNotNull()
    return both.select(
        "url",
        F.when(seen & ~F.col("n.not_modified"), F.col("n.content_hash")).otherwise(F.col("o.content_hash")).alias("content_hash"),
        F.coalesce("o.first_seen_at", now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(~seen, F.col("o.disappeared_at")).alias("disappeared_at"),
    )


def snapshots(existing: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of ``observed`` (page_id, content_hash) that no snapshot holds yet, once each."""
    return observed.dropDuplicates(["page_id", "content_hash"]).join(existing.select("page_id", "content_hash"), ["page_id", "content_hash"], "left_anti")


def sweep(state: DataFrame, runs: DataFrame, pages_seen: int, started_at: Column, fraction: float = 0.8) -> DataFrame:
    """Page state with pages not seen since the start marked gone, if the run saw enough: at least ``fraction``, rounded up, of the best good run."""
    best = runs.where("status = 'ok'").agg(F.coalesce(F.ceil(F.max("pages_seen") * F.lit(fraction)), F.lit(0)).alias("threshold"))
    gone = (F.lit(pages_seen) >= F.col("threshold")) & F.col("disappeared_at").isNull() & (F.col("last_seen_at") < started_at)
    return state.crossJoin(F.broadcast(best)).withColumn("disappeared_at", F.when(gone, started_at).otherwise(F.col("disappeared_at"))).withColumn("swept", F.lit(pages_seen) >= F.col("threshold")).drop("threshold")


def crawl_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a run's outcomes in one pass; ``outcomes`` has kind, is_new, course_changed, listing_changed, group_url."""
    c = lambda cond: F.count_if(cond)
    kind = F.col("kind")
    return outcomes.agg(
        c(kind == "fetched").alias("fetched"), c(kind == "not_modified").alias("not_modified"), c(kind == "skipped_robots").alias("skipped"), c(kind == "error").alias("errors"),
        c(F.col("is_new")).alias("new_pages"), c(F.col("course_changed")).alias("course_changed"), c(F.col("listing_changed")).alias("listing_changed"), c(F.col("group_url").isNotNull()).alias("group_links"),
    )


def work_list(page: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows that a stage hasn't done yet, in order: a crash costs only the rest."""
    out = page.join(done.select(key), key, "left_anti").orderBy(key)
    return out.limit(limit) if limit else out


def canonical_pages(page: DataFrame) -> DataFrame:
    """(page_id, canonical_url, content_hash): the url without tracking parameters, the hash of the visible text."""
    return page.select("page_id", remove_query_param(F.col("url"), "utm_*").alias("canonical_url"), content_hash(html_text(F.col("html"))).alias("content_hash"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of parents in ``new`` are replaced whole; the others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def lookup(state: DataFrame, asked: DataFrame, key: str = "url") -> DataFrame:
    """The stored state of asked pages, told apart by ``key``; one without a state has nulls, and its url is that of the asking row."""
    names = list(dict.fromkeys([key, "url"]))
    return asked.select(*names).distinct().join(state, key, "left")
