"""Pages read by their headings, in expressions alone: sections, table rows and definition lists.

A page is cut at its headings into parts (level, heading, what follows it). A fold over the parts
carries a state that a heading sets and higher headings reset; only then are rows taken from the parts.
So a page is one row until its rows are known: no exchange, no Python, and a fold as long as its headings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"
_PART = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>(.*?)(?=<h[1-6]\b|\z)"
_ROW = r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|\z)"
_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|\z)"
_TERM = r"(?is)<dt\b[^>]*>(.*?)(?=</dt\s*>|<d[dt]\b|\z)"
_TERM_PART = r"(?is)<dt\b[^>]*>(.*?)(?:</dt\s*>|(?=<dd\b))(.*?)(?=<dt\b|\z)"
_MEANING = r"(?is)<dd\b[^>]*>(.*?)(?=</dd\s*>|<d[dt]\b|\z)"
#: Named characters of HTML: fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&amp;": "&"}


def text_of(html: Column) -> Column:
    """The text of a piece of HTML: tags go, entities are read, white space is one blank."""
    plain = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, letter in ENTITIES.items():
        if entity != "&amp;":
            plain = F.replace(plain, F.lit(entity), F.lit(letter))
    letter = lambda code: F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
    codes = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"&#(\d{1,6});"), 1))
    plain = F.aggregate(codes, plain, lambda t, c: F.replace(t, F.concat(F.lit("&#"), c, F.lit(";")), letter(c)))
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("&amp;"), F.lit("&")), r"[\s ]+", " "))


def parts(html: Column) -> Column:
    """array<struct<level, heading, body>> of a page, in order; what stands before the first heading is no part."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    level, heading, body = (F.regexp_extract_all(seen, F.lit(_PART), k) for k in (1, 2, 3))
    return F.transform(F.arrays_zip(level.alias("a"), heading.alias("b"), body.alias("c")), lambda p: F.struct(p["a"].cast("int").alias("level"), text_of(p["b"]).alias("heading"), p["c"].alias("body")))


def folded(pages: DataFrame, start: Column, step: Callable[[Column, Column], Column], keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """keys, at, level, heading, body, state: each part with the state that step(state, part) has come to
    with its heading; start is the state of a page's beginning (a struct)."""
    states = F.aggregate("parts", F.array(start), lambda held, part: F.concat(held, F.array(step(F.element_at(held, -1), part))))
    rows = pages.select(*keys, parts(F.col("html")).alias("parts")).select(*keys, F.arrays_zip("parts", F.slice(states, 2, F.greatest(F.size("parts"), F.lit(1))).alias("states")).alias("both"))
    rows = rows.select(*keys, F.posexplode("both").alias("at", "b"))
    return rows.select(*keys, "at", "b.parts.level", "b.parts.heading", "b.parts.body", F.col("b.states").alias("state"))


def cells(sections: DataFrame, *keep: str) -> DataFrame:
    """keep, row, cells: the table rows of each part, as arrays of the cells' texts."""
    rows = sections.select(*keep, F.posexplode(F.regexp_extract_all("body", F.lit(_ROW), 1)).alias("row", "html"))
    return rows.select(*keep, "row", F.transform(F.regexp_extract_all("html", F.lit(_CELL), 1), text_of).alias("cells"))


def gender_of(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("women") | low.contains("female"), "female").when(low.contains("men") | low.contains("male"), "male")


def month_of(text: Column) -> Column:
    """'Mon YYYY' as 'YYYY-MM', null for anything else."""
    return F.date_format(F.try_to_timestamp(F.trim(text), F.lit("MMM yyyy")), "yyyy-MM")


#: Names on coverage pages: fixed values.
MATCH_TYPES = ("Test Matches", "Multi-day Matches", "One-day Internationals", "One-day matches", "T20 Internationals", "International T20s")
HEADINGS = ("Match Type", "Competition", "Team")


def _coverage_state(held: Column, part: Column) -> Column:
    level, low = part["level"], F.lower(part["heading"])
    section, gender = held["section"], held["gender"]
    chapter = F.when(low.contains("period"), "periods").when(low.contains("number"), "numbers")
    new_section = F.when(level == 3, chapter).when((level == 4) & (section == "numbers") & low.contains("team"), "teams").otherwise(section)
    of_heading = gender_of(part["heading"])
    new_gender = F.when(level == 3, F.lit(None)).when(level == 4, F.when(section == "periods", of_heading)).when((level == 6) & (section == "numbers"), of_heading).otherwise(gender)
    return F.struct(new_section.alias("section"), new_gender.alias("gender"))


def coverage(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What coverage pages tell (page_id, html): periods (page_id, gender, kind, name, earliest_checked,
    earliest_provided) and counts (page_id, gender, kind, name, have, total, pct). Tables under other
    headings, heads of tables and rows of under three cells are left out; so are the counts of both
    genders together, which repeat the others. Null and empty pages have no rows."""
    none = F.lit(None).cast("string")
    rows = cells(folded(pages, F.struct(none.alias("section"), none.alias("gender")), _coverage_state), "page_id", "at", "state").filter(F.size("cells") >= 3)
    rows = rows.select("page_id", "state.*", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("a"), F.col("cells")[2].alias("b")).filter(~F.col("name").isin(*HEADINGS))
    periods = rows.filter("section = 'periods' and gender is not null").select(
        "page_id", "gender", F.when(F.col("name").isin(*MATCH_TYPES), "match type").otherwise("competition").alias("kind"), "name", month_of(F.col("a")).alias("earliest_checked"), month_of(F.col("b")).alias("earliest_provided")
    )
    number = lambda k: F.replace(F.regexp_extract("a", r"^([\d,]+) of ([\d,]+)$", k), F.lit(","), F.lit("")).try_cast("long")
    counts = rows.filter("section = 'teams' or section = 'numbers' and gender is not null").filter(F.col("a").rlike(r"^[\d,]+ of [\d,]+$"))
    counts = counts.select("page_id", F.when(F.col("section") == "numbers", F.col("gender")).alias("gender"), F.when(F.col("section") == "numbers", "competition").otherwise("team").alias("kind"), "name", number(1).alias("have"), number(2).alias("total"), F.col("b").try_cast("double").alias("pct"))
    return periods, counts


def key_of(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _missing_state(held: Column, part: Column) -> Column:
    level, heading, low = part["level"], part["heading"], F.lower(part["heading"])
    kind = F.when(low.contains("match type"), "match type").when(low.contains("competition"), "competition")
    plain = F.trim(F.regexp_replace(heading, r"(?i)\s*matches\s*$", ""))
    dates = F.regexp_extract_all(part["body"], F.lit(_TERM), 1)
    carried = F.when(level == 5, F.lit(None)).otherwise(held["last"])
    return F.struct(
        F.when(level == 4, kind).otherwise(held["kind"]).alias("kind"), F.when(level == 5, plain).otherwise(held["name"]).alias("name"), F.when(level == 5, held["kind"]).otherwise(held["by"]).alias("by"),
        F.when(level == 5, F.lit(None)).when(level == 6, gender_of(heading)).otherwise(held["gender"]).alias("gender"), carried.alias("date"),
        F.when(F.size(dates) > 0, text_of(F.element_at(dates, -1))).otherwise(carried).alias("last"),
    )


def missing(pages: DataFrame, match_types: dict[str, str] | None = None, competitions: DataFrame | None = None) -> DataFrame:
    """page_id, kind, name, gender, date, team1, team2: the matches that pages of definition lists miss. A
    date holds until the next one, also under a heading of gender, not under one of a name. Match types
    are named by `match_types` (lower-case name -> name); competitions, whose headings lose their
    capitals, by the table's `name` of the same letters and digits, if there is one."""
    none = F.lit(None).cast("string")
    parted = folded(pages, F.struct(*(none.alias(c) for c in ("kind", "name", "by", "gender", "date", "last"))), _missing_state)
    first = F.regexp_extract("body", r"(?is)\A(.*?)(?=<dt\b|\z)", 1)
    later = F.arrays_zip(F.regexp_extract_all("body", F.lit(_TERM_PART), 1).alias("date"), F.regexp_extract_all("body", F.lit(_TERM_PART), 2).alias("html"))
    blocks = F.concat(F.array(F.struct(F.col("state.date").alias("date"), first.alias("html"))), F.transform(later, lambda x: F.struct(text_of(x["date"]).alias("date"), x["html"].alias("html"))))
    rows = parted.select("page_id", "state.kind", "state.name", "state.by", "state.gender", F.explode(blocks).alias("b"))
    rows = rows.select("page_id", "kind", "name", "by", "gender", "b.date", F.explode(F.regexp_extract_all("b.html", F.lit(_MEANING), 1)).alias("html"))
    rows = rows.filter("kind is not null and name is not null and date is not null and date != ''").withColumn("sides", F.split(text_of(F.col("html")), " vs ", 2))
    known = F.create_map(*(F.lit(x) for pair in (match_types or {}).items() for x in pair)) if match_types else F.create_map().cast("map<string,string>")
    named = F.when(F.col("by") == "match type", F.coalesce(known[F.lower("name")], F.col("name"))).otherwise(F.col("name"))
    rows = rows.select("page_id", "kind", "by", named.alias("name"), "gender", "date", F.trim(F.get("sides", F.lit(0))).alias("team1"), F.trim(F.get("sides", F.lit(1))).alias("team2"))
    if competitions is None:
        return rows.drop("by")
    proper = competitions.groupBy(key_of(F.col("name")).alias("_key")).agg(F.max("name").alias("_proper"))
    rows = rows.withColumn("_key", F.when(F.coalesce("by", F.lit("")) != "match type", key_of(F.col("name")))).join(proper, "_key", "left").withColumn("name", F.coalesce("_proper", "name")).drop("_key", "_proper", "by")
    return rows


def page_gate(parsed: dict[str, DataFrame | None]) -> DataFrame:
    """table, rows, verdict ('ok', 'warn' for tables that no page was read for, 'fail' for pages that gave no
    row: their layout may have changed) of the tables read from pages."""
    spark = next(df.sparkSession for df in parsed.values() if df is not None)
    absent = spark.createDataFrame([(n,) for n, df in parsed.items() if df is None], "table string").select("table", F.lit(None).cast("long").alias("rows"))
    out = absent
    for name, df in parsed.items():
        if df is not None:
            out = out.unionByName(df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows"))
    return out.withColumn("verdict", F.when(F.col("rows").isNull(), "warn").when(F.col("rows") == 0, "fail").otherwise("ok"))
