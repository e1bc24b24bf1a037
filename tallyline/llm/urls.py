"""URL filters: rules first, then a path-template tree for each host.

A path's segments become templates branch by branch: numbers and long hexadecimal words are
wildcards by their form; where a parent has more than BRANCHES different children, those literal
ones are that have neither ENOUGH pages or labels nor a block rate apart from their siblings'. Sibling
branches whose labelled block rates do not differ significantly are merged into one, subtrees and
all. The rules' verdicts label the pages they fit; a template is rejected if its purity, the share of
blocked among its labelled pages, smoothed towards its parent branch, its host, the same template on
all hosts and the corpus in turn, exceeds REJECT.

Pages are counted by (host, template) before anything else, so a host with a third of all pages is
a row for each of its templates. Within templates a # marks what is no literal; no path has one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Children of one parent beyond which the rare ones are variable.
BRANCHES = 20
#: Pages, or labels, with which a child stays literal; with FEW labels it does if its rate stands apart.
ENOUGH, FEW = 20, 5
SMOOTH = 4.0
REJECT = 0.5
#: Two branches differ if their rates are so many standard errors apart.
APART = 1.96


def located(pages: DataFrame) -> DataFrame:
    """page_id, host, path. Null url or none with :// has both empty."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(rest, F.lit("")).alias("_rest"))
    pages = pages.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.substring(F.col("_rest"), F.length("_host") + 1, F.length("_rest")), "^[^?#]*", 0)
    host = F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (host and path of the longest rule that fits, else null) and label (1 block, 0 allow)."""
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("int")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, label = F.when(fits, host + path).otherwise(rule), F.when(fits, int(verdict == "block")).otherwise(label)
    return pages.withColumn("rule", rule).withColumn("label", label)


#: Marks of wildcards: a number, a hexadecimal word, any rare segment. Merged branches have the smallest
#: one's name, a # and the number of the others.
NUMBER, HEX, RARE = "#n", "#x", "#*"


def _segments():
    """The path's segments, wildcards by form already put in."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    form = lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.regexp_replace(s, "^[0-9]+", NUMBER)).when(s.rlike("^[0-9a-fA-F-]{8,}$"), F.lit(HEX)).otherwise(s)
    return F.transform(parts, form)


def shown(template):
    """A template as text."""
    text = F.concat(F.lit("/"), F.array_join(template, "/"))
    for mark, plain in (("#n", "{n}"), ("#x", "{x}"), (r"#\*", "*"), (r"#(\d+)", r"|+$1")):
        text = F.regexp_replace(text, mark, plain)
    return text


def _apart(labelled, blocked, other_labelled, other_blocked):
    """Whether two block rates differ by more than APART standard errors; null without labels."""
    pooled = (blocked + other_blocked) / F.nullif(labelled + other_labelled, F.lit(0))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(labelled, F.lit(0)) + 1 / F.nullif(other_labelled, F.lit(0))))
    return F.abs(blocked / F.nullif(labelled, F.lit(0)) - other_blocked / F.nullif(other_labelled, F.lit(0))) > APART * error


_AT = ["host", "template"]
_COUNTS = ("n", "labelled", "blocked")


def _prefixes(segments: str):
    """Hashes of the first 0, 1, .. all segments, each made of the one before."""
    start = F.struct(F.lit(0).cast("long").alias("h"), F.array(F.lit(0).cast("long")).alias("all"))
    more = lambda s, x: F.struct(F.xxhash64(s["h"], x).alias("h"), F.concat(s["all"], F.array(F.xxhash64(s["h"], x))).alias("all"))
    return F.aggregate(segments, start, more, lambda s: s["all"])


def _forks(level: DataFrame) -> DataFrame:
    """host, form, stop: how many segments of a form's rest come before the first fork at which anything is to
    be decided: one with over BRANCHES children, or with two labelled ones. At all others each child
    stays as it is, so a chain, or a path that only sheds unlabelled pages, is passed in one go. Forms
    and their prefixes are told apart by hashes here."""
    level = level.withColumns({"id": F.xxhash64("host", "form"), "at_id": F.xxhash64(*_AT)})
    nodes = F.transform("rest", lambda x, i: F.struct(F.get("hashes", i).alias("node"), x.alias("child")))
    rows = level.withColumn("hashes", _prefixes("rest")).select("id", "at_id", "labelled", F.posexplode(nodes).alias("at", "x")).select("id", "at_id", "labelled", "at", "x.node", F.xxhash64("x.child").alias("child"))
    rows = materialize(rows, "url-nodes")
    key = ["at_id", "at", "node"]
    children = rows.groupBy(*key, "child").agg(F.sum("labelled").alias("labelled"))
    forks = children.groupBy(*key).agg(F.count("*").alias("children"), F.count_if(F.col("labelled") > 0).alias("told")).filter((F.col("children") > BRANCHES) | (F.col("told") > 1))
    stops = rows.join(forks.select(*key), key).groupBy("id").agg(F.min("at").alias("stop"))
    return level.select("host", "form", "id").join(stops, "id").select("host", "form", "stop")


def templates(counts: DataFrame) -> DataFrame:
    """Adds to counts (host, form, n, labelled, blocked) the template of each form. All branches grow
    from one deciding fork to the next: there their forms part, rare ones as one branch and similar
    ones as one. Forms that meet no further such fork end; the loop goes on while others are left, as
    often as deciding forks lie on one path."""
    level, done = counts.withColumn("template", F.array().cast("array<string>")).withColumn("rest", F.col("form")), None
    tail = lambda rest, at: F.slice(rest, at + 1, F.greatest(F.size(rest) - at, F.lit(0)))
    while True:
        level = level.join(_forks(level), ["host", "form"], "left")
        stop = F.coalesce("stop", F.size("rest"))
        level = level.withColumns({"template": F.concat("template", F.slice("rest", F.lit(1), stop)), "rest": tail("rest", stop)}).drop("stop")
        level = materialize(level.withColumn("child", F.get("rest", F.lit(0))), "url-forks")
        ended = level.filter("child is null").drop("rest", "child")
        done, level = ended if done is None else done.unionByName(ended), level.filter("child is not null")
        if level.isEmpty():
            return done
        children = level.groupBy(*_AT, "child").agg(*(F.sum(c).alias(c) for c in _COUNTS))
        every = children.groupBy(*_AT).agg(F.count("*").alias("children"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        apart = (F.col("labelled") >= FEW) & F.coalesce(_apart(F.col("labelled"), F.col("blocked"), F.col("l") - F.col("labelled"), F.col("b") - F.col("blocked")), F.lit(False))
        keeps = (F.col("children") <= BRANCHES) | (F.col("n") >= ENOUGH) | (F.col("labelled") >= ENOUGH) | apart | F.col("child").isin(NUMBER, HEX)
        children = children.join(every, _AT).withColumn("step", F.when(keeps, F.col("child")).otherwise(RARE))
        parted = materialize(_branches(children.groupBy(*_AT, "step").agg(*(F.sum(c).cast("double").alias(c) for c in ("labelled", "blocked")))), "url-branches")
        names = parted.groupBy(*_AT, "branch").agg(F.min("step").alias("least"), (F.count("*") - 1).alias("others"))
        name = F.when(F.col("others") > 0, F.concat("least", F.lit("#"), F.col("others").cast("string"))).otherwise(F.col("least"))
        steps = children.select(*_AT, "child", "step").join(parted.select(*_AT, "step", "branch"), [*_AT, "step"]).join(names, [*_AT, "branch"]).select(*_AT, "child", name.alias("name"))
        level = level.join(steps, [*_AT, "child"])
        level = materialize(level.select("host", "form", *_COUNTS, F.concat("template", F.array("name")).alias("template"), tail("rest", F.lit(1)).alias("rest")), "url-tree")


_NODES = "host string, template array<string>, step string"


def _branches(nodes: DataFrame) -> DataFrame:
    """Adds branch to the nodes (host, template of the parent, step, labelled, blocked): siblings by
    rising block rate, of which neighbours that do not differ are one branch. They pass in Spark's
    order, batch by batch, so that a parent may have any number."""

    def run(batches):
        at, group, n, b = object(), 0, 0.0, 0.0
        for batch in batches:
            out = []
            for host, parent, labelled, blocked in zip(*(batch.column(c).to_pylist() for c in (*_AT, "labelled", "blocked"))):
                alike = False
                if at == (host, parent) and labelled and n:
                    pooled = (b + blocked) / (n + labelled)
                    alike = abs(b / n - blocked / labelled) <= APART * (pooled * (1 - pooled) * (1 / n + 1 / labelled)) ** 0.5
                group, n, b = (group, n + labelled, b + blocked) if alike else (group + 1 if at == (host, parent) else 0, labelled, blocked)
                at = (host, parent)
                out.append(group)
            kept = batch.select([*_AT, "step"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int64())], names=[*kept.schema.names, "branch"])

    nodes = nodes.withColumn("rate", F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled")).otherwise(-1.0))
    return nodes.repartition(*_AT).sortWithinPartitions(*_AT, "rate", "step").select(*_AT, "step", "labelled", "blocked").mapInArrow(run, _NODES + ", branch long")


def template_purity(counts: DataFrame) -> DataFrame:
    """From counts (host, form, n, labelled, blocked) to (host, form, template, purity)."""
    tree = materialize(templates(counts), "url-templates")
    leaves = tree.groupBy(*_AT).agg(*(F.sum(c).alias(c) for c in ("labelled", "blocked"))).withColumn("leaf", F.xxhash64(*_AT))
    paths = leaves.select("leaf", "host", "labelled", "blocked", F.posexplode(_prefixes("template")).alias("depth", "prefix"))
    node = ["host", "depth", "prefix"]
    nodes = paths.groupBy(*node).agg(*(F.sum(c).cast("double").alias(c) for c in ("labelled", "blocked")))
    along = paths.select("leaf", *node).join(nodes, node)
    along = along.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "labelled", "blocked"))).alias("steps")).join(leaves.select("leaf", *_AT), "leaf")
    whole = tree.agg(F.sum("blocked").cast("double").alias("b"), F.sum("labelled").cast("double").alias("l"))
    rate = whole.select(((F.coalesce("b", F.lit(0.0)) + 1) / (F.coalesce("l", F.lit(0.0)) + 2)).alias("rate"))
    everywhere = leaves.groupBy("template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).join(F.broadcast(rate))  # rate: one row
    along = along.join(everywhere.select("template", ((F.col("b") + SMOOTH * F.col("rate")) / (F.col("l") + SMOOTH)).alias("prior")), "template")
    purity = F.aggregate("steps", F.col("prior"), lambda p, s: (s["blocked"] + SMOOTH * p) / (s["labelled"] + SMOOTH))
    purity = along.select(*_AT, purity.alias("purity"))
    return tree.select("host", "form", "template").join(purity, _AT)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    A rule's verdict stands; other pages are blocked if their template's purity exceeds REJECT.
    Pages without a host are judged as those of the host ''. Repeated rows each get theirs; other
    columns are ignored; an empty table gives no rows.
    """
    seen = ruled(located(pages), rules).withColumn("form", _segments())
    counts = materialize(seen.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")), "url-forms")
    known = template_purity(counts)
    out = seen.join(known, ["host", "form"])
    blocked = F.coalesce(F.col("label") == 1, F.col("purity") > REJECT)
    return out.select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), shown("template").alias("template"), "purity")
