"""URL filters: rules by host and path, and a path-template tree that rejects impure templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: A branch stays apart from its siblings if their rates of blocked labels differ by more standard errors than this.
MERGE_Z = 1.96
#: Pseudo-counts that draw a template's purity to its host's, and a host's to the whole.
SMOOTHING = 8.0
#: Smoothed part of blocked labels from which a template is rejected.
REJECT_FROM = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end.

    Null urls and urls without :// have an empty host and path. White space and ports stay as they are.
    """
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    tail = F.coalesce(tail, F.lit(""))
    return lower_ascii(F.regexp_extract(tail, r"^([^/?#]*)", 1)), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and every subdomain if the path starts with the rule's path. Longest counts
    the characters of host and path together; of two as long the later in the list wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(segment: Column) -> Column:
    """A segment's text, or its shape where it is a number, a hexadecimal or mixed identifier."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{2,5}$"), F.regexp_replace(segment, r"^[0-9]+", "{n}"))
        .when(segment.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{x}"))
        .when(segment.rlike(r"[0-9]") & (F.length(segment) > 12), F.lit("{id}"))
        .otherwise(segment)
    )


def _segments(path: Column) -> Column:
    """The shaped segments of a whole path; a last slash is a segment of its own."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(parts, _shape))


def _apart(blocked: Column, labelled: Column, others_blocked: Column, others_labelled: Column) -> Column:
    """1 if a branch's rate is above that of the others by the two-proportion test, -1 if below, else 0."""
    own, rest = blocked / labelled, others_blocked / others_labelled
    pooled = (blocked + others_blocked) / (labelled + others_labelled)
    error = F.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / others_labelled))
    z = (own - rest) / F.greatest(error, F.lit(1e-9))
    return F.when(others_labelled <= 0, 0).when(z > MERGE_Z, 1).when(z < -MERGE_Z, -1).otherwise(0)


def classes(branches: DataFrame) -> DataFrame:
    """(host, made, seg, class) of branches (host, made, seg, labelled, blocked): statistically similar ones share a class.

    All labelled branches of a node begin in one class. Each is held against all the others of its class; those above go to
    a class of their own and those below to another, until no branch is apart from its class. Every
    round is an aggregation over a node's classes, so no task holds a node. Unlabelled branches join the node's
    class if it has one only, or none; else they are a class of their own, ?.
    """
    node = ["host", "made"]
    known = branches.where("labelled > 0").withColumn("class", F.lit(""))
    while True:
        sums = known.groupBy(*node, "class").agg(F.sum("labelled").alias("all_l"), F.sum("blocked").alias("all_b"))
        sign = _apart(F.col("blocked"), F.col("labelled"), F.col("all_b") - F.col("blocked"), F.col("all_l") - F.col("labelled"))
        known = cut(known.join(sums, [*node, "class"]).withColumn("sign", sign).select(
            *node, "seg", "labelled", "blocked", F.concat("class", F.when(F.col("sign") > 0, "+").when(F.col("sign") < 0, "-").otherwise("")).alias("class"), "sign"
        ))
        if not known.where("sign <> 0").limit(1).count():
            break
        known = known.drop("sign")
    several = known.groupBy(*node).agg(F.min("class").alias("only"), F.count_distinct("class").alias("k"))
    rest = branches.where("labelled = 0").join(several, node, "left")
    rest = rest.select(*node, "seg", F.when(F.coalesce("k", F.lit(0)) > 1, "?").otherwise(F.coalesce("only", F.lit(""))).alias("class"))
    return known.select(*node, "seg", "class").unionByName(rest)


def templates(paths: DataFrame) -> DataFrame:
    """(host, shape, template, n, labelled, blocked, purity, rejected) for each distinct (host, shape) of paths.

    paths has host, shape (array of shaped segments), n, labelled and blocked counts. The tree of each
    host is built level by level from these sums, as deep as two paths go together. At a node the
    branches of one class (see classes()) become one wildcard: * for those that nothing sets apart, {+}, {-} and so on
    for those above and below, {?} for unlabelled ones beside several classes; a class of one branch keeps its
    segment, however many siblings it has. purity is the part of blocked labels, drawn to the host's and that to the
    whole; a template is rejected from REJECT_FROM on, and only on labels of its own: at least half of them blocked.
    """
    node = ["host", "made"]
    columns = ["host", "shape", "n", "labelled", "blocked", "made"]
    cur, done = paths.select(*columns[:-1], F.array().cast("array<string>").alias("made")), None
    level = 0
    while True:
        # a node of one path needs no tree below it
        alone = cut(cur.groupBy(*node).agg(F.count("*").alias("paths")))
        cur = cur.join(alone, node).withColumn("open", (F.size("shape") > level) & (F.col("paths") > 1))
        cur = cut(cur.select(*columns, "open"))
        ended = cur.where("not open").select(*columns[:-1], F.concat("made", F.slice("shape", level + 1, F.greatest(F.size("shape") - level, F.lit(0)))).alias("made"))
        done = ended if done is None else done.unionByName(ended)
        cur = cur.where("open").drop("open").withColumn("seg", F.get("shape", F.lit(level)))
        if not cur.limit(1).count():
            break
        branch = cut(cur.groupBy(*node, "seg").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")))
        own = cut(classes(branch))
        size = own.groupBy(*node, "class").agg(F.count("*").alias("branches"))
        name = F.when(F.col("branches") == 1, F.col("seg")).when(F.col("class") == "", "*").otherwise(F.concat(F.lit("{"), F.col("class"), F.lit("}")))
        named = own.join(size, [*node, "class"]).select(*node, "seg", name.alias("step"))
        cur = cut(cur.join(named, [*node, "seg"]).select(*columns[:-1], F.concat("made", F.array("step")).alias("made")))
        level += 1
    cur = cut(done.withColumn("template", F.concat(F.lit("/"), F.array_join("made", "/"))))
    own = cur.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    hosts = own.groupBy(F.col("host").alias("h")).agg(F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb"))
    labelled, blocked = own.agg(F.sum("labelled"), F.sum("blocked")).first()
    base = (blocked or 0) / max(labelled or 0, 1)
    host_rate = (F.col("hb") + SMOOTHING * base) / (F.col("hl") + SMOOTHING)
    purity = (F.col("blocked") + SMOOTHING * host_rate) / (F.col("labelled") + SMOOTHING)
    judged = own.join(hosts, F.col("host") == F.col("h")).withColumn("purity", purity)
    rejected = (F.col("purity") >= REJECT_FROM) & (F.col("labelled") > 0) & (F.col("blocked") * 2 >= F.col("labelled"))
    judged = judged.select("host", "template", "n", "labelled", "blocked", "purity", rejected.alias("rejected"))
    return cur.select("host", "shape", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of pages.

    The verdict is the rule's, else the template's: block if it is rejected, else allow. The labels of
    the tree are those of labels, rows (host, path, blocked in 0 and 1) which count beside the rules,
    and the verdicts of the rules on the pages themselves. Null and malformed urls have an empty host
    and path, the template / and are judged like others. Repeated rows count as often as they stand.
    """
    host, path = split_url(F.col(url))
    work = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    work = work.withColumn("fit", match_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", _segments(F.col("path")))
    work = cut(work)
    known = work.select("host", "shape", F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == "block").cast("int")).alias("y"), F.lit(1).alias("page"))
    if labels is not None:
        known = known.unionByName(labels.select("host", _segments(F.col("path")).alias("shape"), F.col("blocked").cast("int").alias("y"), F.lit(0).alias("page")))
    sums = known.groupBy("host", "shape").agg(
        F.sum("page").alias("n"), F.count("y").alias("labelled"), F.coalesce(F.sum("y"), F.lit(0)).alias("blocked")
    )
    tree = templates(sums).select(F.col("host").alias("h"), F.col("shape").alias("s"), "template", "purity", "rejected")
    found = work.join(tree, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
