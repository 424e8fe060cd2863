"""Linking foreign entries to records: blocking joins, one score a pair, published versions first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bibtex import first_entry
from ..functions.names import bib_last_names, overlap_of_names_udf, overlap_udf
from ..functions.text import arrow, norm_title, norm_title_column, similarity_udf, strip_latex, title_words
from ..scratch import cut
from .records import informal_strict, summary
from .search import Index, build_index, search_tokens, title_candidates
from .transform import KEY_PREFIX

#: What a way of matching is worth, what agreeing names and years add, and the thresholds.
BASES = {"source key": 100, "doi": 90, "arXiv id": 80, "title": 60, "similar title": 40}
NAMES_WORTH, SAME_YEAR, NEAR_YEAR, OTHER_KIND = 30, 10, 4, -30
SIMILAR, PUBLISHED_OVERLAP, BEST_FROM, KEPT = 0.9, 0.4, 70, 8

#: How much of a normalised title is compared first, and in how much of a title it is looked for.
START, START_READ = 100, 300
#: Fixed value: up to how many ids are broadcast, so that the texts they choose are not shuffled.
FEW = 1_000_000

# how a record's address, preprint ids and DOIs are written in entries
_IN_ADDRESS = re.compile(r"dblp\.org/rec/(.+?)(?:\.bib|\.html)?$")
_PREPRINT_URL = re.compile(r"arxiv\.org/(?:abs|pdf)/([\w.\-/]+?)(?:v\d+)?(?:\.pdf)?$")
_PREPRINT_TEXT = re.compile(r"(?:abs/|arXiv:)(\d{4}\.\d{4,5})")
_DOI = re.compile(r"(10\.\d{4,}/\S+)")

FACTS = (
    "struct<type:string,keys:array<string>,doi:string,arxiv:string,title:string,norm:string,words:array<string>,"
    "last_names:array<string>,year:int>"
)


def _doi(value: str) -> str | None:
    found = _DOI.search(re.sub("[{}]", "", value).strip())
    return found[1] if found else None


def entry_facts(raw: str | None) -> dict | None:
    """What the first entry of a text offers for linking; null without an entry."""
    entry = first_entry(raw)
    if entry is None:
        return None
    values: dict[str, str] = {}
    for name, said in entry.fields:
        values.setdefault(name, said)
    value = lambda name: values.get(name) or ""
    keys = [entry.key.removeprefix(KEY_PREFIX)] * entry.key.startswith(KEY_PREFIX)
    keys += _IN_ADDRESS.findall(value("biburl"))[:1]
    marked = "arxiv" in (value("archiveprefix").lower(), value("eprinttype").lower())
    arxiv = value("eprint") if marked else ""
    if not arxiv:
        in_url = _PREPRINT_URL.search(value("url"))
        in_text = _PREPRINT_TEXT.search(" ".join(map(value, ("volume", "journal", "note"))))
        arxiv = in_url[1] if in_url else in_text[1] if in_text else ""
    year = re.search(r"\d{4}", value("year"))
    title = value("title")
    doi = _doi(value("doi")) or (_doi(value("url")) if "doi.org" in value("url") else None)
    people = value("author") or value("editor")
    return {
        "type": entry.type, "keys": keys, "doi": doi.lower() if doi else None, "arxiv": re.sub(r"v\d+$", "", arxiv) or None,
        "title": title or None, "norm": norm_title(title) if title else None,
        "words": sorted({t for w in title_words(strip_latex(title)) for t in search_tokens(w)}),
        "last_names": bib_last_names(people) if people else [], "year": int(year[0]) if year else None,
    }


def _facts(raw):
    found = entry_facts(raw)
    return [found] if found else []


_facts_udf = arrow(_facts, f"array<{FACTS}>")


def entry_facts_column(raw) -> Column:
    """entry_facts() of a column; an Arrow UDF returns no lone struct, so it comes in a list."""
    return F.get(_facts_udf(raw), F.lit(0))


def entry_table(entries: DataFrame) -> DataFrame:
    """(entry, f) of the entries (entry, raw) that have one, as a scratch table, so that each is read once."""
    # exploded, not filtered; entries are small: a file of many would be read by one task, and by few if partitions were merged by their bytes
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(entries.repartition(tasks, "entry").select("entry", F.explode(_facts_udf("raw")).alias("f")))


def found_pairs(pubs: DataFrame, index: Index | None, facts: DataFrame) -> DataFrame:
    """(entry, id, how, base, seq): the best way each record was found for each entry, data sets excepted.

    facts: (entry, f). What an entry names (keys, DOI, preprint, title) meets what records offer in one join by equality;
    for titles that is the outcome of title_pairs(). seq orders records as they are found: by way, then id.
    """
    pubs = pubs.where("type <> 'data'")
    title = F.when(F.col("f.title").isNotNull() & (F.size("f.words") > 0), _title_handle(F.col("f.norm"), F.col("f.words")))
    named = [F.transform(F.coalesce("f.keys", F.array().cast("array<string>")), lambda k: F.struct(F.lit("key").alias("by"), k.alias("value")))]
    named += [F.array(F.struct(F.lit(by).alias("by"), value.alias("value"))) for by, value in (
        ("doi", F.col("f.doi")), ("preprint", F.concat(F.lit("abs/"), F.col("f.arxiv"))), ("title", title))]
    asked = facts.select("entry", F.explode(F.array_distinct(F.concat(*named))).alias("n")).select("entry", "n.by", "n.value").where("value is not null")
    ways = list(BASES)
    offers = lambda d, by, how, value: d.select(F.lit(by).alias("by"), F.col(value).alias("value"), "id", F.lit(ways.index(how)).alias("way"))
    alike = title_pairs(pubs, index, facts)
    way = F.when(F.col("same"), ways.index("title")).otherwise(ways.index("similar title"))
    alike = alike.select(F.lit("title").alias("by"), F.col("handle").alias("value"), "id", way.alias("way"))
    offered = offers(pubs, "key", "source key", "key").unionByName(offers(pubs.withColumn("d", F.lower("doi")), "doi", "doi", "d")).unionByName(
        offers(pubs.where("venue = 'CoRR'"), "preprint", "arXiv id", "volume")
    ).where("value is not null").unionByName(alike)
    # a few names may make many pairs, so the tasks are not merged by their bytes
    tasks = int(pubs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = asked.repartition(tasks, "by", "value").join(offered.repartition(tasks, "by", "value"), ["by", "value"])
    # a higher base replaces how a record was found, but not its place; numbers alone are grouped, as texts would be sorted
    base = F.get(F.array(*map(F.lit, BASES.values())), F.col("way"))
    found = found.groupBy("entry", "id").agg(F.max(base * len(ways) - F.col("way")).alias("best"), F.min("way").alias("first"))
    best = F.pmod(-F.col("best"), F.lit(len(ways)))
    return found.select("entry", "id", F.get(F.array(*map(F.lit, ways)), best).alias("how"), F.get(F.array(*map(F.lit, BASES.values())), best).alias("base"), F.struct(F.col("first").alias("way"), "id").alias("seq"))


def _title_handle(norm: Column, words: Column) -> Column:
    """What an entry's title is known by: its normalised form and the words that a record's title must have."""
    return F.concat_ws("\n", norm, F.array_join(words, " "))


def title_pairs(pubs: DataFrame, index: Index | None, facts: DataFrame) -> DataFrame:
    """(handle, id, same): the records whose title has all words of an entry's title and is the same or similar.

    Entries of one title are asked for once. The ratio of two texts is at most twice the shorter length over both lengths, so
    only records whose title is about as long can be found; without an index their words alone are indexed, which are few if
    records have longer titles than entries.
    """
    titled = facts.where("f.title is not null and size(f.words) > 0").select("entry", F.col("f.words").alias("words"), F.col("f.norm").alias("norm"))
    # one entry stands for all of its title; both sides are kept as scratch tables, since they are read several times
    asked = cut(titled.groupBy("norm", "words").agg(F.min("entry").alias("entry")))
    shortest, longest = asked.agg(F.min(F.length("norm")), F.max(F.length("norm"))).first()
    # letters and digits of a title's beginning, up to a command, stay in its normalised form, so most long ones are told without normalising them
    most = int((longest or 0) * (2 / SIMILAR - 1)) + 1
    start = _start(pubs) if 2 * most <= START_READ else F.substring("title", 1, 2 * most + 100)
    if most < 500:
        longer = start.rlike(rf"^(?:[^a-zA-Z0-9\\]*+[a-zA-Z0-9]){{{most + 1}}}")
    else:  # a matcher is nested as deep as it counts
        longer = F.length(F.regexp_replace(F.substring_index(start, "\\", 1), "[^a-zA-Z0-9]+", "")) > most
    titles = _normalised(pubs.where(~longer), "id", "title")
    titles = cut(titles.where(_may_be_alike(F.length("norm"), F.greatest(F.lit(shortest), F.least(F.lit(longest), F.length("norm"))))))
    cand = title_candidates(titles, index or build_index(titles, ("title",)), asked.select("entry", "words"))
    both = cand.join(asked, "entry").join(titles.select("id", F.col("norm").alias("other")), "id").where(_may_be_alike(F.length("norm"), F.length("other")))
    pairs = both.select("id", "other", "norm", _title_handle(F.col("norm"), F.col("words")).alias("handle"))
    # two titles are compared once, however many records have the one
    same = F.col("other") == F.col("norm")
    ratio = F.when(same, 1.0).otherwise(similarity_udf(F.when(~same, F.col("other")), F.when(~same, F.col("norm"))))
    alike = pairs.select("other", "norm").distinct().where(ratio > SIMILAR)
    return pairs.join(alike, ["other", "norm"]).select("handle", "id", same.alias("same"))


def _may_be_alike(a: Column, b: Column) -> Column:
    """Whether texts of these lengths can have a ratio above SIMILAR."""
    return F.least(a, b) * 2 >= (a + b) * SIMILAR


def _normalised(pubs: DataFrame, *columns: str) -> DataFrame:
    """columns and the normalised title norm of the records; a stored one is taken where there is one."""
    norm = F.col("norm_title") if "norm_title" in pubs.columns else norm_title_column(F.col("title"))
    # generated, not projected: a projection would be merged into each use and normalise again
    return pubs.select(*columns, F.explode(F.array(norm)).alias("norm"))


def _start(pubs: DataFrame) -> Column:
    """A beginning of the records' titles: title_start where that is stored, else the first START_READ characters."""
    return F.substring("title_start" if "title_start" in pubs.columns else "title", 1, START_READ)


def _among(pubs: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of some ids, chosen where they are read if the ids are few."""
    few = ids.limit(FEW + 1).count() <= FEW
    return pubs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _alike_starts(pubs: DataFrame, sides: DataFrame, records: DataFrame | None) -> DataFrame:
    """Ids of sides, some of pubs, whose normalised titles begin, in their first START characters, like one of the other side.

    The sides are the informal records and those that are not. Most are told by the beginning of the title, whose normalised
    form begins the whole one; a beginning with too few letters and digits is not enough, and then the title is normalised whole.
    """
    digest = lambda norm: F.xxhash64(F.substring(norm, 1, START)).alias("start")
    # generated, as in _normalised()
    rows = sides.select("id", informal_strict().alias("own"), F.explode(F.array(_start(sides))).alias("title"))
    rows = rows.select("id", "own", F.explode(F.array(norm_title_column(F.col("title")))).alias("norm"))
    begun = cut(rows.select("id", "own", F.when(F.length("norm") >= START, digest(F.col("norm"))).alias("start")))
    left = begun.where("start is null").select("id")
    if not left.isEmpty():
        whole = _normalised(_among(pubs, left).withColumn("own", informal_strict()), "id", "own")
        begun = begun.where("start is not null").unionByName(cut(whole.where("norm <> ''").select("id", "own", digest(F.col("norm")))))
    if records is not None:
        begun = begun.where("not own").unionByName(begun.where("own").join(records.select("id"), "id", "left_semi"))
    common = begun.groupBy("start").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("most and not least")
    return cut(begun.join(common, "start", "left_semi").select("id"))


def published_versions(pubs: DataFrame, records: DataFrame) -> DataFrame:
    """(id, version, overlap): other records that are the published form of the informal ones among records, which are some of pubs.

    Same normalised title that is not empty, not informal, neither proceedings nor data, names that overlap enough.
    """
    sides = pubs.where(informal_strict() | ~F.col("type").isin("proceedings", "data"))
    if "norm_title" not in pubs.columns:
        # only titles that begin like one of the other side are normalised whole
        # chosen from pubs, not from sides: ids are not taken below a filter, and then labels and the like join with all texts
        sides = _among(pubs, _alike_starts(pubs, sides, None if records is pubs else records))
    rows = _normalised(sides.withColumn("own", informal_strict()), "id", "key", "authors", "own")
    # read twice, so kept: titles meet by their digests
    rows = cut(rows.where("norm <> ''").select("id", "key", "authors", "own", F.sha2("norm", 256).alias("title_digest")))
    own = rows.where("own") if records is pubs else rows.where("own").join(records.select("id"), "id", "left_semi")
    own = own.select(F.col("id").alias("entry"), F.col("key").alias("own_key"), F.col("authors").alias("own_authors"), "title_digest")
    both = own.join(rows.where("not own"), "title_digest").where("key <> own_key")
    # copies of one title make many pairs in one task, so they are dealt out before names are compared
    both = both.repartition(int(pubs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # generated, not projected: the condition would be taken to where the pairs are made, and names compared twice
    both = both.select(F.col("entry").alias("id"), F.col("id").alias("version"), F.explode(F.array(overlap_of_names_udf("authors", "own_authors"))).alias("overlap"))
    return both.where(F.col("overlap") > PUBLISHED_OVERLAP)


def upgrades(pubs: DataFrame, index: Index | None, items: DataFrame) -> DataFrame:
    """(record, version): keys of the published versions of the records that items of kind record hold.

    Equal titles meet without the index; callers that hold one may pass it.
    """
    held = pubs.join(items.where("kind = 'record'").select(F.col("record").alias("key")).distinct(), "key", "left_semi")
    key = lambda name: pubs.select(F.col("id").alias(f"{name}_id"), F.col("key").alias(name))
    found = published_versions(pubs, held)
    return found.join(key("record"), F.col("id") == F.col("record_id")).join(key("version_key"), F.col("version") == F.col("version_key_id")).select(
        "record", F.col("version_key").alias("version")
    )


def match(pubs: DataFrame, index: Index | None, entries: DataFrame) -> DataFrame:
    """(entry, rank, key, how, score, best, summary columns): up to KEPT candidates of each entry (entry, raw).

    score: the way's base, agreement of names and years, less if only the record is a proceedings.
    If the first candidate is informal, its published versions move to the front one after
    another; one that was not found before takes the score of the candidate then in front. best marks
    the first candidate from BEST_FROM on.
    """
    facts = entry_table(entries)
    people = F.when(F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0, F.col("authors")).otherwise(F.col("editors"))
    rows = found_pairs(pubs, index, facts).join(facts, "entry").join(pubs.withColumn("people", people).select("id", "key", "type", "venue", "publtype", "year", "people"), "id")
    years = F.when(F.col("year") == F.col("f.year"), SAME_YEAR).when(F.abs(F.col("year") - F.col("f.year")) <= 1, NEAR_YEAR).otherwise(0)
    kind = F.when((F.col("type") == "proceedings") & (F.col("f.type") != "proceedings"), OTHER_KIND).otherwise(0)
    score = F.bround(F.col("base") + NAMES_WORTH * overlap_udf("f.last_names", "people") + years + kind, 1)
    rows = rows.withColumn("score", score).withColumn("informal", informal_strict())
    order = Window.partitionBy("entry").orderBy(F.desc("score"), "seq")
    rows = cut(rows.select("entry", "id", "key", "how", "score", "informal", F.row_number().over(order).alias("at")))
    first = cut(rows.where("at = 1 and informal").select("entry", F.col("id").alias("first_id"), F.col("key").alias("first_key"), F.col("score").alias("first_score")))
    preprints = pubs.join(first.select(F.col("first_id").alias("id")).distinct(), "id", "left_semi")
    # without a preprint no title is read
    versions = first.selectExpr("first_id as id", "first_id as version", "0d as overlap") if first.isEmpty() else published_versions(pubs, preprints)
    promoted = first.join(versions.withColumnRenamed("id", "first_id"), "first_id").select("entry", F.col("version").alias("id"), "first_key", "first_score")
    both = rows.join(promoted, ["entry", "id"], "full")
    # in the order in which versions are found, the score of one that is new is that of the one before it
    before = Window.partitionBy("entry", F.col("first_key").isNull()).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.coalesce("score", F.when(F.col("first_key").isNotNull(), F.coalesce(F.last("score", True).over(before), F.col("first_score"))))
    how = F.when(F.col("how").isNull(), F.concat(F.lit("published version of "), "first_key")).when(
        F.col("first_key").isNotNull(), F.concat("how", F.lit(", published version"))
    ).otherwise(F.col("how"))
    both = both.select("entry", "id", how.alias("how"), taken.alias("score"), "at", F.when(F.col("first_key").isNotNull(), F.col("id")).alias("moved"))
    final = Window.partitionBy("entry").orderBy(F.desc_nulls_last("moved"), F.asc_nulls_last("at"))
    both = both.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= KEPT)
    shown = summary(pubs, "id")
    return both.join(shown, "id").select("entry", "rank", "how", "score", ((F.col("rank") == 1) & (F.col("score") >= BEST_FROM)).alias("best"), *[c for c in shown.columns if c != "id"], "id")
