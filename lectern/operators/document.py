"""Bibliography documents: items in order, rendered, keyed, checked for duplicates, sorted, compared."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.bibtex import first_entry, fold_space, same_entry, set_key, sniff_key
from ..functions.bibtex import render as render_entry
from ..functions.latex import to_display
from ..functions.text import arrow
from .transform import Options, foreign_entry, record_entry, replace, spellings_of, text_of

#: Suffixes of keys that are taken.
SUFFIXES = "bcdefghijklmnopqrstuvwxyz"
#: An item: document, place in it, kind (record, raw or other), record key, own citation key, raw text, record that
#: a raw entry was matched with, and the text an item had before it was replaced by a record.
ITEMS_DDL = "doc bigint, pos int, kind string, record string, key string, raw string, match string, orig string"

RENDERED_DDL = (
    "doc bigint, pos int, kind string, text string, key string, type string, fields array<struct<name:string,value:string>>, "
    "subst_text string, alt_text string, alt_key string, same boolean, error string"
)


def unique_key(key: str, taken) -> str:
    """The key, or with the first free suffix; after z an underscore, free or not."""
    return next((k for k in (key, *(key + c for c in SUFFIXES)) if k not in taken), key + "_")


def unique_keys(items: DataFrame, doc: str = "doc", pos: str = "pos", key: str = "key", fixed: str = "fixed") -> DataFrame:
    """items with a column unique: keys made unique in the order of a document.

    Keys of fixed items are taken from the beginning and stay as they are. The rule is sequential, so
    a document is one group; documents are what people edit, and stay small.
    """
    schema = StructType([*items.schema.fields, StructField("unique", StringType())])

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r[pos])
        taken = {r[key] for r in rows if r[fixed] and r[key] is not None}
        for r in rows:
            r["unique"] = r[key] if r[fixed] or r[key] is None else unique_key(r[key], taken)
            taken.add(r["unique"])
        return pa.Table.from_pylist(rows, group.schema.append(pa.field("unique", pa.string())))

    return items.groupBy(doc).applyInArrow(run, schema)


def _rendered(items: list[dict], o: Options) -> list[dict]:
    """The items of one document, in order, as rows of RENDERED_DDL; rec and xref, alt_rec and alt_xref come with them."""
    taken = {i["key"] for i in items if i["kind"] == "record" and i["key"]}
    taken |= {k for i in items if i["kind"] == "raw" and (k := sniff_key(i["raw"]))}
    texts = [i["raw"] for i in items if i["kind"] == "raw"] + [i["orig"] for i in items if i["orig"]]
    spellings = spellings_of(texts) if o.keep_name_spellings else {}
    out = []
    for i in items:
        row = dict.fromkeys(["text", "key", "type", "fields", "subst_text", "alt_text", "alt_key", "same", "error"]) | {k: i[k] for k in ("doc", "pos", "kind")}
        try:
            row |= _record_item(i, o, taken, spellings) if i["kind"] == "record" else _raw_item(i, o, taken, spellings) if i["kind"] == "raw" else {"text": i["raw"] or ""}
        except Exception as problem:  # noqa: BLE001  one bad item must not lose the document
            row |= {"text": i["raw"] or "", "error": str(problem)}
        out.append(row)
    return out


def _listed(fields) -> list[dict]:
    return [{"name": n, "value": v} for n, v in fields]


def _record_item(i: dict, o: Options, taken: set, spellings: dict) -> dict:
    if i["rec"] is None:
        return {"text": f"% record {i['record']} not found in the database", "error": "not found"}
    entry = record_entry(i["rec"], i["xref"], o, i["key"] or None, spellings)
    if not i["key"]:
        entry = replace(entry, key=unique_key(entry.key, taken))
    taken.add(entry.key)
    return {"text": text_of(entry), "key": entry.key, "type": entry.type, "fields": _listed(entry.fields)}


def _raw_item(i: dict, o: Options, taken: set, spellings: dict) -> dict:
    item = first_entry(i["raw"])
    if item is None:
        return {"text": i["raw"]}
    taken.add(item.key)
    row = {"text": i["raw"], "key": item.key, "type": item.type, "fields": _listed(item.fields)}
    changed = foreign_entry(item, o)
    if list(changed.fields) != item.fields:
        row["subst_text"] = text_of(changed)
        row["text"] = row["subst_text"] if o.normalize_foreign else row["text"]
    if o.uniform_layout:
        fields = changed.fields if o.normalize_foreign else item.fields
        row["text"] = render_entry(item.type, item.key, [(n, fold_space(n, v)) for n, v in fields], item.exprs)
    if i["alt_rec"] is not None:
        alt = record_entry(i["alt_rec"], i["alt_xref"], o, item.key if o.keep_keys else None, spellings)
        row |= {"alt_text": text_of(alt), "alt_key": alt.key, "same": same_entry(item, (alt.type, alt.key, alt.fields))}
    return row


def render(pubs: DataFrame, items: DataFrame, options: Options | None = None) -> DataFrame:
    """Rows of RENDERED_DDL with duplicate (how often a document has the key, if more than once) for every item.

    Records and their proceedings are joined in; a document's items then meet in one group, since a key
    depends on the keys before it and a spelling on the whole document.
    """
    o = options or Options()
    packed = F.struct(*[c for c in pubs.columns])
    recs = pubs.select(F.col("key").alias("k"), packed.alias("r"), F.col("crossref").alias("c"))

    def joined(df: DataFrame, by: str, rec: str, xref: str) -> DataFrame:
        own = recs.select(F.col("k").alias(f"{rec}_k"), F.col("r").alias(rec), F.col("c").alias(f"{rec}_c"))
        parent = recs.select(F.col("k").alias(f"{xref}_k"), F.col("r").alias(xref))
        df = df.join(own, F.col(by) == F.col(f"{rec}_k"), "left").join(parent, F.col(f"{rec}_c") == F.col(f"{xref}_k"), "left")
        return df.drop(f"{rec}_k", f"{rec}_c", f"{xref}_k")

    rows = joined(joined(items, "record", "rec", "xref"), "match", "alt_rec", "alt_xref")
    pairs = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    shape = pa.schema([(f.name, kinds.get(f.dataType.simpleString(), pairs)) for f in StructType.fromDDL(RENDERED_DDL).fields])

    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_rendered(sorted(group.to_pylist(), key=lambda r: r["pos"]), o), shape)

    made = rows.groupBy("doc").applyInArrow(run, RENDERED_DDL)
    return duplicates(made)


def duplicates(items: DataFrame) -> DataFrame:
    """items with duplicate: how many items of the document have the key, null if it is alone or null."""
    n = F.count("*").over(Window.partitionBy("doc", "key"))
    return items.withColumn("duplicate", F.when(F.col("key").isNotNull() & (n > 1), n))


def bib_text(rendered: DataFrame) -> DataFrame:
    """(doc, bib): the texts of a document, stripped, in order, an empty line between them and a line end after."""
    stripped = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    parts = rendered.select("doc", "pos", stripped.alias("t")).where("t <> ''")
    joined = parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("p"))
    bib = F.concat(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.lit("\n"))
    return rendered.select("doc").distinct().join(joined, "doc", "left").select("doc", F.coalesce(bib, F.lit("\n")).alias("bib"))


# ---------------------------------------------------------------- relational steps on documents


def best_copies(items: DataFrame) -> DataFrame:
    """items with keep: of items with one key in a document the best copy stays: a record, then an edited one,
    then one that agrees with its record, then the first. Columns: doc, pos, key, kind, orig, same."""
    worth = F.when(F.col("kind") == "record", 4).otherwise(0) + F.when(F.length(F.coalesce("orig", F.lit(""))) > 0, 2).otherwise(0) + F.when(F.col("same"), 1).otherwise(0)
    order = Window.partitionBy("doc", "key").orderBy(F.desc("worth"), "pos")
    ranked = items.withColumn("worth", worth).withColumn("r", F.row_number().over(order))
    return ranked.withColumn("keep", F.col("key").isNull() | (F.col("r") == 1)).drop("worth", "r")


def status_counts(items: DataFrame) -> DataFrame:
    """By document: raw entries that are up to date, differ, are uncertain, not found, without substitutions, unchecked.

    Columns: doc, kind, has_alt, same, n_candidates, checked, has_subst.
    """
    raw = F.col("kind") == "raw"
    count = lambda c: F.count_if(raw & c)
    return items.groupBy("doc").agg(
        F.count_if(raw).alias("raw"), count(F.col("has_alt") & F.col("same")).alias("up_to_date"), count(F.col("has_alt") & ~F.col("same")).alias("differ"),
        count(~F.col("has_alt") & (F.col("n_candidates") > 0)).alias("uncertain"), count(F.col("checked") & (F.col("n_candidates") == 0)).alias("not_found"),
        count(F.col("has_subst") & ~F.col("has_alt")).alias("unsubstituted"), count(~F.col("checked")).alias("unchecked"),
    )


def status(has_error: Column) -> Column:
    """The state an item is shown in, from the columns of status_counts() and orig and upgrade."""
    raw = F.when(F.col("has_alt") & F.col("same"), "up to date").when(F.col("has_alt"), "differs").when(
        F.col("n_candidates") > 0, "possible matches"
    ).when(F.col("checked"), "not found").otherwise("not checked")
    record = F.when(F.col("upgrade"), "published version available").when(F.col("orig").isNotNull(), "updated").otherwise("record")
    return F.when(has_error, "error").when(F.col("kind") == "other", "other").when(F.col("kind") == "record", record).otherwise(raw)


def without_present(fresh: DataFrame, items: DataFrame) -> DataFrame:
    """Parsed items to paste: entries whose key an item of the document has already are left out."""
    have = items.where("key is not null").select("doc", "key").distinct()
    return fresh.where("kind <> 'entry'").unionByName(fresh.where("kind = 'entry'").join(have, ["doc", "key"], "left_anti").select(fresh.columns))


def present(records: DataFrame, items: DataFrame) -> DataFrame:
    """The (doc, record) of records that a document has already, as a record or as the match of a raw entry."""
    own = items.select("doc", F.when(F.col("kind") == "record", F.col("record")).when(F.col("kind") == "raw", F.col("match")).alias("record")).where("record is not null")
    return records.join(own, ["doc", "record"], "left_semi")


def add_absent(records: DataFrame, items: DataFrame) -> DataFrame:
    """The items to add for records, a whole listing say, that a document does not have."""
    return records.join(present(records, items), ["doc", "record"], "left_anti")


def field_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(entry, name, left, right, changed, at) of two field lists (entry, pos, name, value).

    White space is folded; of repeated names the last value counts; the right list's order comes first.
    """
    fold = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    side = lambda d, n: d.groupBy("entry", "name").agg(F.max_by(fold, "pos").alias(n), F.min("pos").alias(f"{n}_at"))
    both = side(left, "left").join(side(right, "right"), ["entry", "name"], "full")
    at = F.row_number().over(Window.partitionBy("entry").orderBy(F.asc_nulls_last("right_at"), "left_at"))
    return both.select("entry", "name", "left", "right", (~F.col("left").eqNullSafe(F.col("right"))).alias("changed"), at.alias("at"))


def sort_items(items: DataFrame, by: str = "key") -> DataFrame:
    """items with at, their place after sorting: macros and preambles, then other text, then entries.

    by: key (lower-cased), or author (last name of the first author or editor, year, key; columns first_person, year).
    Entries with equal keys, and other text, keep their order.
    """
    macro = (F.col("kind") == "other") & F.col("raw").rlike(r"(?i)^\s*@\s*(string|preamble)")
    group = F.when(macro, 0).when(F.col("kind") == "other", 1).otherwise(2)
    key = F.lower(F.coalesce("key", F.lit("")))
    if by != "key":
        first = F.regexp_replace(F.get(F.split(F.coalesce("first_person", F.lit("")), r"\s+and\s+"), F.lit(0)), "[{}\\\\\"']", "")
        last = F.when(F.contains(first, F.lit(",")), F.substring_index(first, ",", 1)).otherwise(F.element_at(F.split(first, r"\s+"), -1))
        key = F.concat_ws(" ", F.lower(last), F.coalesce(F.col("year").cast("string"), F.lit("")), key)
    order = Window.partitionBy("doc").orderBy(group, F.when(group == 2, key), "pos")
    return items.withColumn("at", F.row_number().over(order))


# ---------------------------------------------------------------- state transitions


def use_record(items: DataFrame, keep_keys: bool = True) -> DataFrame:
    """Raw items with a match become record items: the old text is kept, and the key if keys are kept."""
    hit = (F.col("kind") == "raw") & F.col("match").isNotNull()
    sniffed = F.nullif(F.regexp_extract("raw", r"^\s*@\s*\w+\s*[{(]\s*([^,\s]+)", 1), F.lit(""))
    return items.select(
        "doc", "pos", F.when(hit, "record").otherwise(F.col("kind")).alias("kind"), F.when(hit, F.col("match")).otherwise(F.col("record")).alias("record"),
        F.when(hit, sniffed if keep_keys else F.lit(None).cast("string")).otherwise(F.col("key")).alias("key"),
        F.when(~hit, F.col("raw")).alias("raw"), F.col("match"), F.when(hit, F.coalesce("orig", "raw")).otherwise(F.col("orig")).alias("orig"),
    )


def apply_substitutions(items: DataFrame, rendered: DataFrame) -> DataFrame:
    """Raw items that substitutions would change, and that no record covers, take the changed text; the old one is kept."""
    changed = rendered.where("subst_text is not null and alt_text is null").select("doc", "pos", "subst_text")
    hit = (F.col("kind") == "raw") & F.col("subst_text").isNotNull()
    return items.join(changed, ["doc", "pos"], "left").withColumn("orig", F.when(hit, F.coalesce("orig", "raw")).otherwise(F.col("orig"))).withColumn(
        "raw", F.when(hit, F.col("subst_text")).otherwise(F.col("raw"))
    ).select(items.columns)


def upgrade(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Record items whose record has a published version (record, version: keys) move to the first one by key."""
    first = versions.groupBy("record").agg(F.min("version").alias("version"))
    hit = (F.col("kind") == "record") & F.col("version").isNotNull()
    return items.join(first, "record", "left").withColumn("record", F.when(hit, F.col("version")).otherwise(F.col("record"))).select(items.columns)


def revert(items: DataFrame) -> DataFrame:
    """Items that keep an old text become raw items of that text again."""
    hit = F.col("orig").isNotNull()
    return items.select(
        "doc", "pos", F.when(hit, "raw").otherwise(F.col("kind")).alias("kind"), F.when(~hit, F.col("record")).alias("record"), F.when(~hit, F.col("key")).alias("key"),
        F.when(hit, F.col("orig")).otherwise(F.col("raw")).alias("raw"), F.when(hit, F.coalesce("record", "match")).otherwise(F.col("match")).alias("match"), F.lit(None).cast("string").alias("orig"),
    )


def set_keys(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """items with the keys of wanted (doc, pos, new_key), where no other item of the document has that key."""
    shown = items.select("doc", F.col("pos").alias("p"), F.coalesce("key", F.nullif(F.regexp_extract("raw", r"^\s*@\s*\w+\s*[{(]\s*([^,\s]+)", 1), F.lit(""))).alias("new_key"))
    free = wanted.where("new_key <> ''").join(shown, (wanted["doc"] == shown["doc"]) & (wanted["new_key"] == shown["new_key"]) & (wanted["pos"] != shown["p"]), "left_anti")
    df = items.join(free, ["doc", "pos"], "left")
    rewritten = arrow(_set_key, "string")("raw", "new_key")
    return df.withColumn("raw", F.when((F.col("kind") == "raw") & F.col("new_key").isNotNull(), rewritten).otherwise(F.col("raw"))).withColumn(
        "key", F.when(F.col("kind") == "record", F.coalesce("new_key", "key")).otherwise(F.col("key"))
    ).drop("new_key")


def _set_key(raw, key):
    return None if raw is None else raw if key is None else set_key(raw, key)


# ---------------------------------------------------------------- display


def people_shown(most: int = 30) -> Column:
    """Authors, else editors marked as such, up to a number of names."""
    none = F.array().cast("array<string>")
    authors, editors = F.coalesce("authors", none), F.coalesce("editors", none)
    people = F.when(F.size(authors) > 0, authors).otherwise(editors)
    more = F.when(F.size(people) > most, F.concat(F.lit(", … ("), F.size(people).cast("string"), F.lit(" in total)"))).otherwise("")
    mark = F.when((F.size(authors) == 0) & (F.size(editors) > 0), " (eds.)").otherwise("")
    return F.concat(F.array_join(F.slice(people, 1, most), ", "), more, mark, F.when(F.size(people) > 0, ":").otherwise(""))


def venue_shown() -> Column:
    """The line about the venue, by type: journal with volume and number, or venue; year, series, pages."""
    text = lambda c, before="", after="": F.coalesce(F.concat(F.lit(before), F.nullif(c, F.lit("")), F.lit(after)), F.lit(""))
    year = text(F.col("year").cast("string"), " ")
    article = F.concat(text(F.col("venue")), text(F.col("volume"), " "), text(F.col("number"), "(", ")"), year)
    series = F.when(F.col("type") == "proceedings", F.coalesce(F.concat(F.lit(" · "), F.col("extra.series"), F.lit(" "), text(F.col("volume"))), F.lit(""))).otherwise("")
    return F.concat(F.when(F.col("type") == "article", article).otherwise(F.concat(text(F.col("venue")), year)), series, text(F.col("pages"), ": "))


def item_line(who: str | None, title: str | None, where: str | None, year: str | None) -> str:
    """One line about an entry of a file: the first three people, its title, venue and year as text."""
    people = [p for p in re.split(r"\s+and\s+", to_display(who)) if p]
    shown = "; ".join(people[:3]) + " et al." * (len(people) > 3) + ": " * bool(people)
    return f"{shown}{to_display(title)} {to_display(where)} {year or ''}".strip()


item_line_udf = arrow(item_line, "string")
