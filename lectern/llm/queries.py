"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, licenses, mixing, simhash, syncmers, topk, toxicity, url_filter, warc
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def vocabulary_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; null and malformed urls have an empty host and path, repeated rows count each."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


#: Fixed value: the conversation that op2 formats beside the table's, whose texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what the examples hold, read back from their formatted texts and masks alone."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    formatted = chat.expand(turns.unionByName(spark.createDataFrame(extra, turns.schema)))

    def run(batches):
        """Rows of a conversation follow each other, its longest example last."""
        state = None

        def row():
            turns, (chars, digest, size, count) = chat.read_turns(state[0]), state[1]
            whole = hashlib.sha256()
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            return [state[2], len(turns), whole.hexdigest(), chars, digest.hexdigest(), size, count]

        for b in batches:
            out = []
            for cid, example, formatted, start, end in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if example == 0:
                    if state is not None:
                        out.append(row())
                    state = ["", [0, hashlib.sha256(), 0, 0], cid]
                reply = chat.unescape(formatted[start:end])
                state[0] = formatted
                state[1][0] += len(reply)
                state[1][1].update(reply.encode())
                state[1][2] += len(formatted)
                state[1][3] += end > start
            if out:
                yield digests(out, b.schema.field(0).type)
            kind = b.schema.field(0).type
        if state is not None:
            yield digests([row()], kind)

    def digests(out, kind):
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    return formatted.mapInArrow(run, schema)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size and how many words the mix takes of it; null texts have size 0, null sources come last."""
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id its links reach; blank texts have fingerprint 0 and are linked like any other."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and both likenesses; null texts count as empty."""
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels that are not held out; texts without a known term have the prior's score."""
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, index)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("evidence").alias("neighbours"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base phrases by place, and the labels of phrases and of chained template spans; null texts have no words."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and digests of its ids and of their decoded bytes; null texts count as empty."""
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, vocabulary_path(), vocabulary_pattern(), with_ids=False, with_digests=True)


def op9_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vec_id divisible by 20; unusable vectors take no part, a repeated query id gives one answer set."""
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    rows = rows.select("vec_id", topk.quantise(F.col("embedding")).alias("embedding"))
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as an archive against a replica with known damage: every 97th record has one byte
    changed, every 101st another payload length, every 1009th is lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    html = F.col("html")
    damaged = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.substring(html, F.lit(2), F.length(html)))).when(
        F.col("page_id") % 101 == 7, F.concat(html, F.lit("#"))
    ).otherwise(html)
    replica = pages.where((F.col("page_id") % 1009 != 11) | F.col("page_id").isNull()).withColumn("html", damaged)
    found = warc.audit(warc.archive(pages), warc.archive(replica))
    return found.withColumnRenamed("record_id", "page_id")


QUERIES = {f.__name__: f for f in (op1_url_templates, op2_chat_examples, op3_mix_sources, op4_simhash, op5_closed_syncmers, op6_toxicity, op7_license_scan, op8_byte_bpe, op9_threshold_top_k, op10_warc_fixity)}
