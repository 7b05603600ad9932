"""The queries of the training-data operators: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.llm import (
    anchors,
    blocks,
    decontaminate,
    jaccard,
    licenses,
    lm,
    packing,
    shards,
    spelling,
    toolcalls,
    toxicity,
    warc,
    whitening,
)
from arealis.sources import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: a toxic text is often of low quality; the chain learns how much that says
CATEGORIES = ("low_quality", "toxic")

#: the one tool of the conversations: an assistant that answers a prompt
SCHEMAS = {
    "answer": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    """The public byte-level vocabulary of 50,257 tokens; any path can be given to the operator instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def category_labels(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


@query
def op1_deleted_interpolation(spark, root):
    """Every text scored by a model of those whose crc32(doc_id) mod 7 is not 2."""
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return lm.score_corpus(load(spark, root, "documents"), train)


@query
def op2_block_naming(spark, root):
    return blocks.exact_duplicates(load(spark, root, "documents")).drop("row_id")


@query
def op3_warc_normaliser(spark, root):
    """Monolithic archives of all pages, normalised, and read back by their index."""
    archives, index = warc.normalise(warc.write_monolithic(load(spark, root, "pages")))
    records = warc.read_records(archives, index, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_hierarchical_packing(spark, root):
    return packing.pack_documents(load(spark, root, "documents"), tokenizer_path())


@query
def op5_toxicity_chain(spark, root):
    docs = load(spark, root, "documents")
    chain = toxicity.fit_chain(docs, category_labels(spark, root), CATEGORIES)
    scored = toxicity.score_toxicity(docs, chain)
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") > 0.5).alias("toxic"))


@query
def op6_benchmark_leaks(spark, root):
    return decontaminate.leak_report(load(spark, root, "documents"), load(spark, root, "benchmark"))


@query
def op7_token_group_join(spark, root):
    return jaccard.similar_documents(load(spark, root, "documents"))


@query
def op8_two_pass_shuffle(spark, root):
    return shards.shard_report(load(spark, root, "documents"))


@query
def op9_sentence_rules(spark, root):
    return licenses.licence_report(load(spark, root, "documents"))


@query
def op10_tool_calls(spark, root):
    """Each user turn is a call of the assistant, the turn after it the result, and it builds on the user turn before."""
    turns = load(spark, root, "conversations")
    key = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    calls = turns.where("role = 'user'").select(
        "conv_id",
        key(F.col("turn")).alias("call_id"),
        F.col("turn").alias("position"),
        F.lit("answer").alias("tool"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.array(key(F.col("turn") - 2)).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", key(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content")
    )
    return toolcalls.link_tool_calls(calls, results, SCHEMAS)


@query
def op11_difference_cover_anchors(spark, root):
    return anchors.remove_repeats(load(spark, root, "documents"))


@query
def op12_spelling_variants(spark, root):
    return spelling.spelling_variants(load(spark, root, "documents"))


@query
def op13_chebyshev_whitening(spark, root):
    return whitening.whitening_report(load(spark, root, "embeddings"))


@query
def pipeline(spark, root):
    """All stages of ``corpus_pipeline`` over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, root)
