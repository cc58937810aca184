"""From raw documents to packed training sequences, in five stages over the operators of vertexloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.common import cut, may_hold, narrowed, sweep, swept, table
from vertexloom.llm.jaccard import jaccard_components
from vertexloom.llm.langid import UNBOUNDED, UNKNOWN, learned, left_out_rates, predictor, quantile
from vertexloom.llm.mixing import mix
from vertexloom.llm.packing import pack_query
from vertexloom.llm.queries import tokenizer
from vertexloom.llm.toxicity import learn, scorer

#: Scores from here on are toxic.
TOXIC = 0.5
#: A text is of a learned language if a character costs at most SPREAD times what it costs in the share USUAL of all labelled
#: texts of LONG characters or more, each by what the rows of the other of FOLDS say. FREE bits aren't counted: short texts vary.
#: LEFT_OUT: for picked(), which the tests compare with.
SPREAD, USUAL, LEFT_OUT, LONG, FREE, FOLDS = 1.6, 0.99, 64, 200, 128, 2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; rows without a text stay."""
    docs = swept(narrowed(docs))
    return docs.where(scorer(learn(docs, table(spark, sf_dir, "labels")))(F.col("text")) < TOXIC)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts and texts without a letter go, and so does what no language parses."""
    docs = swept(narrowed(docs))
    models = learned(docs, folds=FOLDS)
    sweep(spark)
    p = predictor(models[0], UNBOUNDED)
    usual = quantile(left_out_rates(docs.where(F.char_length("text") >= LONG), models[1:]).select("rate"), USUAL)
    most = float("inf") if usual is None else SPREAD * usual  # without such texts there is no bound
    sweep(spark)
    found = p(F.col("text"))
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["rate"] <= F.lit(most) + F.lit(float(FREE)) / F.char_length("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id; of rows that repeat an id one. Null ids stay.

    Only documents that may go are shuffled: the others are told by a bounded bit table of the ids that go.
    """
    docs = swept(narrowed(docs))
    found = cut(jaccard_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count("*").alias("rows")), "found")
    sweep(spark)
    gone = found.where("low < doc_id").select("doc_id")
    repeated = found.where("low = doc_id and rows > 1").select("doc_id")
    d = may_hold(docs, gone.unionByName(repeated))
    once = d.where("not may").select("row.*")
    checked = d.where("may").select("row.*").join(gone, "doc_id", "left_anti").select(docs.columns)
    null_ids = checked.where("doc_id is null")
    return once.unionByName(null_ids).unionByName(checked.where("doc_id is not null").dropDuplicates(["doc_id"]))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    docs = swept(narrowed(docs))
    d = mix(docs).where("mix.copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int"))))
    return d.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    docs = swept(narrowed(docs))
    return pack_query(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("language_id", language), ("ngram_jaccard_join", near_duplicates), ("mix_sources", mixing), ("best_fit_packing", packing)]

#: Trained classifiers and tokenizers have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
