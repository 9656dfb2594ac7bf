"""From documents to token ids: the stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import private, quoted, stored
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.language_id import fit_language_model, predict_language
from tidemark.llm.mixing import emitted, mix
from tidemark.llm.ngram_join import one_of_each
from tidemark.llm.token_output import token_output


def set_aside(docs: DataFrame, results: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns renamed that an operator's results would replace, in any case, and what gives their names and docs' order back."""
    clashing = [c for c in docs.columns if c.lower() in results]
    names = dict(zip(clashing, private(docs, *(f"aside_{c}" for c in clashing)), strict=True))
    return docs.withColumnsRenamed(names), lambda out: out.select(*[quoted(names.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not those without text (null or empty) or letters, nor those between two languages.

    The model learns from this stage's own documents that have a language; if none has, every document goes. Rows stand alone, so
    repeated ones go or stay together; no rows give none. Very long texts are read whole. Of equally near languages neither counts: the
    document is between two.
    """
    docs, back = set_aside(docs, ["lang_pred", "score", "ambiguous"])
    return back(predict_language(docs, fit_language_model(docs)).filter((F.col("lang_pred") != "und") & ~F.col("ambiguous")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles: the smallest doc_id, a null one before all others.

    Texts without words (null, empty, white space) all stay; of rows equal in all columns one stays; no rows give none. Of
    different rows that share the smallest doc_id one stays. A very long text is a block of its own.
    """
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item, or all words of a shorter item.

    Texts without words (null, empty) stay; an empty benchmark removes nothing; rows stand alone; no rows give none.
    Very long texts are searched whole; nothing is ranked, so there are no ties.
    """
    docs, back = set_aside(docs, ["n_words", "hit_spans", "hit_items"])
    return back(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("hit_spans") == 0))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times, shuffled within its shards.

    Rows equal in doc_id and text are taken equally often, but for a last few; a null source is one of its own, the last; texts without
    words (null, empty) are taken with their block; no rows give none. A very long text is taken whole or not at all.
    """
    docs, back = set_aside(docs, ["size", "source_size", "target", "takes", "shard", "place"])
    return back(emitted(mix(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, written and read back: where each document's ids start, how many they are, their checksum.

    Null and empty texts have the end id alone; repeated rows are each written; a null doc_id comes first; no rows give none; other
    columns are not read. A very long text is one document of one block.
    """
    import public_tokenizers

    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark),
    ("mixing", mixture),
    ("token_output", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
