"""Corpus cleaning in stages, each a training-data operator applied to what the stage before kept.

toxicity and language ID drop the documents they reject, near-duplicate removal keeps one document
of each group, decontamination drops documents with a benchmark passage, and the last stage encodes
what is left. All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import langid, toxicity
from parlance.llm.bpe import encode_and_decode
from parlance.llm.common import stored, table
from parlance.llm.decontam import drop_contaminated
from parlance.llm.similar import drop_similar

#: documents in these languages stay, if the weakest duel for their language is not lost
LANGUAGES, LEAST_SCORE = ("de", "en", "es", "fr"), 0.5
#: Jaccard similarity of five-word shingles from which documents are near duplicates
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5.

    Null and empty texts have the score of no terms; repeated rows are judged alike; without labels, or
    documents, nothing is dropped.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_score(F.col("text"), model) < 0.5)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] = LANGUAGES, least: float = LEAST_SCORE) -> DataFrame:
    """Documents that are told to be in one of ``languages`` with a score of ``least`` or more.

    Null texts and texts without letters are in no language and go. If no document tells its language,
    none can be learned, and all texts with letters stay. Repeated rows are judged alike.
    """
    model = langid.train(docs)
    if not model.within:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = langid.guess(F.col("text"), model)
    return docs.where(told["lang"].isin(*languages) & (told["score"] >= least))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles of a similarity of 0.8 or more; candidates by SimHash, each link verified; nulls, repeats and empty tables as in ``similar_documents`` and ``drop_similar``."""
    return drop_similar(docs, SIMILARITY)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null texts have none, an empty benchmark drops nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), 10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left; nulls, repeats and empty tables as in ``encode_and_decode``."""
    import public_tokenizers

    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near duplicates", drop_copies), ("decontamination", drop_leaks), ("encoding", encode)]

#: models and fingerprints are beyond SQL; tests hold run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name.replace(' ', '-')}")
    return docs
