"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib.util

from tidemark.llm import bpe, decontaminate, extract, jaccard, licenses, lines, media, ngrams, shards, toxicity
from tidemark.llm.common import table


def byte_bpe_path() -> str:
    """The public byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op2_lm(spark, sf_dir):
    return ngrams.score(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_shards(spark, sf_dir):
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op6_bpe(spark, sf_dir):
    return bpe.digest_documents(table(spark, sf_dir, "documents"), byte_bpe_path())


def op7_lines(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"), shortest=1)


def op8_extract(spark, sf_dir):
    return extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_media(spark, sf_dir):
    """Copies among the lead pictures of all pages; the tables hold no pictures, so they are drawn."""
    return media.copies(media.page_pictures(table(spark, sf_dir, "pages")), "page_id")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_lm": op2_lm,
    "op3_license_scan": op3_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_shards": op5_shards,
    "op6_bpe": op6_bpe,
    "op7_lines": op7_lines,
    "op8_extract": op8_extract,
    "op9_toxicity": op9_toxicity,
    "op10_media": op10_media,
}
if importlib.util.find_spec("corpus_pipeline"):
    QUERIES["pipeline"] = pipeline

ORACLES: dict[str, str] = {"op3_license_scan": licenses.scan_sql()}
