"""Ranked search: every word of a query is the beginning of some word of a text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def marked(base: str) -> str:
    """Latin letters that are this one with marks, by Unicode's canonical decompositions."""
    return "".join(chr(c) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0] == base)


MARKED = {base: marked(base) for base in "abcdefghijklmnopqrstuvwxyz"}
K1, B = 1.2, 0.75


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), "".join(MARKED.values()), "".join(b * len(v) for b, v in MARKED.items()))


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.replace(w, F.lit("ß"), F.lit("ss")))


def beginning(word: str):
    return lambda w: F.startswith(w, F.lit(word))


def ranked(rows: DataFrame, key: str, query: str, text: str = "text") -> DataFrame:
    """rows that match all of the query's words, with score (smaller is better): a bm25 of the words' beginnings.

    One pass counts the matches of each query word in each text; two sums over all
    rows (matching texts of each word, words a text) make the weights.
    """
    asked = list(dict.fromkeys(query.lower().split()))
    own = rows.withColumn("_words", words(F.col(text))).withColumn("_size", F.size("_words"))
    for i, word in enumerate(asked):
        own = own.withColumn(f"_tf{i}", F.size(F.filter("_words", beginning(word))))
    own = own.drop("_words")
    counts = own.agg(F.count("*").alias("_n"), F.avg("_size").alias("_mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(asked))])
    found = own.where(" and ".join(f"_tf{i} > 0" for i in range(len(asked))) or "false").join(F.broadcast(counts))  # one row
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)))
        score = score - idf * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + K1 * (1 - B + B * F.col("_size") / F.col("_mean")))
    return found.withColumn("score", score).select(*rows.columns, "score")


def best_version(revisions: DataFrame, query: str) -> DataFrame:
    """One hit an article (article_key, id, title): the current wording if it matches, else the best one; score: the article's best."""
    current = F.max("id").over(Window.partitionBy("article_key")) == F.col("id")
    hits = ranked(revisions.select("article_key", "id", F.col("title").alias("text"), current.alias("current")), "id", query)
    whole = Window.partitionBy("article_key")
    order = whole.orderBy(F.desc("current"), F.round("score", 9), "id")
    hits = hits.withColumn("_k", F.row_number().over(order)).withColumn("_best", F.min("score").over(whole)).where("_k = 1")
    return hits.select("article_key", "id", F.col("_best").alias("score"), F.when(~F.col("current"), F.col("text")).alias("matched_title"))
