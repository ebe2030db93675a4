"""Rows without an id whose texts have the same tag."""

from __future__ import annotations

import random

from conftest import prose
from pyspark.sql import functions as F

from rowloom.llm import substrings


def test_texts_of_one_tag_keep_their_own_places(spark):
    rng = random.Random(3)
    passage, other = prose(rng, 60), prose(rng, 60)
    salted = lambda text, name: spark.range(1 << 15).select(F.concat(F.lit(f"{text} "), F.col("id")).alias(name)).withColumn(f"{name}_tag", substrings._tag(F.col(name).cast("binary")))
    pair = salted(passage, "a").join(salted(other, "b"), F.col("a_tag") == F.col("b_tag")).first()
    docs = spark.createDataFrame([(None, pair["a"]), (None, pair["b"]), (1, passage)], "doc_id long, text string")
    removed = {r["kept_sha256"]: (r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(docs).collect()}
    words = len(passage.split())
    assert sorted(removed.values()) == sorted([(words, words), (words + 1, words), (len(other.split()) + 1, 0)])
