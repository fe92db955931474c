"""License scans by diagonal voting, in DataFrame operations only.

Every rolling pair of words of every text is hashed and joined with the pairs
of the templates.  A match at word p of the text and word t of the template
votes for the diagonal p - t of (row, template).  Diagonals at most ``slack``
apart are merged, so that a few inserted or missing words don't break a match,
and the spans are verified: equal word pairs, the share of the template's pairs
that a merged diagonal holds, and its last two pairs, which tell versions apart.
Templates of three pairs or more may always lack one, so that one inserted word
doesn't hide a short one.

The templates are a parameter of fixed size; they are broadcast only while
they have at most ``MAX_PAIRS`` pairs.  They are folded as texts are; one of
less than two words has no pair and is an error.

Cases.  Null and empty text has no words.  Rows are told apart by doc_id and a
hash of the text, and equal rows come back as often as they are there.  A very
long text has all its pairs, one row each; those that meet no template end at
the join.  An empty table gives no rows.  Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._store import spread

# Phrases that give the base labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Longer texts whose near matches give labels of the method's own.
TEMPLATES = {
    "released under the mit license": "mit-notice",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "all rights reserved": "all-rights-reserved",
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_PAIRS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The pair of the row that stands for a text itself; no word holds a blank.
OWN = " "


def words_of(phrase: str) -> list[str]:
    """The words of a template, folded as those of texts."""
    found = re.findall(WORD, phrase.translate(str.maketrans(UPPER, LOWER)))
    if len(found) < 2:
        raise ValueError(f"template {phrase!r} has no pair of words")
    return found


def needed(pairs: int, least: float) -> int:
    """How many of a template's pairs a match must have."""
    return pairs if pairs < 3 else min(math.ceil(least * pairs), pairs - 1)


def _pair_table(spark, base: Mapping[str, str], templates: Mapping[str, str], least: float) -> DataFrame:
    rows = [(OWN, -1, 0, 0, 0, "", False)]
    for number, (phrase, label, is_base) in enumerate([(p, v, True) for p, v in base.items()] + [(p, v, False) for p, v in templates.items()]):
        words = words_of(phrase)
        rows += [(f"{a} {b}", number, i, len(words) - 1, len(words) - 1 if is_base else needed(len(words) - 1, least), label, is_base) for i, (a, b) in enumerate(zip(words, words[1:]))]
    if len(rows) > MAX_PAIRS:
        raise ValueError(f"{len(rows)} word pairs in the templates; at most {MAX_PAIRS} can be broadcast")
    table = spark.createDataFrame(rows, "t_pair string, template int, t_pos int, n_pairs int, needed int, label string, is_base boolean")
    return table.withColumn("t_hash", F.xxhash64("t_pair"))


def scan_licenses(docs: DataFrame, base: Mapping[str, str] = BASE, templates: Mapping[str, str] = TEMPLATES, slack: int = 2, least: float = 0.85) -> DataFrame:
    """One row for each document.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    and ``spans``: (label, first word, last word, coverage) of what was found.
    """
    pairs = _pair_table(docs.sparkSession, base, templates, least)
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    words = spread(docs).select("doc_id", F.xxhash64("text").alias("row"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    # Word i with its successor; the last pair lacks one and can't match. The text's own row comes last.
    rolled = F.transform("words", lambda w, i: F.concat(w, F.lit(" "), F.coalesce(F.try_element_at(F.col("words"), i + 2), F.lit(""))))
    placed = words.select("doc_id", "row", F.posexplode(F.concat(rolled, F.array(F.lit(OWN)))).alias("pos", "pair"))
    hit = placed.join(F.broadcast(pairs), (F.xxhash64("pair") == F.col("t_hash")) & (F.col("pair") == F.col("t_pair")))
    diagonal = F.when(F.col("template") < 0, F.col("pos")).otherwise(F.col("pos") - F.col("t_pos"))
    votes = hit.groupBy("doc_id", "row", "template", diagonal.alias("diagonal")).agg(
        F.collect_set("t_pos").alias("seen"), F.min("pos").alias("low"), F.max("pos").alias("high"),
        F.max("n_pairs").alias("n_pairs"), F.max("needed").alias("needed"), F.max("label").alias("label"), F.max("is_base").alias("is_base"),
        F.count_if(F.col("template") < 0).alias("copies"),
    )
    along = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    opens = F.col("is_base") | F.lag("diagonal").over(along).isNull() | (F.col("diagonal") - F.lag("diagonal").over(along) > slack)
    merged = (
        votes.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(along))
        .groupBy("doc_id", "row", "template", "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("start"),
            F.max("n_pairs").alias("n_pairs"), F.max("needed").alias("needed"), F.max("label").alias("label"), F.max("is_base").alias("is_base"), F.max("copies").alias("copies"),
        )
        .withColumn("coverage", F.when(F.col("template") < 0, 0.0).otherwise(F.size("seen") / F.greatest("n_pairs", F.lit(1))))
    )
    ends = F.array_contains("seen", F.col("n_pairs") - 1) & F.array_contains("seen", F.greatest(F.col("n_pairs") - 2, F.lit(0)))
    found = (F.col("template") >= 0) & (F.size("seen") >= F.col("needed")) & ends
    is_place = found & F.col("is_base")
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit(""))
    texts = merged.groupBy("doc_id", "row").agg(
        F.max(F.when(F.col("template") < 0, F.col("start"))).cast("long").alias("n_words"),
        F.count_if(is_place).cast("long").alias("n_base"),
        F.min(F.when(is_place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_place, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(is_place, F.col("label"))).alias("base_labels"),
        joined(F.when(found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found, F.struct("label", F.col("low").alias("first"), (F.col("high") + 1).alias("last"), "coverage")))).alias("spans"),
        F.max("copies").cast("int").alias("copies"),
    )
    return texts.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("row", "copies")
