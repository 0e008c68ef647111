"""License scan by a positional rare-token index, with DataFrame and SQL functions only.

Words that occur in a licence template, other than function words, are looked up in every text with
their positions. A phrase or template occurs at offset o where its words stand at o plus their own
places: the postings of file and template are joined by word and grouped by the difference of their
positions. Short base phrases need all their words. Longer notices are proposed by the word of their
mandatory key phrase that has the highest inverse document frequency (over all files), then verified:
every word of the key phrase and at least MIN_SHARE of all template words must stand in place. No
notice is missed, however many a file holds, as none is verified without that word in place.

Defined results: null and empty texts have no words and no labels; repeated rows each get a result
(rows are told apart by a row number, not by their id); other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Separators of words in a text whose letters are not lower-cased yet.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
MIN_SHARE = 0.6
END = "\x01"

# Base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# Licence notices (label, text, mandatory key phrase).
NOTICES = [
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "free software you can redistribute"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    ("epl-2.0", "eclipse public license v 2 0", "eclipse public license"),
]
# Function words, left out of notices (they leave gaps between the places of other words).
FUNCTION_WORDS = set("a an and any are as be by can for in into is it may met not of on or that the this to under use with without you".split())


def posting_values() -> str:
    """The fixed postings as SQL rows: kind, template, label, word, place, needed (in the key phrase), n_needed, n_all."""
    rows = []
    for t, (kind, label, text, key) in enumerate([("base", y, p, p) for p, y in PHRASES] + [("notice", *x) for x in NOTICES]):
        words, needed = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(needed)] == needed)
        used = [(i, w) for i, w in enumerate(words) if kind == "base" or w not in FUNCTION_WORDS or (len(w) < 3 and "cc" in needed and at <= i < at + len(needed))]
        n_needed = sum(at <= i < at + len(needed) for i, _ in used)
        rows += [f"('{kind}', {t}, '{label}', '{w}', {i}, {int(at <= i < at + len(needed))}, {n_needed}, {len(used)})" for i, w in used]
    return ", ".join(rows)


def _postings(spark) -> DataFrame:
    """A fixed table of a few hundred rows."""
    return spark.sql(f"SELECT * FROM VALUES {posting_values()} AS x(kind, template, label, word, place, needed, n_needed, n_all)")


def _vocabulary() -> list[str]:
    words = {w for p, _ in PHRASES for w in p.split()} | {w for _, text, _ in NOTICES for w in text.split() if w not in FUNCTION_WORDS}
    return sorted(words)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row, id, at, word: the licence words of each text with their places, and an end mark whose place is the number of words."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        F.concat(F.split(text, SEPARATORS + "+"), F.array(F.lit(END))).alias("words"),
        F.when((text == "") | F.substring(text, 1, 1).rlike(SEPARATORS), 1).otherwise(0).alias("lead"),
        F.when((text != "") & F.substring(text, -1, 1).rlike(SEPARATORS), 1).otherwise(0).alias("trail"),
    )
    spread = rows.select("row", "id", "lead", "trail", F.posexplode("words").alias("at", "word"))
    end = F.col("word") == END
    return spread.where(end | F.lower("word").isin(_vocabulary())).select(
        "row", "id", (F.col("at") - F.col("lead") - F.when(end, F.col("trail")).otherwise(0)).cast("long").alias("at"), F.when(end, F.lit(END)).otherwise(_ascii_lower(F.col("word"))).alias("word")
    )


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: n_words, base places and labels, all labels, score (the largest share of a verified template's words in place)."""
    spark = docs.sparkSession
    found = materialise(license_words(docs, id_column, text_column))
    words = found.where(F.col("word") != END)
    postings = F.broadcast(_postings(spark))
    base = (
        words.join(postings.where("kind = 'base'"), "word")
        .groupBy("row", "template", "label", (F.col("at") - F.col("place")).alias("offset"), "n_all")
        .agg(F.count("*").alias("n"))
        .where("n = n_all")
        .groupBy("row")
        .agg(F.count("*").alias("n_base"), F.min("offset").alias("first_word"), F.max("offset").alias("last_word"), F.collect_set("label").alias("base"))
    )
    # Document frequencies over all files; the result has one row a licence word, a fixed number.
    frequency = words.select("row", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    notices = postings.where("kind = 'notice'")
    rarest = (
        notices.where("needed = 1")
        .join(F.broadcast(frequency), "word", "left")
        .groupBy("template")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "place")).alias("rarest"))
        .select("template", "rarest.word", "rarest.place")
    )
    # One place of the template, so each pair of template and offset is proposed once.
    proposed = words.join(F.broadcast(rarest), "word").select("row", "template", (F.col("at") - F.col("place")).alias("offset"))
    verified = (
        proposed.join(notices, "template")
        .withColumn("at", F.col("offset") + F.col("place"))
        .join(words.select("row", "at", "word"), ["row", "at", "word"])
        .groupBy("row", "template", "label", "offset", "n_needed", "n_all")
        .agg(F.count("*").alias("n"), F.sum("needed").alias("needed"))
        .where((F.col("needed") == F.col("n_needed")) & (F.col("n") >= MIN_SHARE * F.col("n_all")))
        .groupBy("row")
        .agg(F.collect_set("label").alias("more"), F.max(F.col("n") / F.col("n_all")).alias("share"))
    )
    none = F.array().cast("array<string>")
    return (
        found.where(F.col("word") == END)
        .select("row", F.col("id").alias(id_column), F.col("at").alias("n_words"))
        .join(base, "row", "left")
        .join(verified, "row", "left")
        .select(
            id_column,
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word",
            "last_word",
            F.array_sort(F.coalesce("base", none)).alias("base_labels"),
            F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("more", none))).alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).cast("double").alias("score"),
        )
    )


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("base_labels", F.concat_ws(",", "base_labels")).withColumn("labels", F.concat_ws(",", "labels"))
