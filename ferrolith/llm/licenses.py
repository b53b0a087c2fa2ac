"""License scans by diagonal voting.

Every rolling pair of words of every document is joined to the places of that pair in the license
templates; a template longer than four words asks for four equal words at the place, so that pairs
of common words don't vote. A match votes for the diagonal (document place minus template place).
Votes are added by document, template and diagonal; diagonals that lie within ``gap`` words of each
other and follow one another are merged (words put in or left out move the diagonal), until the
template begins again; how many different places of its template a span covers is verified against
the least share. A phrase is a short
template that must be covered whole, on one diagonal, word for word.

Templates are a fixed, small table and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrolith.llm._common import NOT_WORD, cut, with_words

#: Phrase and label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Label and public license notice (the licenses' own wording).
NOTICES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement'),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("wtfpl", "Do what the fuck you want to public license"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]
GRAM = 4
GAP = 8
LEAST = 0.7


def template_places(spark: SparkSession, phrases: list = PHRASES, notices: list = NOTICES, gram: int = GRAM) -> DataFrame:
    """(template, label, base, k, n_grams, place, w array, h): every k-gram of every template; h hashes its first two words."""
    rows = [(i, label, text, True) for i, (text, label) in enumerate(phrases)] + [(len(phrases) + i, label, text, False) for i, (label, text) in enumerate(notices)]
    table = with_words(spark.createDataFrame(rows, "template int, label string, text string, base boolean"), F.col("text"), "words", NOT_WORD, lower=True)
    table = table.withColumn("k", F.when(F.col("base"), 2).otherwise(gram)).withColumn("n_grams", F.size("words") - F.col("k") + 1)
    place = table.select("template", "label", "base", "k", "n_grams", "words", F.explode(F.sequence(F.lit(0), F.col("n_grams") - 1)).alias("place"))
    w = F.slice("words", F.col("place") + 1, F.col("k"))
    return place.select("template", "label", "base", "k", "n_grams", "place", w.alias("w")).withColumn("h", F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1))))


def scan(documents: DataFrame, phrases: list = PHRASES, notices: list = NOTICES, gap: int = GAP, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(spans, rows).

    spans: (doc_id, text_hash, n_words, template, label, base, start, end, coverage), words [start,
    end) of the document; rows: (doc_id, text_hash, n_words, copies) of every document. Null texts
    have no words; rows that repeat id and text are one key.
    """
    places = template_places(documents.sparkSession, phrases, notices)
    docs = with_words(documents.select("doc_id", "text"), F.col("text"), "words", NOT_WORD, lower=True)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size("words").alias("n_words"), "words")
    at = docs.select("doc_id", "text_hash", "n_words", "words", F.posexplode_outer("words").alias("at", "word")).withColumn("at", F.coalesce("at", F.lit(0)))
    at = at.select("doc_id", "text_hash", "n_words", "words", "at", F.xxhash64(F.get("words", F.col("at")), F.get("words", F.col("at") + 1)).alias("h"))
    same = F.col("w").isNotNull() & (F.slice("words", F.col("at") + 1, F.greatest(F.coalesce("k", F.lit(1)), F.lit(1))) == F.col("w"))
    met = at.join(F.broadcast(places), "h", "left").withColumn("same", F.coalesce(same, F.lit(False))).where("same or at = 0")
    # the first place of a document may meet several templates, so rows are told apart by the least of them
    marks = met.select("doc_id", "text_hash", "n_words", "at", "same", "template", "label", "base", "k", "n_grams", "place")
    kept = cut(marks)
    key = ["doc_id", "text_hash", "n_words"]
    votes = kept.where("same").groupBy(*key, "template", "label", "base", "k", "n_grams", (F.col("at") - F.col("place")).alias("diagonal"))
    votes = votes.agg(F.array_sort(F.collect_set("place")).alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))  # at most n_grams places
    whole = votes.where("base and size(places) = n_grams").select(*key, "template", "label", "base", F.col("diagonal").alias("start"), (F.col("last") + F.col("k")).alias("end"), F.lit(1.0).alias("coverage"))
    run = Window.partitionBy(*key, "template").orderBy("first", "diagonal")
    near = votes.where("not base").withColumn("before", F.lag("last").over(run)).withColumn("moved", F.abs(F.col("diagonal") - F.lag("diagonal").over(run)))
    near = near.withColumn("back", F.element_at("places", 1) <= F.lag(F.element_at("places", -1)).over(run) - F.col("k"))  # the template begins again
    near = near.withColumn("fresh", F.coalesce(((F.col("first") - F.col("before") > gap + F.col("k")) | (F.col("moved") > gap) | F.col("back")).cast("int"), F.lit(1))).withColumn("group", F.sum("fresh").over(run))
    merged = near.groupBy(*key, "template", "label", "base", "group").agg(F.min("first").alias("start"), (F.max("last") + F.first("k")).alias("end"), (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.first("n_grams")).alias("coverage"))
    return whole.unionByName(merged.where(F.col("coverage") >= least).drop("group")), kept


def report(documents: DataFrame, **how) -> DataFrame:
    """One row for each document row: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``score`` is the largest share of a template that a span covers, 0 without spans.
    """
    spans, kept = scan(documents, **how)
    key = ["doc_id", "text_hash", "n_words"]
    # a row's first place is there once for each template place it met, or once: its least (template, place) stands for the row
    first = kept.where("at = 0").withColumn("met", F.struct("template", "place"))
    rows = first.groupBy(*key, "met").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("copies"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(*key).agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("coverage").alias("score"), F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"),
    )
    same = F.expr("r.doc_id <=> s.doc_id and r.text_hash = s.text_hash and r.n_words = s.n_words")
    out = rows.alias("r").join(found.alias("s"), same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "r.doc_id", F.col("r.n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
