"""License scans by voting on diagonals.

All runs of three words of all texts are hashed and joined in Spark with the places of such runs in templates. A hit votes for
the diagonal on which text and template would lie side by side. Each diagonal is merged with those at most LEAP words beside it,
as after words were put in or left out; a run of the template counts once, however often a text says it. A merged span is
verified word by word: enough of the template's words must stand in the text within LEAP words of their place. A base phrase
counts only where all its runs lie on one diagonal, side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import Words, grams, slices, texts_of, with_row_key

# Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Templates of the method's own labels: well-known notices.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words of a run.
K = 3
#: Diagonals to each side that are merged, and the shares of the template's runs and of its words that a span must have.
LEAP = 4
COVER = 0.6
WORDS = 0.7
#: Runs that a template may have: which were found are the bits of one number.
MOST_RUNS = 60

_BYTE = np.arange(256)
#: Bytes that are in no word, once A-Z are lower case.
BLANK = ~(((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80))

#: Stands for a document itself among the runs, so that documents without hits stay.
DOCUMENT = -(1 << 63)


def template_places(spark: SparkSession) -> DataFrame:
    """gram, template, at, runs, base, label: a few hundred rows that depend on no input, small enough to broadcast."""
    rows = [(DOCUMENT, -1, 0, 1, False, "")]
    for n, (text, label) in enumerate((*PHRASES, *TEMPLATES)):
        words = Words([text.encode()], BLANK)
        runs = grams(words.hashes(), K)[: len(words.starts) - K + 1].view(np.int64).tolist()
        if len(runs) > MOST_RUNS:
            raise ValueError(f"template {n} has {len(runs)} runs, more than {MOST_RUNS}")
        rows += [(g, n, at, len(runs), n < len(PHRASES), label) for at, g in enumerate(runs)]
    return spark.createDataFrame(rows, "gram bigint, template int, at bigint, runs int, base boolean, label string")


def runs_of_words(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, pos, gram: the runs of each text, and for each row of `docs` one with DOCUMENT and its number of words.

    That row alone has the doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words([t.lower() for t in texts_of(part, "text")], BLANK)
                keys = part.column("row_key").to_numpy()
                at = np.flatnonzero(words.left() >= K)
                of = np.repeat(np.arange(len(keys)), words.counts)[at]
                names = part.column("doc_id")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([keys, keys[of]])), pa.concat_arrays([names, pa.nulls(len(at), names.type)]),
                    pa.array(np.concatenate([words.counts, at - words.first[of]])),
                    pa.array(np.concatenate([np.full(len(keys), DOCUMENT), grams(words.hashes(), K)[at].view(np.int64)])),
                ], ["row_key", "doc_id", "pos", "gram"])

    return docs.select("row_key", "doc_id", "text").mapInArrow(run, "row_key bigint, doc_id bigint, pos bigint, gram bigint")


def spans(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, label, base, start, stop, cover of each span, in words, and for each row of `docs` one with label ''.

    That row has the doc_id, and as `stop` the number of words. docs: row_key, doc_id and text. After the join, rows of a document meet once, and all
    later steps are within a document.
    """
    places = F.broadcast(template_places(docs.sparkSession))
    hits = runs_of_words(docs).join(places, "gram").drop("gram").repartition("row_key")
    bit = F.expr("shiftleft(1L, CAST(at AS INT))")
    diagonals = hits.groupBy("row_key", "template", "label", "base", "runs", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.max("doc_id").alias("doc_id"), F.bit_or(bit).alias("own"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    # a base phrase and a document are spans of their own; all else is merged with its neighbours
    alone = F.col("base") | (F.col("template") < 0)
    beside = Window.partitionBy("row_key", "template").orderBy("diagonal").rangeBetween(-LEAP, LEAP)
    merged = diagonals.withColumns({
        "found": F.when(alone, F.col("own")).otherwise(F.bit_or("own").over(beside)),
        "start": F.when(alone, F.col("first")).otherwise(F.min("first").over(beside)),
        "end": F.when(alone, F.col("last")).otherwise(F.max("last").over(beside)),
    })
    covered = F.col("found")
    for j in range(1, K):
        covered = covered.bitwiseOR(F.shiftleft("found", j))
    merged = merged.withColumns({
        "cover": F.bit_count("found") / F.col("runs"), "words": F.bit_count(covered) / (F.col("runs") + K - 1),
    })
    good = F.when(alone, F.col("cover") >= 1).otherwise((F.col("cover") >= COVER) & (F.col("words") >= WORDS))
    # of neighbours that are good, the best one stands for the place; of equals the first
    rank = F.struct(good.alias("good"), "cover", "words", F.bit_count("own").alias("votes"), (-F.col("diagonal")).alias("back"))
    best = merged.withColumn("best", alone | (rank == F.max(rank).over(beside)))
    stop = F.when(F.col("template") < 0, F.col("end")).otherwise(F.col("end") + K)
    return best.filter(good & F.col("best")).select("row_key", "doc_id", "label", "base", "start", stop.alias("stop"), "cover")


def _joined(labels: Column) -> Column:
    return F.concat_ws(",", F.array_sort(labels))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of `docs`.

    Null and empty texts have no words and no labels; score is the best span's share of its template, or 0. Repeated rows are
    rows of their own; other columns are not read; an empty table gives an empty result. Of the texts only hits are moved.
    """
    keyed = with_row_key(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), "text"])
    base, other = F.col("base"), F.col("label") != ""
    return spans(keyed).groupBy("row_key").agg(
        F.max("doc_id").alias("doc_id"), F.max(F.when(~other, F.col("stop"))).alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        _joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), _joined(F.collect_set(F.when(other, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(other, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).drop("row_key")
