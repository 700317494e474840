"""License notices in texts, by MinHash bands over overlapping windows and exact containment.

Words are runs of letters and digits in lower case; shingles are three words. A text's shingle hashes are
cut into blocks of 8. A band is one hash order (the hash, XOR a mask) and holds the smallest value of a
block. A window is a run of blocks that starts every ``stride`` shingles and holds twice as many, so any
notice of at most ``stride`` + 1 shingles lies in one; strides double until the longest notice fits. A
window's band value is the least of its blocks. Where it equals a notice's value, the notice is a candidate
there. The number of bands is chosen so that a window holding the threshold's share of a notice's shingles
shares a band with it with probability ``sure`` at least, for the notice with the worst ratio to its window.
Candidates are verified by the exact share of the notice's shingles in the window.

All steps are built-in functions. The notices' band values are a fixed set (notices times bands), checked
while scanning, so only texts with a hit go on. Null, empty and short texts hold no notice. Repeated rows are
found again. Rows without id are reported with a null id. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.session import written_table

# Wording of common license notices.
NOTICES = {
    "mit-line": "Released under the MIT License.",
    "apache-2-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4-line": "Licensed under CC BY-NC 4.0.",
    "apache-2-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-sa-4-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

WORD = r"([\p{L}\p{N}]+)"
BLOCK = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def _hashes(words: Column) -> Column:
    shingle = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), shingle)).otherwise(F.array().cast("array<bigint>"))


def _masks(bands: int) -> Column:
    return F.array(*(F.xxhash64(F.lit(i)) for i in range(bands)))


def _least(hashes: Column, masks: Column) -> Column:
    """The band values of some shingles: per mask the smallest of hash XOR mask."""
    return F.transform(masks, lambda m: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(m))))


def bands_for(sizes: list[int], contained: float, sure: float) -> int:
    """Bands that miss a window with the threshold's share of a notice with probability 1 - sure at most."""
    worst = 1.0
    for size in sizes:
        shared = math.ceil(contained * size - 1e-9)
        worst = min(worst, shared / (2 * stride_of(size) + size - shared))
    return math.ceil(math.log(1 - sure) / math.log(1 - worst))


def stride_of(size: int) -> int:
    """Window stride for a notice of so many shingles; its windows hold twice as many."""
    stride = BLOCK
    while size > stride + 1:
        stride *= 2
    return stride


def _notices(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("notice"), F.lit(v).alias("wording")) for k, v in notices.items())))
    shingles = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    table = spark.range(1).select(rows.alias("x")).select("x.*").withColumn("w", words_of(F.col("wording"))).where(F.size("w") >= 3)
    return table.withColumn("shingles", F.array_distinct(shingles)).withColumn("hashes", _hashes(F.col("w")))


def find_notices(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None, contained: float = 0.8, sure: float = 0.999
) -> DataFrame:
    """doc_id, notice, contained (its best share of the notice's shingles) and first_word (of the first window that holds it)."""
    spark = docs.sparkSession
    known = _notices(spark, notices or NOTICES)
    sizes = {r.notice: r.n for r in known.select("notice", F.size("shingles").alias("n")).collect()}
    bands = bands_for(list(sizes.values()), contained, sure)
    values = known.select("notice", "shingles", _least(F.col("hashes"), _masks(bands)).alias("values"))
    stride = F.lit(BLOCK)
    for n in sorted(set(sizes.values())):
        if stride_of(n) > BLOCK:
            stride = F.when(F.size("shingles") >= n, F.lit(stride_of(n))).otherwise(stride)
    table = values.select("notice", "shingles", stride.alias("stride"), F.posexplode("values").alias("band", "value"))
    # Notices times bands rows.
    keys = [r.value for r in table.select("value").distinct().collect()]
    w, h, blocks = F.col("w"), F.col("h"), F.col("blocks")
    block = lambda b: _let(F.slice(h, b * BLOCK + 1, F.lit(BLOCK)), lambda s: _least(s, _masks(bands)))
    last = F.ceil(F.size("h") / BLOCK).cast("int") - 1
    hit = lambda i: F.exists(F.get(blocks, i), lambda v: v.isin(keys))
    scanned = (
        docs.select(F.col(id_column).cast("long").alias("doc_id"), words_of(F.col(text)).alias("w"))
        .withColumn("h", _hashes(w))
        .withColumn("blocks", F.when(F.size("h") > 0, F.transform(F.sequence(F.lit(0), last), block)))
        .withColumn("hits", F.filter(F.sequence(F.lit(0), F.size("blocks") - 1), hit))
    )
    # Written before any filter on it, which Spark would move down and so compute the values again and again.
    any_hit = F.size("hits") > 0
    scanned = written_table(scanned.select("doc_id", *(F.when(any_hit, F.col(c)).alias(c) for c in ("hits", "w", "blocks"))), "license-hits")
    # Only texts with a hit get here.
    met = scanned.where("hits IS NOT NULL").select("doc_id", "w", "blocks", F.explode("hits").alias("block")).select(
        "doc_id", "w", "blocks", "block", F.explode(F.array_distinct(F.filter(F.get(blocks, F.col("block")), lambda v: v.isin(keys)))).alias("value")
    )
    met = met.join(F.broadcast(table), "value")
    around = F.floor(F.col("block") * BLOCK / F.col("stride")).cast("int")
    windows = met.withColumn("window", F.explode(F.when(around > 0, F.array(around - 1, around)).otherwise(F.array(around))))
    inside = F.slice(blocks, F.col("window") * (F.col("stride") / BLOCK).cast("int") + 1, (2 * F.col("stride") / BLOCK).cast("int"))
    at_least = F.array_min(F.transform(inside, lambda b: F.get(b, F.col("band"))))
    start = F.col("window") * F.col("stride")
    upto = F.least(start + 2 * F.col("stride"), F.size("w") - 2) - 1
    held = F.transform(F.sequence(start, upto), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    share = F.size(F.array_intersect("shingles", held)) / F.size("shingles")
    return (
        windows.where(at_least == F.col("value"))
        .select("doc_id", "notice", start.alias("start"), share.alias("share"))
        .where(F.col("share") >= contained)
        .groupBy("doc_id", "notice")
        .agg(F.max("share").alias("contained"), F.min("start").cast("long").alias("first_word"))
    )
