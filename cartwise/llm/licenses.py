"""License scan by diagonal voting against license templates.

All rolling word 3-grams of a text are hashed and joined to the template positions
with the same hash; the words at each hit are then compared, so an accident of hashes
votes for nothing. A hit votes for its diagonal (document position less template position);
neighbouring diagonals, a few words inserted or left out apart, merge into one band. A
band counts when the template words that it verified cover enough of the template, or, of
a long one, make a long enough passage. Base phrases are templates too: they stand where
one exact diagonal holds all their 3-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.llm.common import ascii_lower, row_key, small, texts
from cartwise.session import stage

K = 3
#: Everything that is not a word character.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases and labels of the base.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Texts and notices of public licenses, in lower-cased words; a band over one of
#: them gives its label.
TEMPLATES = [
    ("mit",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the software the software is "
     "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
     "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
     "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
     "arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction"),
    ("mit", "released under the terms of the mit license see the license file for details"),
    ("isc",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies the software is provided as "
     "is and the author disclaims all warranties with regard to this software including all implied warranties of "
     "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
     "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
     "negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met redistributions of source code must retain the above copyright notice this list of "
     "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this "
     "list of conditions and the following disclaimer in the documentation and or other materials provided with the "
     "distribution this software is provided by the copyright holders and contributors as is and any express or implied "
     "warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
     "purpose are disclaimed"),
    ("bsd",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met"),
    ("zlib",
     "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
     "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
     "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
     "restrictions"),
    ("unlicense",
     "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
     "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
     "commercial or non commercial and by any means"),
    ("apache-2",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable "
     "law or agreed to in writing software distributed under the license is distributed on an as is basis without "
     "warranties or conditions of any kind either express or implied see the license for the specific language governing "
     "permissions and limitations under the license"),
    ("apache-2",
     "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation"),
    ("gpl",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later "
     "version this program is distributed in the hope that it will be useful but without any warranty without even the "
     "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more "
     "details"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "copyright all rights reserved no part of this publication may be reproduced"),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, label, base, tpos, t_words, said): fixed, one row per template word."""
    rows = [(i, label, base, text.split(" "))
            for i, (label, text, base) in enumerate([(la, t, True) for t, la in BASE]
                                                    + [(la, t, False) for la, t in TEMPLATES])]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, w array<string>")
    return (t.withColumn("tpos", F.explode(F.sequence(F.lit(0), F.size("w") - K)))
            .select(_gram("tpos").alias("gram"), "template", "label", "base", "tpos",
                    F.size("w").alias("t_words"), F.slice("w", F.col("tpos") + 1, K).alias("said")))


def _gram(at: str) -> Column:
    return F.xxhash64(*[F.col("w")[F.col(at) + i] for i in range(K)])


def _verified_hits(w: DataFrame, grams: DataFrame) -> DataFrame:
    """(row key, template, label, base, t_words, diagonal, tpos) of the 3-grams that stand word for
    word at a template position; ``grams`` (row key, pos, gram)."""
    hits = stage(grams.join(F.broadcast(template_grams(w.sparkSession)), "gram")  # of fixed size
                 .select("_id", "_th", "template", "label", "base", "t_words", "pos", "tpos", "said"), "op7-hits")
    # Only texts with a hit are read again; their few hits travel to them, many are exchanged.
    with_hits = stage(hits.select("_id", "_th").distinct(), "op7-rows")
    read = w.select("_id", "_th", "w").join(small(with_hits), ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"])
    return (hits.join(read, ["_id", "_th"]).filter(F.slice("w", F.col("pos") + 1, K) == F.col("said"))
            .select("_id", "_th", "template", "label", "base", "t_words", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos")
            .distinct())


def scan_licenses(docs: DataFrame, coverage: float = 0.7, drift: int = 3, passage: int = 40) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    A band gives its label when it verified ``coverage`` of the template's words, or ``passage``
    words of a longer template; of bands over the same words the fullest counts. ``score`` is 1.0 where a base phrase stands, else the largest
    share of a template (or of a passage) that a band verified (bands under the limits give no
    label but keep their score), 0.0 without any vote. Null and empty texts have no words and
    no labels; repeated rows get equal answers; an empty table gives no rows.
    """
    w = row_key(texts(docs)).select("doc_id", "_id", "_th", words_of(F.col("text")).alias("w"))
    grams = (w.filter(F.size("w") >= K)
             .withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("w") - K)))
             .select("_id", "_th", "pos", _gram("pos").alias("gram")))
    hits = stage(_verified_hits(w, grams), "op7-verified")
    diagonals = (hits.groupBy("_id", "_th", "template", "label", "base", "t_words", "diagonal")
                 .agg(F.collect_set("tpos").alias("at")))
    key = ["_id", "_th", "template", "label", "base", "t_words"]
    base = diagonals.filter(F.col("base") & (F.size("at") == F.col("t_words") - (K - 1)))
    # Neighbouring diagonals: a step over ``drift`` words begins another band.
    order = Window.partitionBy(*key).orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    bands = (diagonals.filter(~F.col("base"))
             .withColumn("new", F.when(step <= drift, 0).otherwise(1))
             .withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*key, "band")
             .agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
                  F.min(F.col("diagonal") + F.array_min("at")).alias("lo"),
                  (F.max(F.col("diagonal") + F.array_max("at")) + (K - 1)).alias("hi"))
             .withColumn("words", F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (K - 1)))))))
             .withColumn("covered", F.col("words") / F.least(F.col("t_words"), F.lit(passage / coverage))))
    # Of bands over the same words the one that verified most gives its label (equals all do).
    along = Window.partitionBy("_id", "_th").orderBy("lo", "hi", "template")
    apart = F.when(F.col("lo") <= F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    enough = (bands.filter(F.col("covered") >= coverage).withColumn("new", apart)
              .withColumn("place", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))))
    best = F.max("words").over(Window.partitionBy("_id", "_th", "place"))
    labelled = enough.withColumn("best", best).filter(F.col("words") == F.col("best"))
    found = (base.select("_id", "_th", "label", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
             .unionByName(labelled.select("_id", "_th", "label", F.lit(None).cast("int").alias("start"), F.lit(0.0).alias("share")))
             .unionByName(bands.select("_id", "_th", F.lit(None).cast("string").alias("label"),
                                       F.lit(None).cast("int").alias("start"), F.least(F.lit(1.0), "covered").alias("share")))
             .groupBy("_id", "_th")
             .agg(F.count("start").alias("n_base"), F.min("start").cast("long").alias("first_word"),
                  F.max("start").cast("long").alias("last_word"),
                  F.array_join(F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.col("label")))),
                               ",").alias("base_labels"),
                  F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
                  F.max("share").alias("score")))
    return (w.select("doc_id", "_id", "_th", F.size("w").cast("long").alias("n_words"))
            .join(found, ["_id", "_th"], "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
                    "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
