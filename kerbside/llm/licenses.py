"""License scans by diagonal voting.

Texts and templates are cut into overlapping runs of ``k`` words.  All runs of the
documents are joined by hash to the positions of the same runs in the templates; a
match at word d of a document and word t of a template votes for the diagonal d - t.
Votes are summed by (document, template, diagonal); diagonals that lie close
together (words inserted or dropped) merge into one span; a span stands if half of
the template's runs voted for it and the words of document and template agree in
enough places.  Its score is the share of the template's words that agree.

Templates that hold much of each other (CC BY and CC BY-NC, the BSD licenses) all
match one passage.  Of spans that overlap, the one with the most agreeing words
stands, then the one with the higher score: a longer template wins where its own
words are there, a shorter one where they are not.

Beside the templates there are base phrases, found wherever their words stand
consecutively; each has a label.

Cases: null or empty text has no words, places or labels, and score 0; rows are told
apart by id and text, rows that share both get the same answer; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.textvec import ALNUM, Words, map_batches, ngrams, number, row_key, slices
from kerbside.storage import materialise

#: Phrases and the labels they give, as the contract of the query states them.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public license texts, whole where they are short, else their notices. A name is a label, and what follows a slash tells apart templates of one label.
TEMPLATES = {
    "mit/grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "mit/whole": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "bsd-2": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-3": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "gpl-2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "lgpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "agpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}

K = 3
#: Diagonals at most so far apart merge.
GAP = 3
#: Share of a template's runs that have to vote, and of its words that have to agree.
MIN_VOTES, MIN_AGREE = 0.5, 0.6
#: Runs of words of a document in one row; a longer document gives several rows.
ROW_RUNS = 1 << 16
#: Positions of templates up to which their table is broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_RUNS = 200_000


def _template_words(templates: dict[str, str]) -> dict[str, list[bytes]]:
    out = {}
    for name, text in templates.items():
        w = Words(pa.array([text]), ALNUM)
        out[name] = [w.word(k) for k in range(len(w.starts))]
    return out


def _template_runs(templates: dict[str, str], k: int) -> list[tuple[int, str, int, int]]:
    """(hash, template, position, runs of the template)."""
    rows = []
    for name, text in templates.items():
        hashes = ngrams(Words(pa.array([text]), ALNUM).hashes(), k).tolist()
        rows += [(number(h), name, at, len(hashes)) for at, h in enumerate(hashes)]
    return rows


def _phrase_places(words: Words, hashes: np.ndarray, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(word number, label) wherever a phrase's words stand consecutively within one text."""
    out = []
    doc_end = np.repeat(words.first[1:], np.diff(words.first))
    for phrase, label in phrases.items():
        own = Words(pa.array([phrase]), ALNUM)
        want = own.hashes()
        n = len(want)
        if not n or len(hashes) < n:
            continue
        ok = hashes[: len(hashes) - n + 1] == want[0]
        for j in range(1, n):
            ok &= hashes[j : len(hashes) - n + 1 + j] == want[j]
        at = np.flatnonzero(ok)
        at = at[at + n <= doc_end[at]]
        text = own.text(0, n)
        out += [(int(x), label) for x in at if words.text(int(x), int(x) + n) == text]
    return sorted(out)


def all_runs(rows: DataFrame, k: int) -> DataFrame:
    """(key, at, hash): every run of ``k`` words of every (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                grams = ngrams(words.hashes(), k).view(np.int64)
                row, at, found = [], [], []
                for d, (lo, n) in enumerate(zip(words.first[:-1].tolist(), words.counts().tolist())):
                    for first in range(0, n - k + 1, ROW_RUNS):
                        row.append(d)
                        at.append(first)
                        found.append((lo + first, min(ROW_RUNS, n - k + 1 - first)))
                size = np.array([m for _, m in found], np.int64)
                take = np.repeat(np.array([a for a, _ in found], np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(grams[take]))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), hashes], names=["key", "first", "hashes"])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([rows.schema["key"], *_parse_datatype_string("first int, hashes array<bigint>").fields])
    found = map_batches(rows.select("key", "text"), run, schema)
    return found.select("key", "first", F.posexplode("hashes").alias("pos", "hash")).select("key", (F.col("first") + F.col("pos")).alias("at"), "hash")


def scan(rows: DataFrame, phrases: dict[str, str], templates: dict[str, str], k: int) -> DataFrame:
    """For each (key, id, text): its words, base places, and the words (``region``) near runs that templates have, by which spans are verified."""
    wanted = np.unique(np.array([h for h, *_ in _template_runs(templates, k)] or [0], np.int64).astype(np.uint64))
    reach = max([len(w) for w in _template_words(templates).values()] or [0]) + GAP
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, region array<struct<at:int,word:string>>"
    schema = StructType([rows.schema["key"], rows.schema["id"], *_parse_datatype_string(added).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                n = part.num_rows
                hashes = words.hashes()
                places: list[list] = [[] for _ in range(n)]
                near: list[set[int]] = [set() for _ in range(n)]
                doc_of = lambda x: int(np.searchsorted(words.first, x, side="right")) - 1
                for at, label in _phrase_places(words, hashes, phrases):
                    places[doc_of(at)].append((at, label))
                grams = ngrams(hashes, k)
                hit = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
                for at in np.flatnonzero(wanted[hit] == grams).tolist():
                    doc = doc_of(at)
                    if at + k <= words.first[doc + 1]:
                        near[doc].update(range(max(int(words.first[doc]), at - reach), min(int(words.first[doc + 1]), at + reach)))
                base = words.first.tolist()
                region = [[{"at": x - base[d], "word": words.word(x).decode("utf-8", "replace")} for x in sorted(near[d])] for d in range(n)]
                low = [p[0][0] - base[d] if p else None for d, p in enumerate(places)]
                high = [p[-1][0] - base[d] if p else None for d, p in enumerate(places)]
                values = [
                    part.column("key").cast(arrow.field("key").type), part.column("id").cast(arrow.field("id").type), words.counts(), [len(p) for p in places], low, high,
                    [sorted({label for _, label in p}) for p in places], region,
                ]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    return map_batches(rows.select("key", "id", "text"), run, schema)


SPAN = "struct<template:string,first_word:int,last_word:int,score:double>"


def spans(runs: DataFrame, regions: DataFrame, templates: dict[str, str], k: int = K, gap: int = GAP, min_votes: float = MIN_VOTES, min_agree: float = MIN_AGREE) -> DataFrame:
    """(key, spans): verified spans, those that overlap a better one left out, from all runs (key, at, hash) and the words (key, region)."""
    spark = runs.sparkSession
    listed = _template_runs(templates, k)
    table = spark.createDataFrame(listed, "hash bigint, template string, place int, n_runs int")
    voted = (
        runs.join(F.broadcast(table) if len(listed) <= BROADCAST_RUNS else table, "hash")
        .groupBy("key", "template", (F.col("at") - F.col("place")).alias("diagonal"))
        # a set, as copies of a row vote at the same places; a diagonal meets each place of the template once
        .agg(F.collect_set("at").alias("at"), F.max("n_runs").alias("n_runs"))
        .select("key", "template", "diagonal", "n_runs", F.size("at").alias("votes"), F.array_min("at").alias("lo"), F.array_max("at").alias("hi"))
    )
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    jump = F.col("diagonal") - F.lag("diagonal").over(order) > gap
    merged = (
        voted.withColumn("group", F.sum(F.coalesce(jump, F.lit(False)).cast("int")).over(order))
        .groupBy("key", "template", "group")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), (F.max("hi") + k - 1).alias("hi"), F.max("n_runs").alias("n_runs"),
             F.collect_set("diagonal").alias("diagonals"))
        .where(F.col("votes") >= F.col("n_runs") * min_votes)
    )
    own = _template_words(templates)
    words = spark.createDataFrame([(t, [x.decode() for x in w], len(w)) for t, w in own.items()], "template string, words array<string>, n int")
    near = merged.join(words, "template").join(regions.where(F.size("region") > 0).select("key", "region").dropDuplicates(["key"]), "key")
    have = F.map_from_entries(F.transform("region", lambda x: F.struct(x["at"], x["word"])))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    agree = F.size(F.filter(places, lambda p: F.exists("diagonals", lambda d: F.coalesce(F.get(F.col("words"), p) == F.try_element_at(F.col("have"), (d + p).cast("int")), F.lit(False)))))
    verified = near.withColumn("have", have).withColumn("agree", agree).withColumn("score", F.col("agree") / F.col("n")).where(F.col("score") >= min_agree)
    found = F.struct("template", F.col("lo").alias("first_word"), F.col("hi").alias("last_word"), "score")
    best_first = F.sort_array(F.collect_list(F.struct((-F.col("agree")).alias("a"), (-F.col("score")).alias("s"), "template", "lo", found.alias("span"))))
    free = lambda kept, s: ~F.exists(kept, lambda o: (o["first_word"] <= s["last_word"]) & (s["first_word"] <= o["last_word"]))
    chosen = F.aggregate("ranked", F.array().cast(f"array<{SPAN}>"), lambda kept, r: F.when(free(kept, r["span"]), F.concat(kept, F.array(r["span"]))).otherwise(kept))
    return verified.groupBy("key").agg(best_first.alias("ranked")).select("key", F.array_sort(chosen).alias("spans"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, k: int = K) -> DataFrame:
    """A row for each document: words, base places, labels, verified spans and the best score.

    A base phrase is certain (score 1); otherwise the score is the best span's, 0 without one.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = materialise(scan(rows, phrases, templates, k), "licenses")
    if templates:
        out = out.join(spans(all_runs(rows, k), out, templates, k), "key", "left")
    else:
        out = out.withColumn("spans", F.lit(None).cast(f"array<{SPAN}>"))
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))
    label = lambda s: F.split_part(s["template"], F.lit("/"), F.lit(1))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.col("base").alias("base_labels"),
        F.array_sort(F.array_union("base", F.transform("spans", label))).alias("labels"), "spans",
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))).alias("score"),
    )


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op10 over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).drop("spans")
