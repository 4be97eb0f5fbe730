"""License scans by diagonal voting.

Every rolling word k-gram of a text is joined with the positions of equal k-grams in the license templates. A
match at word i of the text and word j of a template votes for the diagonal i - j, the place where the template
would start. Votes are summed by text, template and diagonal; diagonals at most SLACK apart are merged, which
carries a match over inserted or missing words; and a merged span is verified by the share of the template's
words that its k-grams cover. Short phrases (2-grams) must be covered whole on a single diagonal, longer
templates (5-grams) to at least 0.8.

K-grams are 64-bit hashes of hashes of words, and all of a text's go into the join; the templates may be of any number
and length. A span's share is counted on its own words, so a chance equality of two hashes adds a word or two at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, small_batches, stage, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHORT, LONG, COVER, SLACK = 2, 5, 0.8, 3

PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Well-known openings and notices; each label is added where the text covers enough of one.
TEMPLATES = (
    ("mit-terms", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-terms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-terms", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-4.0", "licensed under cc by 4 0 international"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mit-notice", "released under the terms of the mit license"),
)


#: Whole permissive licenses, without their copyright lines.
WHOLE = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib-text", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
TEMPLATES += WHOLE
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Ends each text's hashes and is joined with a row of its own, so that texts without a match come through the join too.
END = 0


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text)) if text else []


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, given the words' hashes; END is none of them."""
    n = len(hashes) - k + 1
    out = np.full(max(0, n), k, np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * _MULTIPLIER + hashes[i : i + n]
    out = (out ^ out >> np.uint64(32)).view(np.int64)
    return np.where(out == END, 1, out)


def _hashed(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; known keeps those of earlier ones, up to 200,000."""
    if len(known) > 200_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def template_table(phrases=PHRASES, templates=TEMPLATES) -> list[tuple]:
    """Rows (k, hash, template, base, label, words, at), one for each k-gram of each template, and template -1 for the end of a text."""
    rows = [(0, END, -1, False, "", 0, 0)]
    for t, (label, text, k, base) in enumerate([*((a, b, SHORT, True) for a, b in phrases), *((a, b, LONG, False) for a, b in templates)]):
        words = words_of(text)
        if len(words) < k:
            raise ValueError(f"a template needs {k} words at least: {text!r}")
        rows += [(k, h, t, base, label, len(words), at) for at, h in enumerate(rolled(_hashed(words, {}), k).tolist())]
    return rows


@F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))]))
def grams(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """struct(n_words, hashes): the hashes of all runs of SHORT words of a text, then those of all runs of LONG words, then END."""
    known: dict[str, int] = {}
    for texts in batches:
        counts, found = [], []
        for t in texts:
            words = words_of(t)
            hashes = _hashed(words, known)
            counts.append(len(words))
            found.append(np.concatenate([rolled(hashes, SHORT), rolled(hashes, LONG), [END]]))
        yield pd.DataFrame({"n_words": counts, "hashes": found})


def matched(docs: DataFrame, rows: list[tuple], id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, n_words, template, base, label, words, k, at, pos): each k-gram at word pos of a text that a template has at word `at`, and a row of template -1 for each text; rid numbers the rows of docs.

    Staged, so that texts are read once and a row keeps its number. The templates are read from a written table, so that Spark knows
    their size: it broadcasts them if they are few, and splits hot hashes if not.
    """
    templates = stage(docs.sparkSession.createDataFrame(rows, "k int, hash long, template int, base boolean, label string, words int, at int").coalesce(1), "templates")
    every = docs.select(F.col(id_col).alias("doc_id"), grams(F.col(text_col)).alias("g")).select("doc_id", "g.n_words", "g.hashes").withColumn("rid", F.monotonically_increasing_id())
    hits = every.select("rid", "doc_id", "n_words", F.posexplode("hashes").alias("i", "hash")).join(templates, "hash")
    pos = F.col("i") - F.when(F.col("k") == LONG, F.greatest(F.col("n_words") - (SHORT - 1), F.lit(0))).otherwise(0)
    return stage(hits.select("rid", "doc_id", "n_words", "template", "base", "label", "words", "k", "at", pos.cast("long").alias("pos")), "hits")


def spans(hits: DataFrame) -> DataFrame:
    """(rid, base, label, start, cover) for hits (rid, template, base, label, words, k, at, pos): merged diagonals with the share of the template they cover, unverified ones too; of templates at one place the best."""
    votes = hits.groupBy("rid", "template", "base", "label", "words", "k", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    slack = F.when(F.col("base"), 0).otherwise(SLACK)
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    votes = votes.withColumn("island", F.sum(fresh.cast("int")).over(order))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ats")), lambda a: F.sequence(a, a + F.col("k") - 1))))
    merged = votes.groupBy("rid", "template", "base", "label", "words", "k", "island").agg(F.min("diagonal").alias("start"), F.size(covered).alias("n"))
    found = merged.select("rid", "base", "label", "start", (F.col("n") / F.col("words")).alias("cover"))
    # Templates that differ in a word or two, as versions of a license do, claim the same place: the best cover has it.
    same = Window.partitionBy("rid", "base", "start")
    return found.withColumn("most", F.max("cover").over(same)).where(F.col("base") | (F.col("cover") == F.col("most"))).drop("most")


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of docs.

    Null and empty texts have no words. n_base counts all places of phrases, overlapping ones too; first_word and
    last_word are null and labels are empty without any. score is the greatest verified share of a template that
    the text covers, or half the greatest share where nothing is verified. Repeated rows stay repeated; ids may be
    null or repeat; an empty table gives no rows. Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    rows = template_table(phrases, templates)
    hits = matched(docs, rows, id_col, text_col)
    found = spans(hits.where("template >= 0"))
    good = F.when(F.col("base"), F.col("cover") >= 1).otherwise(F.col("cover") >= COVER)
    base = F.col("base") & good
    by_doc = found.groupBy("rid").agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.max(F.when(good, F.least("cover", F.lit(1.0))).otherwise(F.when(~F.col("base"), F.col("cover") / 2).otherwise(0.0))).alias("score"),
    )
    out = hits.where("template < 0").select("doc_id", "n_words", "rid").join(by_doc, "rid", "left")
    blank = F.lit("")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", blank).alias("base_labels"), F.coalesce("labels", blank).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
