"""License scans: TF-IDF cosine of license statements to templates, inherited down directories.

Every sentence of a text that can reach the threshold is compared with short license
templates; so is a licence file, which is a text like any other. A sentence's vector holds
each word's count times its inverse document frequency over the templates (a word of no
template weighs most). A document without a statement of its own inherits from the nearest
ancestor directory that holds a licence file, found by joining paths.

Only DataFrame functions are used. Words that are needed to reach the threshold at all
follow from the templates by the Cauchy-Schwarz inequality: if the template's weights outside
a set of words have a norm below threshold times the whole norm, a sentence without any word
of the set stays below the threshold. Sentences without such words are passed over before
any vector is made, without changing a result.
"""

from __future__ import annotations

import re
from math import log, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from dwops.session import stored

THRESHOLD = 0.6

# Short statements of common licences, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Words without weight.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"]
WORD = re.compile(r"[a-z0-9]+")
SHORT = 4  # letters below which a word is looked for between word ends only
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.\-_].*)?$"
SENTENCE = r"\n+|(?<=[.!?;])\s+"


class Weights:
    """Inverse document frequencies of the templates' words and unit vectors of the templates."""

    def __init__(self, templates: dict[str, str], threshold: float):
        counted = {name: self._counts(text) for name, text in templates.items()}
        total = len(counted)
        terms = sorted({t for c in counted.values() for t in c})
        self.unknown = log(1 + total) + 1
        self.idf = {t: log((1 + total) / (1 + sum(t in c for c in counted.values()))) + 1 for t in terms}
        self.vectors = {}
        needed: set[str] = set()
        for name, counts in counted.items():
            raw = {t: n * self.idf[t] for t, n in counts.items()}
            norm = sqrt(sum(v * v for v in raw.values()))
            self.vectors[name] = {t: v / norm for t, v in raw.items()}
            # Letters before digits and the longest words first, as texts seldom hold them, until what is left
            # cannot reach the threshold.
            left = sorted(self.vectors[name].items(), key=lambda x: (not x[0].isdigit(), len(x[0]), x[0]))
            while left and sqrt(sum(v * v for _, v in left)) >= threshold:
                needed.add(left.pop()[0])
        self.needed = sorted(needed)

    @staticmethod
    def _counts(text: str) -> dict[str, int]:
        words = [w for w in WORD.findall(text.lower()) if w not in STOP]
        return {w: words.count(w) for w in words}


def _literal(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _dot(words: str, factor: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda s, t: s + F.coalesce(F.element_at(factor, t), F.lit(0.0)))


def statements(docs: DataFrame, keys: list[str], text_col: str = "text", threshold: float = THRESHOLD,
               templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """The keys and (license, cosine) of each sentence and template at or above the threshold."""
    w = Weights(templates, threshold)

    short = "|".join(x for x in w.needed if len(x) < SHORT)
    whole = rf"(?<![a-z0-9])(?:{'|'.join(w.needed)})(?![a-z0-9])"

    def marked(text: Column) -> Column:
        test = F.regexp_like(text, F.lit(rf"(?<![a-z0-9])(?:{short})(?![a-z0-9])")) if short else F.lit(False)
        for word in w.needed:
            test = F.contains(text, F.lit(word)) | test if len(word) >= SHORT else test
        return test

    # The whole text first: most have no such word at all.
    candidates = docs.where(marked(F.lower(F.col(text_col).cast("string"))))
    parts = candidates.select(*keys, F.explode(F.split(_lower(F.col(text_col).cast("string")), SENTENCE)).alias("_s")).where(F.col("_s").rlike(whole))
    found_words = F.filter(F.regexp_extract_all("_s", F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(STOP))
    words = parts.select(*keys, F.array_sort(found_words).alias("_w"))
    idf = _literal(w.idf)
    weight = lambda t: F.coalesce(F.element_at(idf, t), F.lit(w.unknown))
    # One pass over the sorted words: the run r of a word adds idf^2 (2 r + 1) to the squared norm.
    start = F.struct(F.lit("").alias("t"), F.lit(0.0).alias("r"), F.lit(0.0).alias("s"))

    def add(state: Column, t: Column) -> Column:
        r = F.when(state["t"] == t, state["r"]).otherwise(F.lit(0.0))
        return F.struct(t.alias("t"), (r + 1).alias("r"), (state["s"] + weight(t) * weight(t) * (2 * r + 1)).alias("s"))

    norm = F.sqrt(F.aggregate("_w", start, add, lambda s: s["s"]))
    scores = []
    for name, vector in sorted(w.vectors.items()):
        factor = _literal({t: v * w.idf[t] for t, v in vector.items()})
        scores.append(F.struct(F.round(_dot("_w", factor) / F.col("_norm"), 6).alias("cosine"), F.lit(name).alias("license")))
    scored = words.withColumn("_norm", norm).where("_norm > 0").select(*keys, F.explode(F.array(*scores)).alias("_best"))
    return scored.where(F.col("_best.cosine") >= threshold).select(*keys, F.col("_best.license").alias("license"), F.col("_best.cosine").alias("cosine"))


def directory(path: Column) -> Column:
    """Everything before the last slash; the empty text for the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, cosine, basis ('own', 'inherited', 'none') and from_dir of every row.

    The best statement of a row's whole text is its own licence (equal cosines: first name).
    A licence file (its name begins with LICENSE, LICENCE or COPYING) gives its directory the
    best licence among the directory's licence files. Rows that state none inherit from their
    own directory or the nearest directory above it, the top included. NULL, empty and wordless
    texts state nothing; a NULL path lies in no directory and inherits nothing. Rows that
    repeat id and path are one document whose best statement counts for each row. An empty
    table gives no rows; other columns are ignored.
    """
    keys = ["doc_id", "path"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    first = F.struct((-F.col("cosine")).alias("c"), "license")
    own = statements(rows, keys, "text", threshold).groupBy(*keys).agg(F.min(first).alias("b"))
    # Read twice below, and small beside the texts.
    own = stored(own.select(*keys, F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine")))

    is_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)
    granted = own.where(is_file).groupBy(directory(F.col("path")).alias("dir")).agg(F.min(first).alias("b")).select("dir", F.col("b.license").alias("granted"))
    # Directories, not documents, look upwards: a crowded directory is one row here.
    places = rows.where("path is not null").select(directory(F.col("path")).alias("home")).distinct()
    steps = F.split("home", "/")
    upward = F.transform(F.sequence(F.size(steps), F.lit(0)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    above = places.select("home", F.posexplode(F.array_distinct(upward)).alias("up", "dir"))
    nearest = above.join(granted, "dir").groupBy("home").agg(F.min(F.struct("up", "dir", "granted")).alias("b"))
    nearest = nearest.select("home", F.col("b.dir").alias("dir"), F.col("b.granted").alias("granted"))

    mine = own.withColumnsRenamed({"doc_id": "_id", "path": "_path"})
    judged = rows.select(*keys, directory(F.col("path")).alias("home")).join(mine, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    out = judged.join(nearest, "home", "left")
    stated, inherited = F.col("license").isNotNull(), F.col("granted").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "granted").alias("license"), "cosine",
        F.when(stated, "own").when(inherited, "inherited").otherwise("none").alias("basis"),
        F.when(~stated & inherited, F.col("dir")).alias("from_dir"),
    )


def repository_path() -> Column:
    """A path for rows of ``documents``, which has none: source, language, and by id a licence file or a text."""
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("source"), F.lit("/LICENSE."), F.col("doc_id").cast("string")))
    inner = F.concat(F.col("source"), F.lit("/"), F.col("lang"))
    name = name.when(F.col("doc_id") % 7 == 1, F.concat(inner, F.lit("/LICENSE."), F.col("doc_id").cast("string")))
    return name.otherwise(F.concat(inner, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))


def sql() -> str:
    """The query in SQL; template weights are worked out there anew from the template texts."""
    stop = ", ".join(f"'{t}'" for t in STOP)
    rows = ", ".join(f"('{n}', '{t}')" for n, t in TEMPLATES.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH tpl(license, body) AS (VALUES {rows}),
tt AS (SELECT license, t, count(*) n FROM (SELECT license, unnest(regexp_extract_all({lower.format('body')}, '[a-z0-9]+')) t FROM tpl) WHERE t NOT IN ({stop}) GROUP BY ALL),
idf AS (SELECT t, ln((1.0 + (SELECT count(*) FROM tpl)) / (1 + count(*))) + 1 w FROM tt GROUP BY t),
tv AS (SELECT license, t, n * w / sqrt(sum(n * w * n * w) OVER (PARTITION BY license)) v FROM tt JOIN idf USING (t)),
d AS (SELECT row_number() OVER () rid, doc_id, text, CASE WHEN doc_id % 7 = 0 THEN source || '/LICENSE.' || doc_id
        WHEN doc_id % 7 = 1 THEN source || '/' || lang || '/LICENSE.' || doc_id ELSE source || '/' || lang || '/' || doc_id || '.txt' END path FROM documents),
s0 AS (SELECT rid, unnest(string_split_regex(regexp_replace({lower.format("coalesce(text, '')")}, '([.!?;])\\s+', '\\1' || chr(10), 'g'), '\\n+')) s FROM d),
s AS (SELECT row_number() OVER () sid, rid, s FROM s0),
sw AS (SELECT sid, rid, t, count(*) n FROM (SELECT sid, rid, unnest(regexp_extract_all(s, '[a-z0-9]+')) t FROM s) WHERE t NOT IN ({stop}) GROUP BY ALL),
sv AS (SELECT sid, rid, sw.t, n * coalesce(w, ln(1.0 + (SELECT count(*) FROM tpl)) + 1) x FROM sw LEFT JOIN idf ON sw.t = idf.t),
nrm AS (SELECT sid, rid, sqrt(sum(x * x)) z FROM sv GROUP BY ALL),
cs AS (SELECT nrm.rid, nrm.sid, license, round(sum(x * v) / any_value(z), 6) cosine FROM sv JOIN tv ON sv.t = tv.t JOIN nrm ON nrm.sid = sv.sid GROUP BY ALL),
own AS (SELECT doc_id, path, license, cosine FROM (SELECT doc_id, path, license, cosine, row_number() OVER (PARTITION BY doc_id, path ORDER BY cosine DESC, license) rn
          FROM cs JOIN d USING (rid) WHERE cosine >= {THRESHOLD}) WHERE rn = 1),
g AS (SELECT dir, license FROM (SELECT regexp_replace(path, '/[^/]*$', '') dir, license, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY cosine DESC, license) rn
        FROM own WHERE path LIKE '%/LICENSE.%') WHERE rn = 1),
j AS (SELECT d.doc_id, d.path, o.license, o.cosine, g1.license l1, g1.dir d1, g2.license l2, g2.dir d2
      FROM d LEFT JOIN own o ON o.doc_id = d.doc_id AND o.path = d.path
      LEFT JOIN g g1 ON g1.dir = regexp_replace(d.path, '/[^/]*$', '')
      LEFT JOIN g g2 ON g2.dir = split_part(d.path, '/', 1))
SELECT doc_id, path, coalesce(license, l1, l2) license, cosine, CASE WHEN license IS NOT NULL THEN 'own' WHEN coalesce(l1, l2) IS NOT NULL THEN 'inherited' ELSE 'none' END basis,
  CASE WHEN license IS NULL THEN coalesce(d1, d2) END from_dir FROM j
"""
