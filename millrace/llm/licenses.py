"""Licence scans, in DataFrame functions alone.

Every line of a file, and the file as a whole, is compared to licence templates by the cosine of
their sparse TF-IDF vectors. A line close to a template is a licence header; a file close to
one is a licence file, and holds for its directory. A file without a header inherits from the
licence file in the nearest directory above it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_staged, staged
from millrace.operators.joins import splittable_join

# Cosines from which a line is a header and a file is a licence file.
HEADER, FILE = 0.7, 0.4
# Notices by which the licences are known.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Proprietary", "All rights reserved"),
]
TERM = r"([a-z0-9]+(?:[.\-][a-z0-9]+)*)"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def _words(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def inverse_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies over all of ``files`` of the terms of ``vocabulary`` (the
    templates', so a bounded number), and that of a term in no document, which counts for all
    other terms."""
    held = F.explode(F.array_intersect(terms(F.col("text")), F.array(*[F.lit(term) for term in vocabulary])))
    counts = dict(files.select(held.alias("term")).groupBy("term").count().collect())
    total = files.where("text IS NOT NULL").count()
    rare = math.log(total + 1) + 1
    return {term: math.log((total + 1) / (counts.get(term, 0) + 1)) + 1 for term in vocabulary}, rare


def template_vectors(templates: list[tuple[str, str]], weights: dict[str, float]) -> dict[str, dict[str, float]]:
    """Unit vectors of the templates."""
    vectors = {}
    for name, text in templates:
        words = _words(text)
        vector = {word: words.count(word) * weights[word] for word in sorted(set(words))}
        length = math.sqrt(sum(w * w for w in vector.values()))
        vectors[name] = {word: w / length for word, w in vector.items()}
    return vectors


def needed_terms(vectors: dict[str, dict[str, float]], least: float) -> set[str]:
    """Terms of which a text needs one to have a cosine of ``least`` with any template: the
    heaviest of each, until the others together are shorter than ``least``."""
    needed = set()
    for vector in vectors.values():
        rest = 1.0
        for word, weight in sorted(vector.items(), key=lambda item: (-item[1], item[0])):
            if rest < (least * (1 - 1e-9)) ** 2:
                break
            needed.add(word)
            rest -= weight * weight
    return needed


def _best(units: DataFrame, vectors: dict[str, dict[str, float]], weights: dict[str, float], rare: float) -> DataFrame:
    """path, unit, license, cosine: the closest template of every unit (id, path, unit, words)."""
    spark = units.sparkSession
    known = spark.createDataFrame(sorted(weights.items()), "term string, weight double")
    entries = [(name, word, w) for name, vector in vectors.items() for word, w in vector.items()]
    template = spark.createDataFrame(entries, "license string, term string, share double")
    counted = units.select("id", "path", "unit", F.explode("words").alias("term")).groupBy("id", "path", "unit", "term").count()
    weighed = counted.join(known, "term", "left").withColumn("w", F.col("count") * F.coalesce("weight", F.lit(rare)))
    lengths = weighed.groupBy("id", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.join(template, "term").groupBy("id", "path", "unit", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    cosines = dots.join(lengths, ["id", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("length"), 6))
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best")
    return cosines.groupBy("path", "unit", "id").agg(best).select("path", "unit", "best.license", (-F.col("best.minus")).alias("cosine"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """path, license, origin, cosine, directory: one row per path of ``files`` (path, text).

    origin is ``header`` (of the closest line), ``inherited`` (from a licence file, in
    ``directory``, the nearest directory at or above that of the file) or ``none`` (license null).
    A header outweighs what is inherited. Of equally close templates the first by name wins; of
    several licence files of a directory the closest to its template. Paths are parted by ``/``;
    the root is the directory ''. Rows of one path are one file; null and empty texts have no
    header; rows without a path have no result. Other columns are ignored.

    Texts are read where they lie: only files that hold a term without which no template is
    close enough go on, so only their terms are shuffled. Directories are resolved once each.
    """
    files = files.select("path", "text").where("path IS NOT NULL")
    vocabulary = sorted({word for _, text in templates for word in _words(text)})
    weights, rare = inverse_frequencies(files, vocabulary)
    vectors = template_vectors(templates, weights)
    needed = "|".join(re.escape(word) for word in sorted(needed_terms(vectors, min(HEADER, FILE))))
    holds = rf"(?i)(?:^|[^a-z0-9])(?:{needed})(?![a-z0-9])"
    near = files.where(F.col("text").rlike(holds)).select(F.monotonically_increasing_id().alias("id"), "path", "text")
    near = staged(near, "license-candidates")
    lines = near.select("id", "path", F.posexplode(F.split("text", "\n")).alias("line", "part")).where(F.col("part").rlike(holds))
    units = lines.select("id", "path", (F.col("line") + 1).alias("unit"), terms(F.col("part")).alias("words")).union(
        near.select("id", "path", F.lit(0), terms(F.col("text")))
    )
    best = staged(_best(units, vectors, weights, rare), "license-best")
    drop_staged(near)
    closest = F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best")
    headers = best.where((F.col("unit") > 0) & (F.col("cosine") >= HEADER)).groupBy("path").agg(closest)
    directory = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    named = best.where((F.col("unit") == 0) & (F.col("cosine") >= FILE)).withColumn("directory", directory)
    holders = named.groupBy("directory").agg(closest).select(
        F.col("directory").alias("holder"), F.col("best.license").alias("held_license"), (-F.col("best.minus")).alias("held_cosine")
    )
    paths = files.select("path").distinct().withColumn("directory", directory)
    # Each directory with all that are above it, down from the root.
    steps = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.split("directory", "/")))
    above = paths.select("directory").distinct().select("directory", steps.alias("steps")).select(
        "directory",
        F.posexplode(
            F.transform("steps", lambda _, k: F.array_join(F.slice("steps", F.lit(2), k), "/"))
        ).alias("depth", "holder"),
    )
    inherited = (
        above.join(holders, "holder")
        .groupBy("directory")
        .agg(F.max_by(F.struct("holder", "held_license", "held_cosine"), "depth").alias("from"))
    )
    found = splittable_join(paths.join(headers, "path", "left"), inherited, ["directory"], "left")
    own = F.col("best").isNotNull()
    return found.select(
        "path",
        F.coalesce("best.license", "from.held_license").alias("license"),
        F.when(own, "header").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce(-F.col("best.minus"), "from.held_cosine").alias("cosine"),
        F.when(~own, F.col("from.holder")).alias("directory"),
    )
