"""License scans, with DataFrame functions only: statements, headers and licence files against templates, then inheritance along directories.

What is compared with templates are a file's units: its lines and sentences, its paragraphs and comment blocks without the
comment marks (so that wrapped headers are whole), and the whole text of a file that is named like a licence file. Units and
templates are sparse TF-IDF vectors of their words, with the idf of all files. A unit is of the template of the greatest
cosine, if that is at least THRESHOLD. A unit can reach it only if it holds one of the heavy terms, as is proved from the
templates' vectors; so only units with such a word are compared, and none is lost. SPDX tags are read as they are. A file without a licence of its own has that of the licence file in its nearest
ancestor directory.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import small, words, written
from lanternfish.llm.license_texts import TEMPLATES

THRESHOLD = 0.5
#: Names of licence files.
NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice|copyright|unlicense)[^/]*$"
#: Share of a file's words in units like licence texts from which a file of another name is a licence file, too.
MOSTLY = 0.9
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*+)"
#: Groups repeat possessively here, as Java's matcher then loops; else each repetition takes a stack frame, and long files end it.
#: What sets lines and sentences, and paragraphs, apart; comment marks at the beginning of a line; comment lines in a row.
STATEMENTS = r"\n|(?<=[.!?])[ \t]+(?=\p{Lu})"
PARAGRAPHS = r"\n[ \t]*\n"
MARKS = r"(?md)^[ \t]*(?:/?\*+/?|//+|#+|--+|;+|%+|<!--)[ \t]*"
BLOCKS = r"(?md)(?:^[ \t]*(?:/?\*|//|#|--|;|%).*\n?){2,}+"


def units(text: Column, named: Column) -> Column:
    """The distinct units of a text, as arrays of words; a null text has none."""
    bare = F.regexp_replace(text, MARKS, "")
    blocks = F.transform(F.regexp_extract_all(text, F.lit(BLOCKS), F.lit(0)), lambda b: F.regexp_replace(b, F.lit(MARKS), F.lit("")))
    whole = F.when(named, F.array(bare)).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.split(text, STATEMENTS), F.split(bare, PARAGRAPHS), blocks, whole)
    return F.array_distinct(F.transform(parts, words))


def frequencies(files: DataFrame) -> DataFrame:
    """The written number of files, n, that hold each term."""
    terms = files.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    return written(terms.groupBy("term").agg(F.count("*").alias("n")), "frequencies")


def _idf(n: Column, total: int) -> Column:
    return F.log((total + 1.0) / (n + 1)) + 1


def _weight(tf: Column, n: Column, total: int) -> Column:
    return (1 + F.log(tf)) * _idf(n, total)


def _weighed(templates: DataFrame, known: DataFrame, total: int) -> list:
    """template, term, n, w of the templates' terms; a term that no file holds counts as held by none."""
    own = templates.select("template", F.explode(words(F.col("text"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    rows = own.join(known, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("template", "term", "n", _weight(F.col("tf"), F.col("n"), total).alias("w"))
    return sorted(rows.collect(), key=lambda r: (r["template"], r["term"]))


def heavy_terms(weights: list, threshold: float) -> list[str]:
    """Terms of which a unit must hold one to be like any template.

    A term's share is its greatest part of a template's squared length. The cosine with a template is at most the root of the
    shares of the terms in common; so terms whose shares together stay below the threshold's square can't reach it without
    one of the others. The most frequent terms are taken for these, as far as their shares go.
    """
    lengths, share = defaultdict(float), defaultdict(float)
    for r in weights:
        lengths[r["template"]] += r["w"] ** 2
    for r in weights:
        share[r["term"]] = max(share[r["term"]], r["w"] ** 2 / lengths[r["template"]])
    held = {r["term"]: r["n"] for r in weights}
    light, left = set(), threshold * threshold * (1 - 1e-9)
    for term in sorted(share, key=lambda t: (-held[t], t)):
        if share[term] < left:
            left -= share[term]
            light.add(term)
    return sorted(set(share) - light)


def scanned(files: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, mostly: float = MOSTLY, kinds: tuple[str, ...] = ("text",)) -> DataFrame:
    """path, own_license, similarity, license, inherited_from (a directory) of each row of files (path, text).

    own_license is that of the file's most similar unit, ties by the licence's name; an SPDX tag is a unit of similarity 1. A file
    is a licence file by its name, or if units like templates of `kinds` hold at least `mostly` of its words; other files
    never give their licence to a directory. A null or empty text has no unit, a null path no directory; whole texts are
    scanned, however long; repeated rows get a row each, rows of one path with different texts each their own; other columns
    are ignored; an empty table gives no rows. Where a directory has several licence files, the most similar counts, ties by
    the licence's name; the directory of a path is all before its last slash. Distinct units are compared once each and
    directories, not files, walk up the tree, so that a common header or a large directory is one row in these steps.
    """
    spark = files.sparkSession
    rows = files.select("path", "text", F.xxhash64("path", "text").alias("file"))
    held = rows.where("text is not null")
    total, known = held.count(), frequencies(held)
    named = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, kind string, text string")
    weights = _weighed(named, known, total)
    heavy = F.array(*map(F.lit, heavy_terms(weights, threshold))) if weights else F.array(F.lit(""))
    is_named = F.coalesce(F.col("path").rlike(NAMES), F.lit(False))
    some = held.where(F.arrays_overlap(words(F.col("text")), heavy)).select("file", F.explode(units(F.col("text"), is_named)).alias("words")).where(F.arrays_overlap("words", heavy))
    found = written(some.select("file", F.md5(F.array_join("words", " ")).alias("unit"), "words").distinct(), "found")
    theirs = spark.createDataFrame([(r["template"], r["term"], r["w"]) for r in weights], "template int, term string, v double")
    norms = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    own = found.select("unit", "words").dropDuplicates(["unit"]).select("unit", F.explode("words").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    own = written(own.join(known, "term").select("unit", "term", _weight(F.col("tf"), F.col("n"), total).alias("w")), "terms")
    own_norms = own.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own_norm"))
    dots = own.join(F.broadcast(theirs), "term").groupBy("unit", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    likes = dots.join(own_norms, "unit").join(F.broadcast(norms), "template").withColumn("similarity", F.round(F.col("dot") / (F.col("own_norm") * F.col("norm")), 6))
    likes = likes.where(F.col("similarity") >= threshold).join(F.broadcast(named.drop("text")), "template")
    best = F.max_by(F.struct("license", "kind"), F.struct("similarity", F.lit(0) - F.col("template"))).alias("x")
    likes = written(likes.groupBy("unit").agg(best, F.max("similarity").alias("similarity")).select("unit", "x.license", "x.kind", "similarity"), "likes")
    hits = found.join(likes, "unit").select("file", "license", "similarity", F.size("words").alias("stated"), "kind")
    tags = held.where(F.contains("text", F.lit("SPDX-License-Identifier:"))).select("file", F.regexp_extract("text", TAG, 1).alias("license")).where("license <> ''")
    tags = tags.select("file", F.regexp_replace("license", r"[ \t]+", " ").alias("license"), F.lit(1.0).alias("similarity"), F.lit(0).alias("stated"), F.lit("tag").alias("kind"))
    hits = hits.unionByName(tags.distinct())
    stated = F.sum(F.when(F.col("kind").isin(*kinds), F.col("stated")).otherwise(0)).alias("stated")
    own = hits.groupBy("file").agg(F.max_by("license", F.struct(F.col("kind") == "tag", F.col("similarity"), F.col("license"))).alias("own_license"), F.max("similarity").alias("similarity"), stated)
    own = written(own, "own")
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    sized = rows.where("path is not null").join(own, "file").select(directory.alias("ancestor"), is_named.alias("named"), "stated", F.size(words(F.col("text"))).alias("words"), "own_license", "similarity")
    makers = sized.where(F.col("named") | ((F.col("stated") > 0) & (F.col("stated") >= mostly * F.col("words"))))
    granted = written(makers.groupBy("ancestor").agg(F.max_by("own_license", F.struct("similarity", "own_license")).alias("granted")), "granted")
    folders = rows.where("path is not null").select(directory.alias("directory")).distinct()
    parts = F.split("directory", "/")
    up = folders.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("ancestor", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = up.join(small(granted), "ancestor").groupBy("directory").agg(F.max_by(F.struct("granted", "ancestor"), "depth").alias("x"))
    nearest = written(nearest.select("directory", "x.granted", "x.ancestor"), "nearest")
    out = rows.select("path", "file", directory.alias("directory")).join(small(nearest), "directory", "left").join(own.drop("stated"), "file", "left")
    return out.select(
        "path", "own_license", "similarity", F.coalesce("own_license", "granted").alias("license"), F.when(F.col("own_license").isNull(), F.col("ancestor")).alias("inherited_from")
    )
