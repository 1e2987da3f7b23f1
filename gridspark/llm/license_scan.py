"""Licence scan: text units against licence templates by the Dice coefficient.

Units of a document are its lines, its paragraphs of several lines, and the
whole text if it has several paragraphs. A unit is normalised (lower case, runs
of anything but letters and digits to one space) and reduced to its set of word
bigrams. A template can only reach the threshold for set sizes within fixed
bounds, so it is joined by exactly those sizes; and a unit that reaches it must
hold some of the template's words (``needed_words``), so texts and units without
any of them are left out before they are normalised. Only DataFrame functions.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.llm.license_templates import TEMPLATES

BLANK_LINES = r"\n[ \t\x0B\f\r]*\n"
MAX_TEMPLATE_BIGRAMS = 200_000   # of all templates: what is broadcast is bounded by it


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(norm: Column) -> Column:
    """The distinct word bigrams of a normalised text; one word is one bigram."""
    words = F.split(norm, " ", -1)
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                       lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(norm == "", F.array().cast("array<string>")).when(F.size(words) == 1, words).otherwise(
        F.array_distinct(pairs))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Set sizes with which a set of ``size`` can reach the threshold."""
    return (math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9))


def template_parts(templates: Sequence[tuple[str, str]]) -> list[tuple[str, int, list[str]]]:
    """(licence, part number, bigrams) of each paragraph of each template and, if it
    has several, of the whole: blank lines that carry a comment sign part nothing."""
    parts: list[tuple[str, int, list[str]]] = []
    for name, text in templates:
        paragraphs = re.split(BLANK_LINES, text)
        for unit in paragraphs + [text] * (len(paragraphs) > 1):
            words = re.sub(r"[\W_]+", " ", unit.lower()).split()
            if words:
                grams = [" ".join(p) for p in zip(words, words[1:])] or words
                parts.append((name, sum(p[0] == name for p in parts), list(dict.fromkeys(grams))))
    return parts


def needed_words(parts: Sequence[tuple[str, int, list[str]]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold holds at least one.

    A unit that matches a template of ``n`` bigrams shares at least
    ``threshold * n / (2 - threshold)`` of them, so it cannot do without all
    bigrams of a large enough part of the template. Words are taken, long ones
    first, by the number of bigrams they still add to such parts (ties to the
    words that fewer bigrams of all templates hold)."""
    common: dict[str, int] = {}
    for *_, grams in parts:
        for g in grams:
            for w in g.split(" "):
                common[w] = common.get(w, 0) + 1
    missing = []
    for *_, grams in parts:
        shared = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        missing.append([len(grams) - shared + 1, [set(g.split(" ")) for g in grams]])
    chosen: list[str] = []
    for least in (6, 4, 1):
        while True:
            gain: dict[str, int] = {}
            for need, grams in missing:
                if need > 0:
                    own: dict[str, int] = {}
                    for g in grams:
                        for w in g:
                            if len(w) >= least:
                                own[w] = own.get(w, 0) + 1
                    for w, n in own.items():
                        gain[w] = gain.get(w, 0) + min(n, need)
            if not gain:
                break
            best = min(gain, key=lambda w: (-gain[w], common[w], w))
            chosen.append(best)
            for m in missing:
                left = [g for g in m[1] if best not in g]
                m[0], m[1] = m[0] - (len(m[1]) - len(left)), left
    return chosen


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the words: long ones as a part of
    it, short ones by themselves."""
    short = [w for w in words if len(w) < 4]
    alone = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(short)})(?![\p{{L}}\p{{N}}])"
    return F.exists(F.array(F.lower(text)), lambda t: functools.reduce(operator.or_, [
        *(F.contains(t, F.lit(w)) for w in words if len(w) >= 4), *([t.rlike(alone)] if short else [])], F.lit(False)))


def _by_size(spark: SparkSession, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    parts = template_parts(templates)
    if sum(len(g) for *_, g in parts) > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"templates hold over {MAX_TEMPLATE_BIGRAMS} bigrams; scan them in groups")
    rows = [(size_bounds(len(g), threshold)[0], size_bounds(len(g), threshold)[1], name, n, g) for name, n, g in parts]
    return (spark.createDataFrame(rows, "low int, high int, license string, part int, wanted array<string>")
            .select("license", "part", "wanted", F.explode(F.sequence("low", "high")).alias("size")))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), threshold: float = 0.8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit that matches a template: the id, ``kind`` (line, paragraph
    or text), ``unit`` (its number among the document's units of that kind, from
    0), ``license``, ``part`` (the template's paragraph, or the whole of it after its
    last paragraph) and ``dice``, for its best
    template (ties to the first by name and part).

    Defined cases: null, empty and blank texts match nothing; rows with null or
    equal ids are scanned each, rows that also have one text are reported once; a
    paragraph of one line counts as a line only, a text of one paragraph as that;
    extra columns are ignored; an empty table or no templates give no rows.

    Scale: one scan without any shuffle of texts or lines; the templates are
    broadcast (bounded by ``MAX_TEMPLATE_BIGRAMS``) and joined by set size; only
    matching units are grouped."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    wanted = F.broadcast(_by_size(docs.sparkSession, templates, threshold))
    words = needed_words(template_parts(templates), threshold)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(
        F.col("body").isNotNull() & _holds_any(F.col("body"), words)).withColumn("tag", F.xxhash64("body"))

    def units(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), t.alias("t")))

    lines, paragraphs = F.split("body", "\n", -1), F.split("body", BLANK_LINES, -1)
    several = F.filter(units("paragraph", paragraphs), lambda u: F.contains(u["t"], F.lit("\n")))
    whole = F.filter(units("text", F.array("body")), lambda u: F.size(paragraphs) > 1)
    every = F.filter(F.concat(units("line", lines), several, whole), lambda u: _holds_any(u["t"], words))
    found = (text.select("id", "tag", F.explode(every).alias("u"))
             .select("id", "tag", "u.kind", "u.unit", normalised(F.col("u.t")).alias("norm")).where("norm <> ''")
             .withColumn("held", bigrams(F.col("norm"))).withColumn("size", F.size("held"))
             .join(wanted, "size"))
    dice = F.size(F.array_intersect("held", "wanted")) * F.lit(2.0) / (F.col("size") + F.size("wanted"))
    best = (found.withColumn("dice", dice).where(F.col("dice") >= threshold)
            .groupBy("id", "tag", "kind", "unit")
            .agg(F.min(F.struct((-F.col("dice")).alias("less"), "license", "part")).alias("m")))
    return best.select(F.col("id").alias(id_col), "kind", "unit", "m.license", "m.part",
                       (-F.col("m.less")).alias("dice"))
