"""Line dedup: drop lines that many documents share.

Lines are exploded with their position, normalised and hashed; one aggregate
counts the distinct documents of each hash; lines of hashes over the threshold
go, except in the largest document id that holds them; what stays is put
together again by position. Only DataFrame functions, no Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import ASCII_SPACE, ascii_lower, free_name


def line_key(line: Column) -> Column:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_length: int = 20, min_docs: int = 3,
                      n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with ``text_col`` reduced to the lines that stay, plus the number
    of lines before (``n_lines``) and of those dropped (``n_dropped``).

    A key of at least ``min_length`` code points held by at least ``min_docs``
    distinct ids loses all its lines except those in the largest id holding it.

    Defined cases: null or empty text is one empty line (the result is the empty
    text); a document that loses every line keeps its row with the empty text;
    rows with one id count as one document, and a null id is one document too,
    smaller than any other; repeated rows are all kept, each reduced alike; other
    columns pass through, except that columns already called ``n_lines`` or
    ``n_dropped`` are replaced. An empty table gives an empty result.

    Scale: a key's rows are first reduced to one per document on the map side,
    then counted with partial aggregates, so a line of a third of all documents
    costs one row per task there. The table of shared keys is joined back to the
    lines by an ordinary join whose sides are both shuffled for it, so adaptive
    execution splits a hot key. The text itself is shuffled once, by document.
    """
    tag = free_name(docs, "_text_hash")
    tagged = docs.withColumn(tag, F.xxhash64(F.col(text_col)))
    lines = tagged.select(
        F.col(id_col).alias("id"), F.col(tag).alias("tag"),
        F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    # 96 bits: two keys that differ never meet in practice
    keyed = (lines.withColumn("key", line_key(F.col("line")))
             .where(F.length("key") >= min_length)
             .select("id", "tag", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")))
    shared = (keyed.select("h1", "h2", "id").distinct()
              .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
              .where(F.col("n") >= min_docs)
              # one more key column than the aggregate is partitioned by, so that the
              # join shuffles this side anew and a hot key of the other side can be split
              .select(F.xxhash64("h1", "h2").alias("j"), "h1", "h2", "keep"))
    dropped = (keyed.withColumn("j", F.xxhash64("h1", "h2"))
               .join(shared, ["j", "h1", "h2"])
               .where(~F.col("id").eqNullSafe(F.col("keep")))
               .groupBy(F.col("id").alias("_drop_id"), F.col("tag").alias("_drop_tag"))
               .agg(F.collect_list("pos").alias("_drop_pos")))
    joined = tagged.join(dropped, tagged[id_col].eqNullSafe(dropped["_drop_id"])
                         & (tagged[tag] == dropped["_drop_tag"]), "left")
    arr = _lines(tagged[text_col])
    gone, total = F.col("_drop_pos"), F.size(arr)
    stay = F.array_except(F.sequence(F.lit(0), total - 1), gone)
    text = F.when(gone.isNull(), F.coalesce(tagged[text_col], F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(arr, i)), "\n"))
    out = [text.alias(c) if c == text_col else tagged[c] for c in docs.columns
           if c not in (n_lines, n_dropped)]
    return joined.select(
        *out, total.cast("long").alias(n_lines),
        F.when(gone.isNull(), F.lit(0)).otherwise(total - F.size(stay)).cast("long").alias(n_dropped))
