"""The registered queries of this subpackage and their DuckDB statements.

Each query runs one operator over its whole table and derives the digest
columns of the contract from the operator's real output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.chat import format_conversations, parse_tagged, unescape
from gridspark.llm.common import table
from gridspark.llm.decontaminate import find_overlaps
from gridspark.llm.license_scan import BLANK_LINES, scan, size_bounds, template_parts
from gridspark.llm.license_templates import TEMPLATES
from gridspark.llm.line_dedup import drop_shared_lines
from gridspark.llm.negatives import hard_negatives
from gridspark.llm.packing import pack
from gridspark.llm.passages import repeated_passages
from gridspark.llm.prefix_counts import prefix_tokens, with_token_changes
from gridspark.llm.repair import repair
from gridspark.llm.simhash import near_duplicates
from gridspark.llm.suffix_dedup import repeated_bytes
from gridspark.llm.topk import top_k
from gridspark.llm.toxicity import fit, learnable, with_score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return wrap


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine (and on executors)."""
    import public_tokenizers
    return public_tokenizers.path(name)


_SAMPLE = "\\### Assistant: </turn> ok"


def _hex(parts: Iterator[str]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode("utf-8"))
    return h.hexdigest()


def _chat_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text, mask in zip(batch["conv_id"], batch["formatted"], batch["loss_mask"]):
            turns = parse_tagged(text)
            loss = [unescape(text[m["start"]:m["end"]]) for m in mask]
            rows.append((key, len(turns), _hex(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), _hex(loss),
                         len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                          "formatted_chars"])


_SHOWN = "replace(replace({}, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l')"


@query("op1_chat_formatting", f"""
WITH s AS (SELECT chr(92) || '### Assistant: </turn> ok' AS text),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', text FROM s UNION ALL SELECT -7, 1, 'assistant', text FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(replace({_SHOWN.format('role')}, chr(10), chr(92) || 'n'))
                + length({_SHOWN.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def op1_chat_formatting(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAMPLE).alias("text"))
    out = format_conversations(turns.unionByName(sample))
    return out.select("conv_id", "formatted", "loss_mask").mapInPandas(
        _chat_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                       "formatted_chars long")


@query("op2_substring_dedup")
def op2_substring_dedup(spark, d):
    return repeated_passages(table(spark, d, "documents"))


@query("op3_packing")
def op3_packing(spark, d):
    out = pack(table(spark, d, "documents"), tokenizer_path(), max_len=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                      "offset")


@query("op4_decontamination")
def op4_decontamination(spark, d):
    return find_overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op5_simhash")
def op5_simhash(spark, d):
    out = near_duplicates(table(spark, d, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", "fingerprint", "component_id")


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ",\n".join(
        f"({quoted(n)}, {p}, {size_bounds(len(g), 0.8)[0]}, {size_bounds(len(g), 0.8)[1]}, [{', '.join(map(quoted, g))}])"
        for n, p, g in template_parts(TEMPLATES))
    blank = BLANK_LINES.replace("\\x0B", "\\v")
    return f"""
WITH t(license, part, low, high, wanted) AS (VALUES {rows}),
d AS (SELECT doc_id, text, regexp_split_to_array(text, '{blank}') AS ps, string_split(text, chr(10)) AS ls
      FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'line' AS kind, unnest(range(len(ls))) AS unit, unnest(ls) AS body FROM d
      UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(ps))), unnest(ps) AS p FROM d)
                WHERE contains(p, chr(10))
      UNION ALL SELECT doc_id, 'text', 0, text FROM d WHERE len(ps) > 1),
n AS (SELECT doc_id, kind, unit,
             string_split(trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
b AS (SELECT doc_id, kind, unit, CASE WHEN len(w) = 1 THEN w ELSE
             list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS held
      FROM n WHERE w <> ['']),
m AS (SELECT doc_id, kind, unit, license, part,
             2.0::DOUBLE * len(list_intersect(held, wanted)) / (len(held) + len(wanted)) AS dice
      FROM b JOIN t ON len(held) BETWEEN low AND high)
SELECT doc_id, kind, CAST(unit AS INTEGER) AS unit, license, part, dice FROM m WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, kind, unit ORDER BY dice DESC, license, part) = 1"""


@query("op6_license_scan", _license_sql())
def op6_license_scan(spark, d):
    return scan(table(spark, d, "documents"), threshold=0.8)


@query("op7_toxicity")
def op7_toxicity(spark, d):
    docs = table(spark, d, "documents")
    model = fit(docs, table(spark, d, "labels"))
    return with_score(docs.select("doc_id", "text"), model).select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, d):
    out = repeated_bytes(table(spark, d, "documents"), length=100)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_exact_topk", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op10_exact_topk(spark, d):
    return top_k(table(spark, d, "embeddings"), k=5, query_every=50, scale=256)


#: Lower-casing of A-Z and the strip set, as DuckDB expressions.
_SPACE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op9_line_dedup", f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACE}), {_LOWER}) AS line_key FROM l),
r AS (SELECT line_key, max(doc_id) AS keep FROM k WHERE length(line_key) >= 20
      GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, r.keep IS NOT NULL AND k.doc_id <> r.keep AS gone
      FROM k LEFT JOIN r ON k.line_key = r.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op9_line_dedup(spark, d):
    out = drop_shared_lines(table(spark, d, "documents"), min_length=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op12_token_counts")
def op12_token_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = with_token_changes(docs, tokenizer_path()).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        prefix_tokens("token_changes", F.length("text")).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the contract's faults, by a checksum of id and turn."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    text = F.coalesce("text", F.lit(" "))
    return (turns.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
            .select("conv_id", "turn",
                    F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", ""))
                    .otherwise(text).alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def _repair_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of rows sorted by conversation and place; only the edits of the
    conversation in hand are held."""
    columns = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    conv, digest, audit, counts, started = None, None, [], [], False

    def line():
        return (conv, *counts, "".join(audit), digest.hexdigest())

    for batch in batches:
        out = []
        for key, copies, fault, illegal, cost, edits, turns in zip(
                batch["conv_id"], batch["copies"], batch["fault"], batch["illegal"], batch["cost"], batch["edits"],
                batch["turns"]):
            if digest is None or key != conv:
                if digest is not None:
                    out.append(line())
                conv, digest, audit, counts, started = key, hashlib.sha256(), [], [0, 0, 0, illegal, cost], False
            counts[0] += copies if fault == 1 else 0
            counts[1] += copies if fault == 2 else 0 if fault == 1 else copies - 1
            counts[2] += fault == 3
            audit.append(edits)
            for t in turns:
                digest.update(f"{chr(10) * started}{t['role']}:{t['text']}".encode())
                started = True
        yield pd.DataFrame(out, columns=columns)
    if digest is not None:
        yield pd.DataFrame([line()], columns=columns)


def _repair_sql() -> str:
    def least(*xs: str) -> str:
        return f"list_sort(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))[1]"

    def put(cost: str, edit: str, x: str, shown: str = "") -> str:
        return f"struct_pack(cost := {x}.cost + {cost}, audit := '{edit}' || {x}.audit, shown := {shown}{x}.shown)"

    def insert(x: str, role: str) -> str:
        return put("5", "I", x, f"['{role}:'] || ")

    space = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    takes = []     # for each state: the best way to take a row; states are places in a list
    for state, (needs, keeps) in enumerate([("user", "WHEN 's' THEN 2 WHEN 'u' THEN 3"), ("user", "WHEN 'u' THEN 3"),
                                            ("assistant", "WHEN 'a' THEN 4"), ("user", "WHEN 'u' THEN 3")], 1):
        kept = f"CASE b.i {keeps} END"
        keep = put("b.extra", "K", f"v[{kept}]", "[b.role || ':' || b.text] || ")
        rerole = put("b.extra + 1", "R", f"v[{3 if needs == 'user' else 4}]", f"['{needs}:' || b.text] || ")
        takes.append(least(put("2", "D", f"v[{state}]"), f"CASE WHEN NOT b.forced AND {kept} > 0 THEN {keep} END",
                           f"CASE WHEN NOT b.forced THEN {rerole} END"))
    return f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
        lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1))))) % 20 AS kind FROM o),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM c)),
n AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS i,
             lag(left(role, 1)) OVER w AS before, rtrim(text, {space}) AS body
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, body = '' AS blank,
             body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS duplicate FROM n),
b AS (SELECT *, blank OR duplicate AS forced,
             CASE WHEN NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM f),
dp(conv_id, r, v) AS (
  SELECT DISTINCT conv_id, n + 1, [
    struct_pack(cost := 0::BIGINT, audit := '', shown := []::VARCHAR[]),
    struct_pack(cost := 10::BIGINT, audit := 'II', shown := ['user:', 'assistant:']),
    struct_pack(cost := 5::BIGINT, audit := 'I', shown := ['assistant:']),
    struct_pack(cost := 0::BIGINT, audit := '', shown := []::VARCHAR[])] FROM b
  UNION ALL
  SELECT conv_id, r, [{least('t[1]', insert('u', 'user'))}, {least('t[2]', insert('u', 'user'))},
                      {least('t[3]', insert('a', 'assistant'))}, {least('t[4]', insert('u', 'user'))}]
  FROM (SELECT *, {least('t[3]', insert('t[4]', 'assistant'))} AS u, {least('t[4]', insert('t[3]', 'user'))} AS a
        FROM (SELECT b.conv_id, b.r, [{", ".join(takes)}] AS t
              FROM dp JOIN b ON b.conv_id IS NOT DISTINCT FROM dp.conv_id AND b.r = dp.r - 1))),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
             count(*) FILTER (WHERE extra > 0) AS truncated,
             count(*) FILTER (WHERE r > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM b GROUP BY conv_id),
x AS (SELECT conv_id, v[1] AS best FROM dp WHERE r = 1),
g AS (SELECT DISTINCT conv_id FROM conversations)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.shown, chr(10)), '')) AS repaired_sha256
FROM g LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM g.conv_id"""


@query("op13_conversation_repair", _repair_sql())
def op13_conversation_repair(spark, d):
    turns = table(spark, d, "conversations")
    rows = damaged(turns)
    found = (repair(rows).withColumn("conv_id", F.col("conv_id").cast("string")).repartition("conv_id")
             .sortWithinPartitions("conv_id", "segment", "at")
             .mapInPandas(_repair_digests, "conv_id string, blank long, duplicate long, truncated long, illegal long, "
                                           "cost long, audit string, repaired_sha256 string"))
    gaps = rows.groupBy(F.col("conv_id").alias("c")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    every = turns.select("conv_id").distinct()
    out = (every.join(gaps, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
           .join(found.withColumnRenamed("conv_id", "c"), F.col("conv_id").cast("string").eqNullSafe(F.col("c")), "left"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op11_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
             CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
f AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM p WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT f.*, p.other_id AS negative_id, p.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY f.anchor_id, positive_id ORDER BY p.score DESC, p.other_id) AS INTEGER) AS rank
      FROM f JOIN p ON p.anchor_id = f.anchor_id AND NOT p.same
       AND 100 * p.score BETWEEN 30 * f.positive_score AND 90 * f.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op11_hard_negatives(spark, d):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, d, "embeddings").withColumn("label", moved))
