"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string.
Successive turn prefixes are rendered and compared: what a prefix adds to the
one before is the new turn's span; a template whose output for a longer prefix
does not start with the output for the shorter one rewrites history, which is
reported. Where a turn's text lies inside its span is found the same way, by
rendering a marker in its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridspark.llm.common import ship_code

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

MARK = "\ue000mark\ue001"


def escape(text: str) -> str:
    """Reversible; the result holds no ``<``, so no marker of the template."""
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    meant = {"l": "<", "n": "\n"}
    return re.sub(r"\\(.)", lambda m: meant.get(m[1], m[1]), text, flags=re.S)


def tagged_template(turns: Sequence[Turn]) -> str:
    """``<turn>role``, a newline, the text, ``</turn>`` and a newline for each
    turn; role and text escaped, newlines in a role too."""
    return "".join("<turn>" + escape(role).replace("\n", "\\n") + "\n" + escape(text) + "</turn>\n"
                   for role, text in turns)


def parse_tagged(formatted: str) -> list[Turn]:
    """The turns that ``tagged_template`` rendered."""
    turns = []
    for part in formatted.split("</turn>\n")[:-1]:
        role, _, text = part.removeprefix("<turn>").partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def locate(template: Template, turns: Sequence[Turn]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], int | None]:
    """(output, span of each turn, span of each turn's text, first rewriting turn).

    The last is the index of the first turn whose prefix does not start with the
    output of the prefix before (None for a stable template); from that turn on
    all spans are (-1, -1), since positions in earlier outputs no longer hold. A
    text span is (-1, -1) where the template does not show the text as one
    stretch in its turn's span."""
    before, spans, texts = template([]), [], []
    for i in range(len(turns)):
        now = template(turns[:i + 1])
        if not now.startswith(before):
            rest = len(turns) - i
            return template(turns), [(-1, -1)] * len(turns), [(-1, -1)] * len(turns), len(turns) - rest
        role, text = turns[i]
        probe = template([*turns[:i], (role, MARK)])
        at, end = probe.find(MARK, len(before)), len(now)
        after = len(probe) - at - len(MARK)
        found = (probe.count(MARK, len(before)) == 1 and probe[:at] == now[:at] and at + after <= end
                 and now.endswith(probe[at + len(MARK):]))
        spans.append((len(before), end))
        texts.append((at, end - after) if found else (-1, -1))
        before = now
    return before, spans, texts, None


def locate_long(template: Template, turns: Sequence[Turn], block: int = 64):
    """``locate`` for conversations of any length: prefixes are rendered within
    blocks of ``block`` turns, each after one turn of the block before as
    context, so the work grows with the length and not with its square.

    Blocks may only be shifted for a template whose turns do not depend on turns
    further back. That is tested, not assumed: the joined blocks must equal the
    whole rendering; otherwise every prefix is rendered in full."""
    if len(turns) <= block:
        return locate(template, turns)
    head, spans, texts, bad = locate(template, turns[:block])
    whole = template(turns)
    size = len(head)
    if bad is None and whole.startswith(head):
        for i in range(block, len(turns), block):
            context = turns[i - 1:i]
            out, s, t, bad = locate(template, [*context, *turns[i:i + block]])
            if bad is not None or not whole.startswith(out[s[0][1]:], size):
                break
            shift = size - s[0][1]
            spans += [(a + shift, b + shift) for a, b in s[1:]]
            texts += [(a + shift, b + shift) if a >= 0 else (a, b) for a, b in t[1:]]
            size += len(out) - s[0][1]
        else:
            if size == len(whole):
                return whole, spans, texts, None
    return locate(template, turns)


def format_conversations(rows: DataFrame, template: Template = tagged_template, id_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: the id, ``formatted`` (the template's output over
    its turns in order), ``turn_spans`` and ``text_spans`` (arrays of start and
    end, in code points), ``loss_mask`` (the text spans of the turns of
    ``loss_roles``) and ``rewritten_at`` (the first turn at which the template
    rewrites history, else null; then spans are -1 and the mask is empty).

    Defined cases: null role or text is the empty string; null turns come first;
    rows of one turn number are ordered by role, then text, and repeated rows stay;
    rows of null id form one conversation; extra columns are ignored; an empty
    table gives no rows.

    Scale: one aggregate gathers a conversation's rows; a conversation is one
    output row, so its rows must fit a task, its rendering is linear in its
    length for templates without long memory."""
    ship_code(rows.sparkSession)
    found = (rows.select(F.col(id_col).alias("id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
        .groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select(F.col("id").alias(id_col), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts")))
    pair = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([
        T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("formatted", T.StringType()),
        T.StructField("turn_spans", pair), T.StructField("text_spans", pair), T.StructField("loss_mask", pair),
        T.StructField("rewritten_at", T.LongType())])
    roles = frozenset(loss_roles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, who, said in zip(batch[id_col].astype(object).where(batch[id_col].notna(), None),
                                      batch["roles"], batch["texts"]):
                formatted, spans, texts, bad = locate_long(template, list(zip(who, said)))
                row = [{"start": a, "end": b} for a, b in texts]
                out.append((key, formatted, [{"start": a, "end": b} for a, b in spans], row,
                            [] if bad is not None else [x for x, r in zip(row, who) if r in roles and x["start"] >= 0],
                            bad))
            frame = pd.DataFrame(out, columns=schema.names)
            frame["rewritten_at"] = frame["rewritten_at"].astype("Int64")
            yield frame

    return found.mapInPandas(run, schema)
