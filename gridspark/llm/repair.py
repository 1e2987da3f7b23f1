"""Repair of conversation structure: the cheapest edits that give a sequence of
roles ``(system? (user assistant)+)?``, and of those the least edit string.

Edits are Keep (0), Rerole to user or assistant (1), Delete (2; required for blank
and duplicate rows) and Insert of an empty user or assistant turn (5); a truncated
row that stays adds 5. A node is (row, state), the state being what the sequence
needs next. The cost dynamic program runs from the last row to the first. On the
optimal arcs that it leaves, nodes are ranked by their least edit strings of 1, 2,
4, ... edits: a node's rank and that of the node 2^k edits on (its doubled pointer)
give the rank by 2^(k+1) edits. From one node an edit's initial fixes its arc, so
one pointer for each power is enough. The ranks select the least of several paths,
the doubled pointers list the nodes on it.

A conversation is ordered by a range partitioning over (conversation, turn, role,
text), so it may span many tasks, and is worked on in segments of at most
``SEGMENT`` rows of one partition. A segment is first solved for each state it may
be entered and left in: 16 costs, and the order of the strings between them. The few
numbers of each segment decide its states on the least path; then each segment's
path is read off.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.common import ASCII_SPACE, ship_code, written

SEGMENT = 8192
FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
_START, _SYSTEM, _USER, _ASSISTANT = range(4)     # what was put out last
_INSERT_TO = np.array([_USER, _USER, _ASSISTANT, _USER])
_DELETE, _INSERT, _KEEP, _REROLE = 1, 2, 3, 4     # in the ASCII order of their initials; 0 is the end
_END = np.array([0, 10, 5, 0])                    # cost of the inserts that complete a sequence, by state
_LEGAL = [1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2]        # su, ua, au
_LETTER = np.array(["", "D", "I", "K", "R"])
_FAR = 1 << 50                                    # no path; a sum of two is still a long


def classified(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, copies, fault): equal rows as one row with their number.
    ``fault`` is that of the first copy; later copies of a row are duplicates (of a
    blank row: blank)."""
    rows = (turns.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                         F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                         F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
            .groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("said", F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)))
    first = (rows.groupBy(F.col("conv").alias("c"), F.col("said").alias("s"))
             .agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least"), F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > 1).drop("n"))
    seen = F.col("s").isNotNull() & ~F.when(F.col("none"), F.col("turn").isNull()).otherwise(
        F.col("turn").eqNullSafe(F.col("least")))
    body = F.rtrim("text", F.lit(ASCII_SPACE))
    fault = (F.when(body == "", BLANK).when(seen, DUPLICATE)
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    return (rows.join(first, rows["conv"].eqNullSafe(first["c"]) & (rows["said"] == first["s"]), "left")
            .select("conv", "turn", "role", "text", "copies", fault.alias("fault")))


class _Solved:
    """Costs, optimal arcs and ranks of the nodes of several segments, each for one
    or more states to be left in. ``initial`` is a row's role initial as a number
    (1 s, 2 u, 3 a, 0 other); rows of a segment follow each other from ``begin``."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, copies: np.ndarray, begin: np.ndarray,
                 targets: np.ndarray):
        n, s, t = len(initial), len(begin), targets.shape[1]
        size = np.diff(np.append(begin, n))
        # nodes (row, target, state) in row order, then for each segment its ends
        cost = np.full((n + s, t, 4), _FAR, dtype=np.int64)
        arc = np.zeros((n + s, t, 4), dtype=np.int64)
        node = np.arange((n + s) * t * 4, dtype=np.int64).reshape(n + s, t, 4)
        to = node.copy()
        at = np.arange(s)
        cost[n + at[:, None], np.arange(t)[None], targets] = 0
        forced = (fault == BLANK) | (fault == DUPLICATE)
        stays = np.where(forced, _FAR, np.where(fault == TRUNCATED, 5, 0))
        drop = np.where(forced, copies * 2, 2)
        # further copies are duplicates: they go, whatever becomes of the first
        more = np.where(forced, 0, (copies - 1) * 2)
        for back in range(1, int(size.max(initial=0)) + 1):
            seg = np.flatnonzero(size >= back)
            row = begin[seg] + size[seg] - back
            after = np.where(back == 1, n + seg, row + 1)
            then, k, base = cost[after], initial[row], more[row]
            choice = np.full((5, len(seg), t, 4), _FAR, dtype=np.int64)
            target = np.zeros((5, len(seg), t, 4), dtype=np.int64)
            choice[_DELETE] = then + (drop[row] + base)[:, None, None]
            target[_DELETE] = node[after]
            for state in range(4):
                role = _INSERT_TO[state]
                choice[_REROLE, :, :, state] = then[:, :, role] + (stays[row] + base + 1)[:, None]
                target[_REROLE, :, :, state] = node[after, :, role]
                kept = np.where(k == role, role, np.where((k == 1) & (state == _START), _SYSTEM, -1))
                ok = np.flatnonzero(kept >= 0)
                choice[_KEEP, ok, :, state] = then[ok, :, kept[ok]] + (stays[row] + base)[ok, None]
                target[_KEEP, ok, :, state] = node[after[ok], :, kept[ok]]
            least = choice[[_DELETE, _KEEP, _REROLE]].min(axis=0)
            # user and assistant lead to each other by inserts, the others to user; two in a row are enough
            in_turn = least.copy()
            in_turn[..., _USER] = np.minimum(least[..., _USER], 5 + least[..., _ASSISTANT])
            in_turn[..., _ASSISTANT] = np.minimum(least[..., _ASSISTANT], 5 + least[..., _USER])
            choice[_INSERT] = 5 + in_turn[..., _INSERT_TO]
            target[_INSERT] = node[row][..., _INSERT_TO]
            total = np.minimum(choice.min(axis=0), _FAR)
            best = (choice == total[None]).argmax(axis=0)     # the first in ASCII order
            cost[row] = total
            arc[row] = np.where(total < _FAR, best, 0)
            to[row] = np.where(total < _FAR, np.take_along_axis(target, best[None], 0)[0], to[row])
        self.cost, self.arc = cost, arc
        #: pointers[k] leads 2^k edits on; rank is by the least strings of all edits
        self.pointers, self.rank = [to.ravel()], arc.ravel()
        while True:
            ahead = self.pointers[-1]
            _, self.rank = np.unique(self.rank * (int(self.rank.max(initial=0)) + 1) + self.rank[ahead], return_inverse=True)
            on = ahead[ahead]
            if np.array_equal(on, ahead):
                break
            self.pointers.append(on)

    def nodes_on_path(self, start: np.ndarray) -> np.ndarray:
        """All nodes with an edit on the paths from ``start``, in order of rows; the
        pointers double the stretch known, from the longest to the shortest."""
        known = start
        for ahead in reversed(self.pointers):
            known = np.unique(np.concatenate((known, ahead[known])))
        return known[self.arc.ravel()[known] > 0]


def _initials(roles: pd.Series) -> np.ndarray:
    return roles.str[:1].map({"s": 1, "u": 2, "a": 3}).fillna(0).to_numpy(dtype=np.int64)


def _segments(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Numbers the segments of a sorted partition. A segment's first row carries its
    numbers (null on other rows): for each state entered and left the cost, then the
    place of its least string among those from the same state, then the adjacent
    role initials that are not legal and the first and last initial."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for begin in range(0, len(batch), most):
            rows = batch.iloc[begin:begin + most].reset_index(drop=True)
            conv = rows["conv"].to_numpy(dtype=object)
            new = np.append(True, conv[1:] != conv[:-1])
            first = np.flatnonzero(new)
            s, size = len(first), np.diff(np.append(first, len(rows)))
            initial, copies = _initials(rows["role"]), rows["copies"].to_numpy()
            solved = _Solved(initial, rows["fault"].to_numpy(), copies, first, np.tile(np.arange(4), (s, 1)))
            costs = solved.cost[first].transpose(0, 2, 1).reshape(s, 16)     # [segment, entered, left]
            places = solved.rank.reshape(-1, 4, 4)[first].transpose(0, 2, 1).argsort(2).argsort(2).reshape(s, 16)
            pair = np.append(0, initial[:-1] * 4 + initial[1:])
            bad = np.where(new, 0, ~np.isin(pair, _LEGAL)) + copies - 1
            numbers = np.column_stack((costs, places, np.add.reduceat(bad, first), initial[first], initial[first + size - 1]))
            column = np.empty(len(rows), dtype=object)
            column[first] = list(numbers)
            yield rows.assign(segment=(part << 32) + n + np.cumsum(new) - 1,
                              at=np.arange(len(rows)) - np.repeat(first, size), numbers=column)
            n += s


def _states(numbers: np.ndarray) -> tuple[int, list[int], list[int]]:
    """The least cost of a conversation of these segments, and the states in which
    its least path enters and leaves each."""
    togo, choice = _END, []
    for line in numbers[::-1]:
        total = line[:16].reshape(4, 4) + togo[None]
        best = total.min(axis=1)
        choice.append(np.where(total == best[:, None], line[16:32].reshape(4, 4), 99).argmin(axis=1))
        togo = best
    states = [_START]
    for c in reversed(choice):
        states.append(int(c[states[-1]]))
    return int(togo[_START]), states[:-1], states[1:]


def _chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From segments sorted by conversation: the states each is entered and left in,
    whether it is the last, the conversation's cost and illegal pairs. The numbers of
    one conversation are held (35 for each segment, of which a string of edits that
    fits a cell has some 500 000 at most)."""
    def done(held: list) -> list[tuple]:
        numbers = np.array([h[2] for h in held], dtype=np.int64)
        cost, enter, leave = _states(numbers)
        across = numbers[:-1, 34] * 4 + numbers[1:, 33]
        illegal = int(numbers[:, 32].sum() + (~np.isin(across, _LEGAL)).sum())
        return [(h[1], -1, e, o, i + 1 == len(held), cost, illegal)
                for i, (h, e, o) in enumerate(zip(held, enter, leave))]

    columns, held = ["segment", "at", "enter", "leave", "last", "cost", "illegal"], []
    for batch in batches:
        out = []
        for row in zip(batch["conv"], batch["segment"], batch["numbers"]):
            if held and held[0][0] != row[0]:
                out += done(held)
                held = []
            held.append(row)
        yield pd.DataFrame(out, columns=columns)
    if held:
        yield pd.DataFrame(done(held), columns=columns)


def _complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by segment, each segment headed by its states (``at`` -1), in parts
    of whole segments."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
        cut = int(np.flatnonzero(batch["at"].to_numpy() == -1)[-1])
        if cut:
            yield batch.iloc[:cut]
        rest = batch.iloc[cut:]
    if rest is not None:
        yield rest


def _read_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits on each segment's least path and the turns they put out."""
    names = {_USER: "user", _ASSISTANT: "assistant"}
    for part in _complete(batches):
        head = part["at"].to_numpy() == -1
        size = np.diff(np.append(np.flatnonzero(head), len(part))) - 1
        told = {c: part[c].to_numpy()[head].astype(np.int64) for c in ("enter", "leave", "last", "cost", "illegal")}
        rows = part[~head].reset_index(drop=True)
        first = np.cumsum(size) - size
        copies, fault = (rows[c].to_numpy().astype(np.int64) for c in ("copies", "fault"))
        solved = _Solved(_initials(rows["role"]), fault, copies, first, told["leave"][:, None])
        path = solved.nodes_on_path(first * 4 + told["enter"])
        row, arc = path // 4, solved.arc.ravel()[path]
        takes = arc != _INSERT                       # one node for each row takes it
        own, after = arc[takes], solved.pointers[0][path[takes]] % 4
        inserts = np.bincount(row[~takes], minlength=len(rows))
        before = np.append(0, after[:-1])
        before[first] = told["enter"]
        ends = dict(zip((first + size - 1).tolist(), zip(told["last"], told["leave"])))
        edits, turns = [], []
        for i, (role, text) in enumerate(zip(rows["role"], rows["text"])):
            out, state = [], before[i]
            for _ in range(inserts[i]):
                state = _INSERT_TO[state]
                out.append({"role": names[state], "text": ""})
            if own[i] == _KEEP:
                out.append({"role": role, "text": text})
            elif own[i] == _REROLE:
                out.append({"role": names[after[i]], "text": text})
            edit = "I" * inserts[i] + _LETTER[own[i]] + "D" * (copies[i] - 1)
            last, state = ends.get(i, (0, 0))
            for _ in range(_END[state] // 5 if last else 0):
                state = _INSERT_TO[state]
                out.append({"role": names[state], "text": ""})
                edit += "I"
            edits.append(edit)
            turns.append(out)
        yield rows[["conv", "turn", "copies", "fault", "segment", "at"]].assign(
            cost=np.repeat(told["cost"], size), illegal=np.repeat(told["illegal"], size), edits=edits, turns=turns)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row for each group of equal rows of a conversation, in the order (segment,
    at): ``conv_col``, ``turn_col``, ``copies``, ``fault`` of the first copy (0 none, 1
    blank, 2 duplicate, 3 truncated; further copies are blank or duplicates), ``edits``
    (initials of the edits, for each copy one, inserts before and at the end after),
    ``turns`` (role and text of the repaired turns put out here), and the
    conversation's ``cost`` and ``illegal`` (adjacent role initials not su, ua or au).

    Rows stand in the order of turn (nulls first), then role and text. Defined cases:
    a null role or text is one space; a null conversation id is a conversation of its
    own; a role counts by its first letter, so unknown roles must be re-roled or
    deleted; blank means nothing but ASCII white space; equal rows are copies, the
    later ones duplicates; other columns are ignored; an empty table gives no rows."""
    spark = turns.sparkSession
    ship_code(spark)
    conv_type, turn_type = turns.schema[conv_col].dataType, turns.schema[turn_col].dataType
    rows = classified(turns, conv_col, turn_col, role_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    cut = (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
           .withColumn("turn", F.col("turn").cast("string"))
           .mapInPandas(partial(_segments, most=segment), "conv string, turn string, role string, text string, copies long, fault int, "
                                   "segment long, at int, numbers array<bigint>"))
    cut = written(cut, "repair-segments")
    states = (cut.where("at = 0").select("conv", "segment", "numbers")
              .repartition("conv").sortWithinPartitions("conv", "segment")
              .mapInPandas(_chosen, "segment long, at int, enter int, leave int, last boolean, cost long, illegal long"))
    both = cut.drop("numbers").unionByName(states, allowMissingColumns=True)
    out = both.repartition("segment").sortWithinPartitions("segment", "at").mapInPandas(
        _read_off, "conv string, turn string, copies long, fault int, segment long, at int, cost long, illegal long, "
                   "edits string, turns array<struct<role: string, text: string>>")
    return out.select(F.col("conv").cast(conv_type).alias(conv_col), F.col("turn").cast(turn_type).alias(turn_col),
                      *[c for c in out.columns if c not in ("conv", "turn")])
