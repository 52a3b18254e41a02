"""Conversation structure repair: Wagner-Fischer alignment of a conversation's turns with the alternating grammar.

A good conversation's role initials are `(s?(ua)+)?`. Turns are aligned to the strings of that grammar: Keep costs nothing,
Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2, and a truncated turn that stays 1;
blank and repeated turns must go. Strings of all lengths that end alike share their ends, so one table (turns left, symbols
left) holds the alignment to each feasible length; Ukkonen's band, from the cost of a plain repair, bounds how far the
symbols left may differ from the turns left. Of the cheapest alignments of all lengths the one whose backtraced audit
(initials of its edits) is ASCII-least wins.

Conversations of over BLOCK turns are aligned block by block: what lies behind a block counts by the cheapest cost from
each of the four places in the grammar that it may be left in (nothing yet, after s, after u, after a), so time grows with
the turns, not with their square, and a table's size is bounded. Inserts belong to the block of the turn after them.

Defined results: a null conv_id is one conversation; turns come by number, nulls first, ties by role and text (code
points); null roles and texts count as one space; empty texts are blank; repeated rows are repeated turns, of which the
first stays; a role other than s..., u..., a... can only be changed or deleted; columns beside the named ones are
ignored, whatever their names; an empty table gives an empty result. A conversation's turns meet in one row, as the words
of a document do: its result is one text.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import picked

#: The costs of edits, and white space.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK = r"[^\x20\x09-\x0D]"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"
#: Turns aligned at once.
BLOCK = 512
FAR = 1 << 28
#: Places in the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDED = (0, FAR, FAR, 0)


class Block:
    """Alignments of a block of turns. codes: a letter for each turn, `d` if it must go, else its role's initial (`o` for
    other roles), a capital if it is truncated. behind: the least cost from each place in the grammar to the end."""

    def __init__(self, codes: str, behind: tuple[int, ...] = ENDED, last: bool = True):
        self.codes, self.behind, self.last = codes, behind, last
        self.extra = [TRUNCATED * c.isupper() for c in codes]
        self.initial = codes.lower()
        cost = max(self._plain(0), self._plain(1)) + 5  # how much `behind` may differ between places
        self.low, self.high = -(cost // DELETE), cost // INSERT
        self.tables = {x: self._table(x) for x in (USER, ASSISTANT) if behind[x] < FAR}

    def _plain(self, expected: int) -> int:
        """Cost of keeping turns as they are with inserts between two of one role: the incumbent."""
        cost = 0
        for c, extra in zip(self.initial, self.extra, strict=True):
            if c == "d":
                cost += DELETE
                continue
            cost += extra
            if c in "ua":
                cost += 0 if "ua"[expected] == c else INSERT
                expected = 1 - "ua".index(c)
            else:
                cost += REROLE
                expected = 1 - expected
        return cost + INSERT

    def _table(self, end: int) -> np.ndarray:
        """table[i, d - low]: least cost of the turns from i on and n - i + d symbols of the alternation that ends in `end`."""
        n, width = len(self.codes), self.high - self.low + 1
        table = np.full((n + 1, width), FAR, np.int32)
        steps = INSERT * np.arange(width, dtype=np.int32)
        left = np.arange(self.low, self.high + 1)
        if self.last:
            table[n] = np.where(left >= 0, np.minimum(INSERT * left + self.behind[end], FAR), FAR)
        else:
            table[n, -self.low] = self.behind[end]
        for i in range(n - 1, -1, -1):
            left = left + 1
            after = table[i + 1]
            row = np.append(after[1:], FAR) + DELETE
            if self.initial[i] != "d":
                odd = "?sua"[end]
                first, second = (self.swap(i, odd), self.swap(i, "u" if odd == "a" else "a"))
                row = np.minimum(row, after + np.where(left & 1, first, second))
            row = np.minimum.accumulate(row - steps) + steps
            table[i] = np.where((left >= 0) & (row < FAR), row, FAR)
        return table

    def swap(self, i: int, symbol: str) -> int:
        """Cost of turn i as `symbol`."""
        return self.extra[i] + (0 if self.initial[i] == symbol else REROLE)

    def at(self, end: int, i: int, left: int) -> int:
        d = left - (len(self.codes) - i) - self.low
        return int(self.tables[end][i, d]) if 0 <= d < self.tables[end].shape[1] else FAR

    def ends(self, i: int, place: int) -> list[tuple[int, int, int]]:
        """(cost, end, symbols) of each feasible length from turn i and a place on; end is the place itself if no symbol
        follows."""
        n = len(self.codes)
        out = [(DELETE * (n - i) + self.behind[place], place, 0)]
        for end, table in self.tables.items():
            odd = (end == ASSISTANT) == (place == USER)
            lengths = n - i + np.arange(self.low, self.high + 1)
            found = np.flatnonzero((lengths > 0) & ((lengths & 1) == odd) & (table[i] < FAR))
            best = table[i][found].min(initial=FAR)
            out += [(int(best), end, int(lengths[k])) for k in found[table[i][found] == best]]
        return out

    def starts(self, place: int) -> list[tuple[int, int, int, int]]:
        """(cost, turns before a kept system turn or -1, end, symbols) of the feasible alignments from a place."""
        out = [(cost, -1, end, k) for cost, end, k in self.ends(0, place)]
        if place == NONE:
            for i, c in enumerate(self.initial):
                if DELETE * i > min(x[0] for x in out):
                    break
                if c == "s":
                    out += [(DELETE * i + self.extra[i] + cost, i, end, k) for cost, end, k in self.ends(i + 1, SYSTEM)]
        return out

    def cost(self, place: int) -> int:
        return min(FAR, min(x[0] for x in self.starts(place)))

    def walk(self, i: int, end: int, left: int) -> str:
        """The ASCII-least audit of a cheapest alignment from turn i to `left` symbols."""
        out, n = [], len(self.codes)
        while left and (i < n or self.last):
            here = self.at(end, i, left)
            symbol = "?sua"[end] if left & 1 else ("u" if end == ASSISTANT else "a")
            if i < n and self.at(end, i + 1, left) + DELETE == here:
                out.append("D")
                i += 1
            elif self.at(end, i, left - 1) + INSERT == here:
                out.append("I")
                left -= 1
            else:
                out.append("K" if self.initial[i] == symbol else "R")
                i, left = i + 1, left - 1
        return "".join(out) + "D" * (n - i)

    def best(self, place: int) -> tuple[str, int]:
        """The audit from a place on, and the place that it leaves the grammar in."""
        found = self.starts(place)
        least = min(x[0] for x in found)
        audits = [("D" * s + "K" * (s >= 0) + self.walk(s + 1, end, k), end) for cost, s, end, k in found if cost == least]
        return min(audits)


def align(codes: str) -> tuple[int, str]:
    """Least cost and ASCII-least audit of a conversation's turns (letters as in Block)."""
    starts = list(range(0, max(1, len(codes)), BLOCK))
    behind = [ENDED]
    for k in range(len(starts) - 1, 0, -1):
        block = Block(codes[starts[k] : starts[k] + BLOCK], behind[-1], k == len(starts) - 1)
        behind.append(tuple(block.cost(place) for place in range(4)))
    audits, place, total = [], NONE, 0
    for k, start in enumerate(starts):
        block = Block(codes[start : start + BLOCK], behind[len(starts) - 1 - k], k == len(starts) - 1)
        total = total if k else block.cost(NONE)
        audit, place = block.best(place)
        audits.append(audit)
    return total, "".join(audits)


@functools.lru_cache(10_000)
def repaired(codes: str) -> tuple[int, str, list[int], list[str | None]]:
    """cost, audit, and for each turn of the result the turn it was (-1: inserted) and its new role (None: its own)."""
    cost, audit = align(codes)
    turns, roles, at, user = [], [], 0, True
    for edit in audit:
        if edit != "D":
            kept = edit == "K"
            turns.append(-1 if edit == "I" else at)
            roles.append(None if kept else "user" if user else "assistant")
            if not (kept and codes[at].lower() == "s"):
                user = not user
        at += edit != "I"
    return cost, audit, turns, roles


def _repair(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repaired(c or "") for c in codes], columns=["cost", "audit", "turns", "roles"])


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired turns
    (array of role, text). gaps: turn numbers that lack between the least and the greatest; blank, duplicate, truncated:
    turns whose first fault that is; illegal: neighbours whose initials aren't su, ua or au."""
    held = picked(df, c=conv_col, n=turn_col, role=role_col, text=text_col)
    held = held.select("c", "n", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")]).repartition("c")
    again = F.row_number().over(Window.partitionBy("c", "role", "text").orderBy(F.col("n").asc_nulls_first())) > 1
    blank = ~F.col("text").rlike(BLANK)
    fault = F.when(blank, "blank").when(again, "duplicate").when(~F.col("text").rlike(WHOLE), "truncated")
    initial = F.substring("role", 1, 1)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    # Of equal rows the one that stays comes first.
    turn = F.struct(F.col("n").isNotNull().alias("k"), "n", "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False)).alias("again"), F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code).alias("code"))
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    whole = held.withColumn("fault", fault).groupBy("c").agg(F.sort_array(F.collect_list(turn)).alias("rows"), *[count(f) for f in ("blank", "duplicate", "truncated")], (F.max("n") - F.min("n") + 1).cast("long").alias("_span"))
    distinct = F.size(F.array_distinct(F.filter(F.transform("rows", lambda r: r["n"]), lambda n: n.isNotNull())))
    gaps = F.coalesce(F.col("_span") - distinct, F.lit(0)).cast("long").alias("gaps")
    initials = F.transform("rows", lambda r: F.substring(r["role"], 1, 1))
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice(initials, 2, F.size("rows")), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal")
    plan = F.pandas_udf(_repair, "cost long, audit string, turns array<int>, roles array<string>")(F.array_join(F.transform("rows", lambda r: r["code"]), ""))

    def made(at: Column, role: Column) -> Column:
        own = F.get(F.col("rows"), at)
        return F.struct(F.coalesce(role, own["role"]).alias("role"), F.when(at < 0, "").otherwise(own["text"]).alias("text"))

    done = whole.select("c", gaps, "blank", "duplicate", "truncated", illegal, "rows", plan.alias("plan"))
    turns = F.zip_with("plan.turns", "plan.roles", made).alias("repaired")
    return done.select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "plan.cost", "plan.audit", turns).withColumnRenamed("c", conv_col)
