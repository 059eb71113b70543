"""Sessions as streams: which blocks are replays, whether caching was seen, where requests leave the one before.

State is kept for each session (conversation) and bounded: the set of seen blocks is cleared at
SEEN entries, the request before is one list of ids. Batch forms of the same are in ``operators.dialog``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value of the results to match.
SEEN = 1024

OUTPUT = "conv_id bigint, req bigint, n_blocks bigint, n_replayed bigint, caching boolean, break_index bigint, break_kind string"
STATE = "seen array<string>, caching boolean, prev array<string>"


def attribute_break(prev: list[str], cur: list[str]) -> tuple[int, str] | None:
    """Where ``cur`` leaves ``prev``, and how; None if it only adds to it."""
    if cur[: len(prev)] == prev:
        return None
    i = next((i for i, (a, b) in enumerate(zip(prev, cur, strict=False)) if a != b), min(len(prev), len(cur)))
    if i == len(cur):
        return i, "evicted"
    stays, came = prev[i] in cur[i:], cur[i] in prev[i:]
    return i, {(True, True): "reordered", (True, False): "added", (False, True): "evicted", (False, False): "modified"}[stays, came]


def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Requests of one session in order of ``req``."""
    seen, caching, prev = (list(state.get[0] or ()), bool(state.get[1]), list(state.get[2] or ())) if state.exists else ([], False, [])
    known = set(seen)
    rows = []
    for r in pd.concat(batches).sort_values("req").itertuples():
        cur = list(r.blocks)
        brk = attribute_break(prev, cur) if prev else None
        rows.append((key[0], r.req, len(cur), sum(b in known for b in cur), caching, brk[0] if brk else None, brk[1] if brk else None))
        for b in cur:
            if b not in known:
                if len(known) >= SEEN:
                    known, seen = set(), []
                known.add(b)
                seen.append(b)
        caching, prev = caching or bool(r.saw_cache), cur
    state.update((seen, caching, prev))
    frame = pd.DataFrame(rows, columns=["conv_id", "req", "n_blocks", "n_replayed", "caching", "break_index", "break_kind"])
    yield frame.astype({"break_index": "Int64"})


def sessions(requests: DataFrame) -> DataFrame:
    """A stream of requests (conv_id, req, blocks, saw_cache) to one row of findings each."""
    return requests.groupBy("conv_id").applyInPandasWithState(follow, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def line_counts(lines: DataFrame, important: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of log lines (ts, line) to counts of lines and important lines a window; lines later than ``late`` are dropped."""
    own = lines.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return own.agg(F.count("*").alias("n"), F.count_if(F.col("line").rlike(important)).alias("n_important")).select("w.start", "w.end", "n", "n_important")
