"""The grep chain of each session as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session long, seq long, chain long, warn boolean"


def chains(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows (session, seq, class) of one session, put in order within the micro-batch; the state is the length of the chain."""
    chain = state.get[0] if state.exists else 0
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for seq, kind in zip(rows["seq"], rows["class"], strict=True):
        chain = 0 if kind == "reset" else chain + (kind == "grep")
        out.append((key[0], seq, chain, kind == "grep" and chain >= 3))
    state.update((int(chain),))
    yield pd.DataFrame(out, columns=["session", "seq", "chain", "warn"])


def guard_stream(calls: DataFrame) -> DataFrame:
    """calls (session long, seq long, class string) as a stream, with chain and warning as in the batch operator."""
    return calls.groupBy("session").applyInPandasWithState(chains, OUTPUT, "chain long", "append", GroupStateTimeout.NoTimeout)
