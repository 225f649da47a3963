"""Streaming form of the ordered accept fold: state is where a region's last accepted match ended.

An extension beyond the batch engine.  Lines arrive with their alignments; a
region's lines are taken in order of line_index inside each micro-batch, and a
line below the last one seen counts as late and is left to the batch job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folia.operators.matching import DEFAULT, MatchSettings

OUTPUT = "doc_id long, line_index int, action string, continues boolean, identity double, c_start long, c_end long"


def accept_stream(aligned: DataFrame, s: MatchSettings = DEFAULT) -> DataFrame:
    """``aligned``: doc_id, line_index, n (query tokens), identity, matched, c_start, c_end of each line's best alignment."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (-1, -1)
        rows = pd.concat(list(batches)).sort_values("line_index")
        out = []
        for r in rows.itertuples(index=False):
            if r.line_index <= seen:
                continue
            seen = r.line_index
            if r.n < (s.min_query_tokens if last < 0 else s.min_continuation_tokens):
                continue
            continues = bool(last >= 0 and 0 <= r.c_start - last <= s.continuation_max_gap)
            if r.identity < s.min_identity or r.matched < (s.min_continuation_tokens if continues else s.min_span_tokens):
                continue
            last = r.c_end
            out.append((key[0], r.line_index, "replaced" if continues or r.matched / r.n >= s.min_coverage else "cited", continues, r.identity, r.c_start, r.c_end))
        state.update((int(last), int(seen)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    return aligned.groupBy("doc_id").applyInPandasWithState(step, OUTPUT, "last long, seen long", "append", GroupStateTimeout.NoTimeout)
