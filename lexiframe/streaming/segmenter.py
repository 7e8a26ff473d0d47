"""Sentences of texts that arrive in chunks: the unfinished end is carried to the next chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_WS = " \\t\\n\\x0B\\f\\r"
_SENTENCE = regex.compile(rf"[^{_WS}.!?][^.!?]++[.!?]")
_LAST = regex.compile(rf"[^{_WS}.!?]++\Z")


def cut(text: str, last: bool) -> tuple[list[str], str]:
    """(sentences, rest): the rest is what no final mark ends yet; with `last` its last word is a
    sentence of its own, as at the end of a whole text."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        out.append(m[0])
        at = m.end()
    rest = text[at:]
    if last and (m := _LAST.search(rest)):
        out.append(m[0])
    return out, rest


def sentences(chunks: DataFrame) -> DataFrame:
    """(doc_id, i, sentence) of a stream (doc_id, chunk_no, chunk, is_last).

    Chunks of a document are taken in order; within a micro-batch they are sorted, and a chunk that
    comes before its forerunners waits in the state. The state of a finished document is dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, i, due, waiting = state.get if state.exists else ("", 0, 0, [])
        for b in batches:
            waiting = [*waiting, *zip(b["chunk_no"].tolist(), b["chunk"].fillna("").tolist(), b["is_last"].tolist())]
        waiting.sort()
        out, done = [], False
        while waiting and waiting[0][0] <= due:
            no, chunk, last = waiting.pop(0)
            if no < due:
                continue  # delivered twice
            due += 1
            said, rest = cut(rest + chunk, bool(last))
            out += said
            done = done or bool(last)
        yield pd.DataFrame({"doc_id": [key[0]] * len(out), "i": range(i, i + len(out)), "sentence": out})
        if done:
            state.remove()
        else:
            state.update((rest, i + len(out), due, waiting))

    return chunks.groupBy("doc_id").applyInPandasWithState(
        run,
        "doc_id bigint, i int, sentence string",
        "rest string, i int, due int, waiting array<struct<no:int,chunk:string,last:boolean>>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
