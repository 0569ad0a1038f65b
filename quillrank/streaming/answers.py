"""Answers that stream in pieces (answer_id, seq, text, finish), as ``quillrank.operators.answers``.

``finish`` is NULL until an answer's last piece, which has the reason it ended. Pieces of one answer
come in order from batch to batch; within a batch they are put in order.

A call of Python for each answer costs far more than the work on its pieces, so answers are dealt to buckets, and a call has a bucket: its
pieces, and as state a JSON object of its answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillrank.functions.fixed_values import MAX_ANSWER_CHARS

BUCKETS = 4_096


def in_buckets(rows: DataFrame, keys: Sequence[str], by: str | Sequence[str], work: Callable, output: str) -> DataFrame:
    """``work`` on the rows of each bucket of ``keys`` in a micro-batch, and on what it kept of them.

    ``work`` gets a dict of what is kept by key (its parts joined by a blank), which it changes, and the columns in the order of (keys, by)
    with the place where each key starts, and last the number of rows. It returns a frame.
    """
    keys = list(keys)
    names = [*keys, *([by] if isinstance(by, str) else by)]

    def bucket(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        batch = pd.concat(list(frames), ignore_index=True)
        order = np.lexsort([batch[name].to_numpy() for name in reversed(names)])
        columns = {name: batch[name].to_numpy()[order] for name in batch.columns}
        new = np.zeros(len(order), bool)
        for name in keys:
            new[1:] |= columns[name][1:] != columns[name][:-1]
        new[0] = True
        yield work(kept, columns, np.append(np.flatnonzero(new), len(order)))
        state.update((json.dumps(kept),))

    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").applyInPandasWithState(bucket, output, "kept string", "append", GroupStateTimeout.NoTimeout)


def stream_cap(pieces: DataFrame, cap: int = MAX_ANSWER_CHARS) -> DataFrame:
    """Passes on pieces until an answer has had its characters. The state is their number."""

    def capped(sent: dict, columns: dict, starts: np.ndarray) -> pd.DataFrame:
        answers, texts = columns["answer_id"], columns["text"]
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.append(0, np.cumsum(length))
        names = list(map(str, answers[starts[:-1]].tolist()))
        earlier = np.array([sent.get(name, 0) for name in names], np.int64)
        before = ends[:-1] + np.repeat(earlier - ends[starts[:-1]], np.diff(starts))
        now = np.minimum(cap, earlier + ends[starts[1:]] - ends[starts[:-1]])
        sent.update(zip(names, now.tolist(), strict=True))
        kept = np.flatnonzero((before < cap) & (length > 0))
        cut = [texts[i][: cap - before[i]] for i in kept]
        return pd.DataFrame({"answer_id": answers[kept], "seq": columns["seq"][kept], "text": pd.Series(cut, dtype=object)})

    return in_buckets(pieces.select("answer_id", "seq", "text"), ["answer_id"], "seq", capped, "answer_id long, seq long, text string")


def assemble(pieces: DataFrame, cap: int = MAX_ANSWER_CHARS) -> DataFrame:
    """Emits an answer once it ends. The state holds no more text than an answer may have, and open answers only."""

    def assembled(open_answers: dict, columns: dict, starts: np.ndarray) -> pd.DataFrame:
        texts, finishes, out = columns["text"], columns["finish"], []
        ended = pd.notna(finishes)
        for first, after in zip(starts[:-1], starts[1:], strict=True):
            number = int(columns["answer_id"][first])
            head, over = open_answers.pop(str(number), ("", False))
            any_ended = False
            for end in [*(first + np.flatnonzero(ended[first:after])), after]:
                if not over:
                    head = (head + "".join(texts[first : min(end + 1, after)])).lstrip()
                    # Blanks at the end may yet be followed by text, which alone makes the answer too long.
                    over = len(head.rstrip()) > cap
                    head = head[:cap] if over else head
                first = end + 1
                if end == after:
                    break
                any_ended = True
                if finishes[end] == "length":
                    out.append((number, None, "exhausted"))
                elif not head.strip():
                    out.append((number, None, "empty"))
                else:
                    out.append((number, head.rstrip() + ("…" if over else ""), None))
                head, over = "", False
            if not any_ended:
                open_answers[str(number)] = (head, over)
        return pd.DataFrame(out, columns=["answer_id", "answer", "failed"], dtype=object)

    return in_buckets(pieces, ["answer_id"], "seq", assembled, "answer_id long, answer string, failed string")
