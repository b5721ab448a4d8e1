"""Exp3 task bandit: task probabilities that follow rewards.

p_i = (1 - gamma) * softmax(w)_i + gamma / n; a reward r for task i adds
gamma * (r / p_i) / n to w_i. Each step needs the state left by the one before, so the
log of one experiment is a sequential fold; experiments run in parallel. Rows stream
through in key and step order with a state of n numbers; a log is never held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REWARDS = ("pg", "pgnorm", "dummy")


def reward(before: Column, after: Column, kind: str = "pg") -> Column:
    """Reward of a step from the development loss before and after it."""
    if kind == "pg":
        return before - after
    if kind == "pgnorm":
        return 1 - after / F.nullif(before, F.lit(0.0))
    if kind == "dummy":
        return F.lit(0.0)
    raise ValueError(f"unknown reward {kind!r}; use one of {REWARDS}")


def probabilities(w: np.ndarray, gamma: float) -> np.ndarray:
    e = np.exp(w - w.max())
    return (1 - gamma) * e / e.sum() + gamma / len(w)


def _step(w: np.ndarray, task: int, r: float, gamma: float) -> None:
    w[task] += gamma * (r / probabilities(w, gamma)[task]) / len(w)


def exp3(log: DataFrame, tasks: list[str], gamma: float = 0.25, key: str = "key", step: str = "step") -> DataFrame:
    """`log(key, step, task, reward)` -> `(key, step, task, probs)`: task
    probabilities after every update. Steps without a reward (null) change nothing."""
    index = {t: i for i, t in enumerate(tasks)}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, w = None, np.zeros(len(tasks))
        for pdf in batches:
            probs = []
            for k, t, r in zip(pdf["key"], pdf["task"], pdf["reward"]):
                if k != current:
                    current, w = k, np.zeros(len(tasks))
                if pd.notna(r):
                    _step(w, index[t], r, gamma)
                probs.append(probabilities(w, gamma))
            yield pdf[["key", "step", "task"]].assign(probs=probs)

    rows = log.select(F.col(key).alias("key"), F.col(step).alias("step"), "task", "reward")
    ordered = rows.repartition("key").sortWithinPartitions("key", "step")
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, step {kinds['step']}, task string, probs array<double>"
    return ordered.mapInPandas(fold, schema)


def stream_exp3(stream: DataFrame, tasks: list[str], gamma: float = 0.25) -> DataFrame:
    """Streaming form of `exp3` over `(key long, step long, task, reward)`.

    Emits `(key, updates, probs)` per key and micro-batch; the state is the weight list.
    The rows of one key and micro-batch are sorted by step first, so bound the
    micro-batch with `maxFilesPerTrigger` or `maxBytesPerTrigger`.
    """
    index = {t: i for i, t in enumerate(tasks)}

    def update(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, w = (state.get[0], np.array(state.get[1])) if state.exists else (0, np.zeros(len(tasks)))
        rows = pd.concat(list(chunks)).sort_values("step")
        for t, r in zip(rows["task"], rows["reward"]):
            if pd.notna(r):
                _step(w, index[t], r, gamma)
        done += len(rows)
        state.update((done, w.tolist()))
        yield pd.DataFrame({"key": [key[0]], "updates": [done], "probs": [probabilities(w, gamma).tolist()]})

    return stream.groupBy("key").applyInPandasWithState(
        update,
        "key bigint, updates bigint, probs array<double>",
        "updates bigint, w array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
