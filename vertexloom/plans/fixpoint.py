"""Rounds over vertex state until nothing is active."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.plans.shared import checkpointed, drop_checkpoint


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], most: int) -> tuple[DataFrame, int]:
    """(final state, rounds): state = step(state, round) while a row has `active`.

    Each round's state is checkpointed in the shared folder, since plans would double in size with each round; the same
    job counts the active rows. The state before it is deleted then. Raises RuntimeError if a row is still active after `most` rounds.
    """

    def settled(df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        out = checkpointed(df.observe(seen, F.count_if("active").alias("n")))
        return out, seen.get["n"]

    state, active = settled(state)
    rounds = 0
    while active:
        if rounds >= most:
            raise RuntimeError(f"{active} vertices are still active after {rounds} rounds")
        before = state
        state, active = settled(step(before, rounds))
        drop_checkpoint(before)
        rounds += 1
    return state, rounds
