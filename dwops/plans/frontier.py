"""Round-by-round expansion with a cut lineage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame

from dwops.session import stored_counted


def expand(start: DataFrame, step: Callable[[DataFrame, list[DataFrame], int], DataFrame], max_rounds: int | None,
           stop_quietly: bool) -> DataFrame:
    """All rows reached from ``start`` by repeated ``step(frontier, earlier rounds, round)``.

    Each round is written to the shared folder, so that the next one starts from stored
    rows and a lost executor costs no replay of the rounds before. Rounds end when nothing
    new comes; at ``max_rounds`` (None: never) the expansion stops, or fails if rows are pending.
    """
    first, found = stored_counted(start)
    rounds = [first]
    for number in count(1) if max_rounds is None else range(1, max_rounds + 1):
        if not found:
            break
        reached, found = stored_counted(step(rounds[-1], rounds, number))
        if found:
            rounds.append(reached)
    else:
        if found and not stop_quietly:
            raise ValueError(f"still growing after {max_rounds} rounds: deeper than expected or without end")
    return reduce(DataFrame.unionByName, rounds)
