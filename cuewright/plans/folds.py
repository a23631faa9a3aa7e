"""Greedy left-to-right folds over ordered rows, parallel inside one key.

A greedy fold (pack lines until full, grow a chunk until long enough) depends on everything before
it, but at a block edge all that matters is a small integer state. So:

1. every block maps each state it may be entered with to the state it leaves with,
2. the maps are composed over blocks, by super-blocks first, which gives each block its real state,
3. every block is folded once with that state and emits its results.

Keys that fit one block skip 1 and 2. All steps read sorted streams; no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.plans.blocked import BLOCK_ROWS, many_blocks, with_halo
from cuewright.session import written_once

SUPER_BLOCK = 1024
EMIT_ROWS = 20_000


Rows = dict[str, np.ndarray]


class GreedyFold(Protocol):
    """One fold. States are integers; ``initial`` is the state before the first row."""

    before: int
    after: int
    initial: int
    columns: Sequence[str]

    def entry_states(self, low: int) -> Iterable[int]:
        """States a block that starts at position ``low`` may be entered with."""

    def fold(self, rows: Rows, low: int, high: int, state: int, out: list | None) -> int:
        """Fold core rows ``[low, high)``, return the exit state.

        Results are appended to ``out`` as tuples that start with the index of a row in ``rows``.
        """


def group_stream(batches: Iterator[pd.DataFrame], part: Sequence[str]) -> Iterator[tuple[tuple, Rows]]:
    """Consecutive groups of a stream sorted by ``part``, joined over batch edges, as column arrays."""
    held: list[Rows] = []
    owner: tuple | None = None

    def joined() -> Rows:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if not len(batch):
            continue
        arrays = {c: batch[c].to_numpy() for c in batch.columns}
        changed = np.zeros(len(batch), dtype=bool)
        for c in part:
            changed[1:] |= arrays[c][1:] != arrays[c][:-1]
        starts = [0, *np.flatnonzero(changed).tolist()]
        for a, b in zip(starts, [*starts[1:], len(batch)]):
            key = tuple(arrays[c][a] for c in part)
            if held and key != owner:
                yield owner, joined()
                held = []
            owner = key
            held.append({c: v[a:b] for c, v in arrays.items()})
    if held:
        yield owner, joined()


def _sorted(df: DataFrame, part: Sequence[str], *order: str) -> DataFrame:
    return df.repartition(*part).sortWithinPartitions(*part, *order)


def run_fold(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    make: Callable[[], GreedyFold],
    schema: str,
    *,
    keep: Sequence[str] = (),
    size: int = BLOCK_ROWS,
    many: bool | None = None,
) -> DataFrame:
    """Apply the fold per key over dense positions ``pos``.

    ``schema`` types the fold's own output; ``keep`` columns of the row a result points at follow it,
    so no join back is needed.
    """
    keys, keep = list(keys), list(keep)
    fold = make()
    if many is None:
        many = many_blocks(df, pos, size)
    key_fields = [df.schema[k] for k in keys]
    own_fields = T._parse_datatype_string(schema).fields
    out_type = T.StructType(key_fields + own_fields + [df.schema[k] for k in keep])
    part = [*keys, "_blk"]
    needed = dict.fromkeys([*keys, pos, *fold.columns, *keep])
    rows = with_halo(df.select(*needed), pos, fold.before, fold.after, size, many, keys, dense=True)
    rows = _sorted(rows, part, pos)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = make()
        columns: list[list] = [[] for _ in out_type.names]
        for owner, block in group_stream(batches, part):
            core = block[pos][block["_core"]]
            if not len(core):
                continue
            state = int(block["_state"][0]) if "_state" in block else worker.initial
            out: list[tuple] = []
            worker.fold(block, int(core[0]), int(core[-1]) + 1, state, out)
            if not out:
                continue
            at, *own = zip(*out)
            values = [[v] * len(out) for v in owner[:-1]] + [list(v) for v in own]
            values += [block[k][list(at)].tolist() for k in keep]
            for column, value in zip(columns, values):
                column += value
            if len(columns[0]) >= EMIT_ROWS:
                yield pd.DataFrame(dict(zip(out_type.names, columns)))
                columns = [[] for _ in out_type.names]
        if columns[0]:
            yield pd.DataFrame(dict(zip(out_type.names, columns)))

    if not many:
        return rows.mapInPandas(emit, out_type)

    rows = written_once(rows, "fold-rows")
    step_type = T.StructType(key_fields + T._parse_datatype_string("_blk long, entry long, leave long").fields)

    def transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = make()
        for owner, block in group_stream(batches, part):
            core = block[pos][block["_core"]]
            if not len(core):
                continue
            low, high = int(core[0]), int(core[-1]) + 1
            states = [worker.initial] if low == 0 else list(worker.entry_states(low))
            if hasattr(worker, "leaves"):  # a fold that shares work between entry states
                left = worker.leaves(block, low, high, states)
            else:
                left = [worker.fold(block, low, high, s, None) for s in states]
            pairs = [(*owner, s, leave) for s, leave in zip(states, left)]
            yield pd.DataFrame(pairs, columns=step_type.names)

    maps = written_once(_sorted(rows, part, pos).mapInPandas(transitions, step_type), "fold-maps")
    entry = _entry_states(maps, keys, fold.initial)
    known = rows.join(entry, part)
    return _sorted(known, part, pos).mapInPandas(emit, out_type)


def _entry_states(maps: DataFrame, keys: list[str], initial: int) -> DataFrame:
    """Real entry state of every block from the per-block maps ``_blk, entry, leave``."""
    key_fields = [maps.schema[k] for k in keys]

    def typed(text: str) -> T.StructType:
        return T.StructType(key_fields + T._parse_datatype_string(text).fields)

    supers = maps.withColumn("_sup", F.floor(F.col("_blk") / SUPER_BLOCK).cast("long"))
    part = [*keys, "_sup"]
    by_super = _sorted(supers, part, "_blk")

    def step_of(rows: Rows) -> dict[int, int]:
        return dict(zip(rows["entry"].tolist(), rows["leave"].tolist()))

    def steps(group: Rows) -> Iterator[tuple[int, dict[int, int]]]:
        numbers = group["_blk"]
        edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for a, b in zip(edges, edges[1:]):
            yield int(numbers[a]), step_of({c: v[a:b] for c, v in group.items()})

    def compose(batches):
        for owner, group in group_stream(batches, part):
            total = None
            for _, step in steps(group):
                total = step if total is None else {a: step[b] for a, b in total.items() if b in step}
            yield pd.DataFrame(
                [(*owner, a, b) for a, b in total.items()], columns=[*part, "entry", "leave"]
            )

    composed = by_super.mapInPandas(compose, typed("_sup long, entry long, leave long"))

    def walk_supers(batches):
        current, state = None, initial
        for owner, step_rows in group_stream(batches, part):
            if owner[:-1] != current:
                current, state = owner[:-1], initial
            yield pd.DataFrame([(*owner, state)], columns=[*part, "_state"])
            state = step_of(step_rows).get(state, state)

    top = composed.repartition(*keys).sortWithinPartitions(*part).mapInPandas(walk_supers, typed("_sup long, _state long"))

    def walk_blocks(batches):
        for owner, group in group_stream(batches, part):
            state, out = int(group["_state"][0]), []
            for number, step in steps(group):
                out.append((*owner[:-1], number, state))
                state = step.get(state, state)
            yield pd.DataFrame(out, columns=[*keys, "_blk", "_state"])

    return _sorted(supers.join(top, part), part, "_blk").mapInPandas(walk_blocks, typed("_blk long, _state long"))
