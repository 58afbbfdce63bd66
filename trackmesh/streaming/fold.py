"""State machines over ordered rows of a key, run by the same code over a table or over a stream.

A machine is a picklable object with

* ``fields``: the DDL of its output, without the key columns;
* ``start()``: the state of a key not seen before;
* ``feed(state, rows)``: output tuples of some more rows of the key, in order; it changes the state;
* ``feed_columns(state, rows)``, if it has it: the same as a list of columns, which a table takes instead.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from trackmesh.session import ship


def runs_of(new: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of rows, given which rows begin one."""
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(new)], strict=True))


class Machine(Protocol):
    fields: str

    def start(self) -> Any: ...

    def feed(self, state: Any, rows: pd.DataFrame) -> list[tuple]: ...


def _schema(df: DataFrame, keys: list[str], machine: Machine) -> StructType:
    return StructType([df.schema[k] for k in keys] + StructType.fromDDL(machine.fields).fields)


def over_table(df: DataFrame, keys: list[str], order: list[str], machine: Machine, unit: str | None = None) -> DataFrame:
    """The machine over each key's rows in order.

    One shuffle on the keys; rows then pass in Arrow batches in sorted order, so a key of any size needs the memory of
    a batch and of its state. Rows of one ``unit`` value (a frame) are never fed apart. Rows with a null key are left out.
    """
    ship(df.sparkSession)
    names = _schema(df, keys, machine).names
    # a worker's state lives as long as its task: a lost one is computed again from the shuffle
    # a stated number of partitions: adaptive execution would join them by size, and the work here is not in the size
    tasks = 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so that few keys share a task
    rows = df.dropna(subset=keys).repartition(tasks, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, held = None, None, None
        columns = getattr(machine, "feed_columns", None)

        def feed(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal key, state
            out: list[tuple] = []
            tables: list[pd.DataFrame] = []
            new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            for part in (pdf.iloc[a:b] for a, b in runs_of(new)):
                own = tuple(part[keys].iloc[0])
                if own != key:
                    key, state = own, machine.start()
                if columns is None:
                    out += [own + row for row in machine.feed(state, part)]
                else:
                    found = columns(state, part)
                    tables.append(pd.DataFrame(dict(zip(names, [*([k] * len(found[0]) for k in own), *found], strict=True))))
            return pd.DataFrame(out, columns=names) if columns is None else pd.concat(tables, ignore_index=True)

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = None
            if unit is not None and len(pdf):
                same = (pdf[[*keys, unit]] == pdf[[*keys, unit]].iloc[-1]).all(axis=1).to_numpy()
                cut = len(pdf) - int(np.logical_and.accumulate(same[::-1]).sum())
                held, pdf = pdf.iloc[cut:], pdf.iloc[:cut]
            if len(pdf):
                yield feed(pdf)
        if held is not None and len(held):
            yield feed(held)

    return rows.mapInPandas(run, _schema(df, keys, machine))


#: Rows of a sorted run, and of what is read of one at a time or fed to a machine.
RUN, SLICE = 200_000, 10_000


def in_order(parts: Iterator[pd.DataFrame], order: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of all parts in order, equal ones as they came, in slices that never part rows of one first value of order.

    More rows than a run go to a file, run by run, and are merged, so memory is that of a run and of a slice of each.
    """
    first = order[0]
    ready = lambda held: pd.concat(held, ignore_index=True).sort_values(order, kind="stable", ignore_index=True)

    def cut(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        new = np.flatnonzero((rows[first] != rows[first].shift()).to_numpy())
        a = 0
        while a < len(rows):
            at = int(np.searchsorted(new, a + SLICE))
            b = int(new[at]) if at < len(new) else len(rows)
            yield rows.iloc[a:b]
            a = b

    with tempfile.TemporaryFile() as file:
        held, size, places = [], 0, []  # places: the slices of each run in the file

        def spill() -> None:
            rows, own = ready(held), []
            for a in range(0, len(rows), SLICE):
                own.append(file.tell())
                pickle.dump(rows.iloc[a : a + SLICE], file)
            places.append(own[::-1])
            held.clear()

        def more(run: int) -> pd.DataFrame:
            file.seek(places[run].pop())
            return pickle.load(file)

        for part in parts:
            held.append(part)
            size += len(part)
            if size >= RUN:
                spill()
                size = 0
        if not places:
            yield from cut(ready(held)) if held else ()
            return
        if held:
            spill()
        heads = [more(i) for i in range(len(places))]
        while any(places):
            ends = {i: heads[i][first].iloc[-1] for i in range(len(heads)) if places[i]}
            low = min(ends, key=ends.get)
            before = [int(np.searchsorted(h[first].to_numpy(), ends[low])) for h in heads]
            if any(before):
                yield from cut(ready([h.iloc[:n] for h, n in zip(heads, before, strict=True)]))
                heads = [h.iloc[n:] for h, n in zip(heads, before, strict=True)]
            heads[low] = pd.concat([heads[low], more(low)], ignore_index=True)
        yield from cut(ready(heads))


def over_stream(df: DataFrame, keys: list[str], order: list[str], machine: Machine) -> DataFrame:
    """The machine over a stream; its state is kept by key in the state store, and so restored from the checkpoint.

    A micro-batch's rows of a key are put in order first and fed in slices, so that a key needs no memory for all of them
    (an empty ``order`` keeps them as they came, in one piece); a unit such as a frame, the first of ``order``, must arrive
    in one micro-batch.
    """
    ship(df.sparkSession)
    schema = _schema(df, keys, machine)

    def run(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(kept.get[0]) if kept.exists else machine.start()
        for rows in in_order(parts, order) if order else [pd.concat(list(parts), ignore_index=True)]:
            yield pd.DataFrame([tuple(key) + row for row in machine.feed(state, rows)], columns=schema.names)
        kept.update((pickle.dumps(state),))

    return df.dropna(subset=keys).groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
