"""Blocks of rows with state that stays with them between the passes of a fit.

A block is what the step functions make of one Arrow batch: numpy arrays of its rows and whatever a pass leaves for the
next one. Blocks are kept in memory and on disk, and checkpointed every few passes, so a lost executor costs the passes
since the last checkpoint. A pass has two parts: ``advance`` replaces every block, ``total`` adds up an array over them.
``deal`` cuts the blocks anew, for instance into those of each model; ``reduced`` adds up an array for each of these and
gives the driver only what a function makes of the sums. Where a task can hold all rows, ``apart`` gives them to each of
several tasks, so that independent fits make their passes without jobs in between.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from cohortloom.runtime import shared_folder

# Tasks get this module's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of partial sums that the driver takes at once; more are added in tasks first.
DRIVER_BYTES = 64 << 20
#: Rows that are worth a task of their own.
TASK_ROWS = 1000


def _blobs(make: Callable[[pa.RecordBatch], object]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                blob = pickle.dumps(make(batch), protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    return run


def _sums(of: Callable[[object], np.ndarray]):
    def run(blocks: Iterator) -> Iterator[np.ndarray]:
        total = None
        for block in blocks:
            value = of(block)
            total = value if total is None else total + value
        if total is not None:
            yield total

    return run


def _owned_sums(of: Callable[[object], np.ndarray], owner: Callable[[object], int]):
    """((owner, row), sum of that row) for each owner of neighbouring blocks."""
    def run(blocks: Iterator) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        for who, mine in groupby(blocks, owner):
            total = None
            for block in mine:
                value = of(block)
                if total is None:
                    total = value
                else:
                    total += value
            for k, row in enumerate(total):
                yield (who, k), row

    return run


def _added(parts: Iterator) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """One sum for each (owner, row), in the order of the partitions that the parts come from."""
    for key, mine in groupby(parts, lambda item: item[0][:2]):
        total = None
        for _, row in mine:
            total = row if total is None else total + row
        yield key, total


class Resident:
    """The blocks of ``df``; ``make`` turns an Arrow batch into a block."""

    def __init__(self, df: DataFrame, make: Callable[[pa.RecordBatch], object], every: int = 20):
        shared_folder(df.sparkSession)
        self.every, self.passes = every, 0
        # a table in few partitions is dealt to the cores, as it will be passed over many times
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
        if parts < cores and (wanted := min(cores, -(-df.count() // TASK_ROWS))) > parts:
            df = df.repartition(wanted)
        blobs = df.mapInArrow(_blobs(make), "blob binary")
        self.blocks = blobs.rdd.map(lambda row: pickle.loads(row.blob)).persist(StorageLevel.MEMORY_AND_DISK)
        self.earlier: list = []
        self.parts = self.blocks.getNumPartitions()

    def advance(self, step: Callable[[object], object]) -> None:
        """Replace every block by ``step`` of it, with the next ``total``."""
        self.earlier.append(self.blocks)
        self.blocks = self.blocks.map(step).persist(StorageLevel.MEMORY_AND_DISK)
        self.passes += 1
        if self.passes % self.every == 0:
            self.blocks.checkpoint()

    def deal(self, pieces: Callable[[object], Iterator], parts: int, joined: Callable[[Iterator], Iterator]) -> None:
        """Replace the blocks by what ``joined`` makes of their pieces in each of ``parts`` partitions.

        ``pieces(block)`` gives ((partition, order), piece) pairs; a partition has its pieces by order and then as their
        blocks stood.
        """
        def keyed(source: int, blocks: Iterator) -> Iterator:
            for n, block in enumerate(blocks):
                for (part, order), piece in pieces(block):
                    yield (part, order, source, n), piece

        dealt = self.blocks.mapPartitionsWithIndex(keyed).repartitionAndSortWithinPartitions(parts, lambda key: key[0])
        self.earlier.append(self.blocks)
        self.blocks = dealt.values().mapPartitions(joined).persist(StorageLevel.MEMORY_AND_DISK)
        self.parts = parts

    def reduced(self, of: Callable[[object], np.ndarray], owner: Callable[[object], int], finish: Callable[[np.ndarray], np.ndarray],
                rows: int, owners: int, alone: bool) -> dict[tuple[int, int], np.ndarray]:
        """{(owner, row): ``finish`` of the sum of that row of ``of(block)`` over the owner's blocks}.

        Sums are added and finished in tasks, each owner's rows apart. ``alone`` says that no owner has blocks in two
        partitions; else the sums of partitions meet by owner and row, added in the order of the partitions.
        """
        sums = self.blocks.mapPartitions(_owned_sums(of, owner))
        if not alone:
            tasks = min(rows * owners, self.parts)
            sums = (sums.mapPartitionsWithIndex(lambda source, items: (((*key, source), row) for key, row in items))
                    .repartitionAndSortWithinPartitions(tasks, lambda key: (key[0] * rows + key[1]) % tasks).mapPartitions(_added))
        found = dict(sums.mapValues(finish).collect())
        for old in self.earlier:
            old.unpersist()
        self.earlier = []
        return found

    def apart(self, tasks: int, run: Callable[[int, list], object]) -> dict[int, object]:
        """{number: ``run(number, blocks)``} of ``tasks`` tasks, each with all blocks, in their order; the blocks stay as they are."""
        def keyed(source: int, blocks: Iterator) -> Iterator:
            for n, block in enumerate(blocks):
                for task in range(tasks):
                    yield (task, source, n), block

        def whole(task: int, items: Iterator) -> Iterator:
            blocks = [block for _, block in items]
            if blocks:
                yield task, run(task, blocks)

        dealt = self.blocks.mapPartitionsWithIndex(keyed).repartitionAndSortWithinPartitions(tasks, lambda key: key[0])
        return dict(dealt.mapPartitionsWithIndex(whole).collect())

    def total(self, of: Callable[[object], np.ndarray], length: int) -> np.ndarray:
        """The sum of ``of(block)``, a flat array, over all blocks; in the order of the partitions where the driver adds."""
        sums = self.blocks.mapPartitions(_sums(of))
        size = max(1, 8 * length)
        if self.parts * size <= DRIVER_BYTES:
            total = sum(sums.collect(), np.zeros(length))
        else:
            fits = max(2, DRIVER_BYTES // size)
            depth = max(2, math.ceil(math.log(self.parts) / math.log(fits)))
            total = sums.treeAggregate(np.zeros(length), lambda a, b: a + b, lambda a, b: a + b, depth)
        # earlier blocks are needed until the new ones have been made
        for old in self.earlier:
            old.unpersist()
        self.earlier = []
        return total

    def drop(self) -> None:
        for old in [*self.earlier, self.blocks]:
            old.unpersist()
