"""Tasks of one barrier stage that share memory, where they run on one host.

The tasks of the host with the most of them map one file of the shared folder; it is unlinked as soon as all have it open.
They meet by counters in that memory, in microseconds, where the driver's barrier takes milliseconds. The shared folder
must be a mounted file system, and the processor must keep the order of writes; else the first task works alone.
"""

from __future__ import annotations

import mmap
import os
import platform
import time
import uuid
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

#: Bytes between counters, so that no two are in one line of a cache.
LINE = 64
#: Looks at a counter before the processor is offered to others, and seconds after which a member counts as lost.
LOOKS, PATIENCE = 2000, 600.0
ORDERED = ("x86_64", "AMD64")


def tasks_for(spark: SparkSession, members: int) -> int:
    """Tasks to start so that one host has ``members`` of them, where the cluster has room for that."""
    context = spark.sparkContext._jsc.sc()
    hosts = {info.host() for info in context.statusTracker().getExecutorInfos()}
    slots = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
    return max(1, min(slots, members * max(1, len(hosts)))) if members > 1 else 1


def chosen(addresses: list[str], members: int) -> list[int]:
    """The first ``members`` tasks of the host that has most; of the first such host."""
    hosts = [address.rsplit(":", 1)[0] for address in addresses]
    most = Counter(hosts).most_common(1)[0][0]  # of equals the first
    return [i for i, host in enumerate(hosts) if host == most][:members]


class Team:
    """The members of a task's team and their shared ``room`` of numbers; ``rank`` is None outside the team."""

    def __init__(self, folder: str, members: int, numbers: int):
        context = BarrierTaskContext.get()
        me, addresses = context.partitionId(), [info.address for info in context.getTaskInfos()]
        picked = chosen(addresses, members)
        store, base = pafs.FileSystem.from_uri(folder)
        alone = len(picked) == 1 or not isinstance(store, pafs.LocalFileSystem) or platform.machine() not in ORDERED
        self.ranks, self.turn, held = picked[:1], 0, None
        if not alone:
            head = LINE * (1 + len(picked))
            path = os.path.join(base, f"team-{uuid.uuid4().hex}")
            if me == picked[0]:
                held = self._mapped(path, head + 8 * numbers, made=True)
                held[:16] = bytes.fromhex(path[-32:])
            path = context.allGather(path)[picked[0]]
            if me in picked[1:]:
                held = self._mapped(path, head + 8 * numbers)
            seen = context.allGather(str(int(held is not None and held[:16] == bytes.fromhex(path[-32:]))))
            if me == picked[0]:
                os.unlink(path)
            self.ranks = [i for i in picked if seen[i] == "1"]
        self.count = len(self.ranks)
        self.rank = self.ranks.index(me) if me in self.ranks else None
        if self.rank is None:
            return
        if held is None:
            self.room = np.zeros(numbers)
            return
        self.room = np.frombuffer(held, np.float64, numbers, head)
        self.counters = memoryview(held)[LINE:head].cast("q")
        places = [picked.index(i) * LINE // 8 for i in self.ranks]
        self.own, self.others = places[self.rank], [p for p in places if p != places[self.rank]]

    @staticmethod
    def _mapped(path: str, size: int, made: bool = False) -> mmap.mmap | None:
        try:
            with open(path, "x+b" if made else "r+b") as file:
                if made:
                    file.truncate(size)
                return mmap.mmap(file.fileno(), size)
        except (OSError, ValueError):  # not there, or not as long, as this task sees it
            if made:
                raise
            return None

    def meet(self) -> None:
        """Return once all members have come here; each then sees what the others wrote before."""
        if self.count == 1:
            return
        self.turn += 1
        counters, turn = self.counters, self.turn
        counters[self.own] = turn
        for other in self.others:
            looks, since = 0, 0.0
            while counters[other] < turn:
                looks += 1
                if looks > LOOKS:
                    os.sched_yield()
                    since = since or time.monotonic()
                    if looks % LOOKS == 0 and time.monotonic() - since > PATIENCE:
                        raise TimeoutError(f"a member of the team has not come for {PATIENCE:.0f} s")
