"""What the operators share."""

import os

import pyarrow as pa
import pytest

from paperloom.llm import common


def resident_mb() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


class Taken:
    """A table whose Arrow step is run here instead of in a worker."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):
        self.run = run


@pytest.mark.skipif(not common._TRIM, reason="needs glibc")
def test_a_worker_gives_back_what_a_step_took(spark):
    """A step's 200 MB in small blocks, below one that stays, are not kept by the worker when the task is over."""
    stays = []

    def step(batch):
        blocks = [bytes(2000) for _ in range(100_000)]
        stays.append(bytes(2000))
        return {"n": [len(blocks)]}

    table = Taken(spark)
    common.in_arrow(table, lambda: step, "n long", weigh=None)
    before = resident_mb()
    (out,) = table.run(iter([pa.RecordBatch.from_pydict({"text": ["x"]})]))
    assert out.to_pydict() == {"n": [100_000]}
    assert resident_mb() - before < 60
