"""Peak memory of a fresh worker process over one large Arrow batch."""

from __future__ import annotations

import subprocess
import sys

import pytest

RUN = """
import random
import pyarrow as pa
from finlens.llm import {module} as M

rnd = random.Random(1)
texts = [" ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(360)) for _ in range(200)]
col = pa.concat_arrays([pa.array(texts)] * 50)
assert col.nbytes > 25_000_000
for _ in M.{make}(iter([col])):
    pass
# of this program alone (a resource usage would count the process it was started from)
peak = next(line for line in open("/proc/self/status") if line.startswith("VmHWM"))
print(int(peak.split()[1]) // 1024)
"""


@pytest.mark.parametrize(("module", "make"), [("near_dedup", "_set_builder(5)"), ("periodic_runs", "_finder(4, 6)")])
def test_a_batch_of_25_mb(module, make):
    out = subprocess.run([sys.executable, "-c", RUN.format(module=module, make=make)], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 170  # MB, the batch and all imports included
