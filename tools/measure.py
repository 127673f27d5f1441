"""Cold and warm time, tasks, shuffle bytes and spill of the headline queries, as a Markdown table.

    BENCH_SF_DIR=/root/testdata/sf0.1 python tools/measure.py
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import bench  # noqa: E402
from tarmac.session import build_session  # noqa: E402


def stages(spark):
    """Finished stages by id, from the status store behind the Spark UI."""
    gateway = spark.sparkContext._gateway
    none = spark._jvm.java.util.ArrayList()
    listed = spark._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(spark._jvm.double, 0), none)
    return {s.stageId(): s for s in (listed.apply(i) for i in range(listed.size()))}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"))
    print(f"Spark {spark.version}, {spark.sparkContext.defaultParallelism} cores, {Path(folder).name}\n")
    print("| query | cold s | warm s | tasks | shuffle written KB | spilled KB |\n|---|---|---|---|---|---|")
    for name in sys.argv[1:] or bench.HEADLINE:
        cold = bench.run(spark, name, folder)
        seen = set(stages(spark))
        warm = bench.run(spark, name, folder)
        new = [s for i, s in stages(spark).items() if i not in seen and str(s.status()) == "COMPLETE"]
        tasks = sum(s.numTasks() for s in new)
        written = sum(s.shuffleWriteBytes() for s in new) // 1024
        spilled = sum(s.diskBytesSpilled() for s in new) // 1024
        print(f"| {name} | {cold:.2f} | {warm:.2f} | {tasks} | {written} | {spilled} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
