"""Windows of op8's narrowed surroundings: all of those asked for, in few batches."""

import numpy as np
import pyarrow as pa

from lumenlake.llm import repeats


class Given:
    """Stands for a table: hands on what is run over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_windows_come_in_few_batches():
    length, trigger, n = 40, 8, 1100
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 99, 72).astype(np.uint8).tobytes() for _ in range(n)]
    texts[7] = texts[3]
    wanted = [[{"r0": 0, "told": i % 2}, {"r0": 10, "told": 1}] for i in range(n)]
    kind = pa.list_(pa.struct([("r0", pa.int64()), ("told", pa.int32())]))
    columns = [pa.array([i.to_bytes(12, "big") for i in range(n)]), pa.array([132] * n, pa.int64()), pa.array([100] * n, pa.int32()), pa.array([1] * n, pa.int64()), pa.array(texts, pa.binary()), pa.array(wanted, kind)]
    out = list(repeats._windows(Given(), length, trigger)([pa.RecordBatch.from_arrays(columns, ["row", "at", "lo", "gram", "bytes", "wanted"])]))
    assert len(out) == 3
    got = [(int.from_bytes(r["row"], "big"), 132 - r["lo"], r["told"], r["key"]) for b in out for r in b.to_pylist()]
    asked = [d for r0, r1 in repeats._ranges(length, trigger) if r0 in (0, 10) for d in range(r0, r1)]
    assert sorted(g[:3] for g in got) == sorted((i, d, bool(i % 2) or d >= 10) for i in range(n) for d in asked)
    keys, strings = {}, {}
    for i, d, _, key in got:
        own = d, texts[i][32 - d : 32 - d + length]
        assert keys.setdefault(own, key) == key and strings.setdefault(key, own) == own
