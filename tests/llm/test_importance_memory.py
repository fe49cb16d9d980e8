"""What a worker holds while it makes a block's strings."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from kartwerk.llm import common, importance


class Taken:
    """Stands for a DataFrame and keeps the function that it is given."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.function = function
        return self


def test_strings_of_a_round_alone_are_held():
    rng, n = random.Random(4), 300_000
    names = [f"w{i}" for i in range(5000)]
    seq = [rng.randrange(len(names)) for _ in range(n)]
    block = [[0], [common.packed(np.full(n // 100, 100))], [common.packed(np.array(seq))], [importance._zip("\n".join(names).encode())]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(block, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "lens", "seq", "names"])
    rows = Taken()
    importance._strings(rows, 60, 0)
    tracemalloc.start()
    sent = sum(b.num_rows for b in rows.function(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 20
    assert peak < 60 * n, peak / n  # bytes a word of what Python and NumPy hold
