"""What a worker has freed goes back to the machine."""

import ctypes

import pyarrow as pa
import pytest

from quayside.llm._memory import tidied, tidied_batches


def held() -> int:
    """MB of this process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 >> 20


def work(pins: list) -> int:
    """Frees 200 MB below a piece that stays, so that the allocator keeps them by itself."""
    pieces = [bytearray(b"x" * 100_000) for _ in range(2000)]
    pins.append(bytearray(b"x" * 100_000))
    return len(pieces)


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="another C library")
def test_freed_memory_is_given_back():
    pins: list = []
    before = held()
    assert tidied(work, pins) == 2000
    assert held() - before < 60

    def run(batches):
        for batch in batches:
            work(pins)
            yield batch

    batch = pa.RecordBatch.from_pydict({"a": [1, 2]})
    assert list(tidied_batches(run)(iter([batch, batch]))) == [batch, batch]
    assert held() - before < 60
    work(pins)
    assert held() - before > 150, "without it the allocator keeps what is freed, so this test would not see a difference"
