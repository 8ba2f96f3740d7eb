from pathlib import Path

import pytest

from inkgrid import session


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


@pytest.mark.skipif(not Path("/proc/self/statm").exists(), reason="memory is read from /proc")
def test_freed_memory_goes_back_to_the_system():
    last = []

    def f(batches):
        large = [bytes(4000) for _ in range(50_000)]
        last.append(large[-1])  # stays at the top of the heap, so that what is below isn't cut off
        del large
        yield from batches

    before = resident()
    assert list(session.lean(f)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60
