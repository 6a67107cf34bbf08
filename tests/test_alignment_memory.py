import random
import tracemalloc

from helixframe.operators import assembly as A


def test_memory_of_an_alignment_does_not_follow_its_length():
    rng = random.Random(2)
    a = ["".join(rng.choice("ACGT") for _ in range(800)).encode() for _ in range(200)]
    quality = [bytes([40]) * 800] * 200
    tracemalloc.start()
    got, overlap = A.penalties(a, quality, a, quality)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not got.any() and (overlap == 800).all()
    # All rows of the table, which were kept before, are 32 MB.
    assert peak < 20 << 20, peak
