"""Places of parts by hashes: those of a dictionary, in little room, whatever hashes meet."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tempoframe.llm import alignment


@pytest.mark.parametrize("key", [hash, len, lambda p: 7])
def test_places_are_those_of_a_dictionary(key):
    rng = random.Random(9)
    parts = list({"".join(rng.choices("abcé日 ", k=rng.randrange(1, 9))) for _ in range(3000)})
    parts += parts[:200]  # a part that came twice may be found at either place
    places = alignment.Places(pa.chunked_array([parts[:7], parts[7:1500], [], parts[1500:]], pa.string()), key)
    for n in (0, 1, 400):
        some = rng.choices(parts, k=n)
        assert [parts[k] for k in places.of(some)] == some
    assert bool(places.others) == (key is not hash)


def test_a_part_that_is_missing_is_not_another():
    for parts in ([], ["a", "b"]):
        with pytest.raises(KeyError):
            alignment.Places(pa.chunked_array([parts], pa.string())).of(["c"])


def test_places_take_little_room():
    parts = pa.chunked_array([pa.array(np.char.add("part ", np.arange(k, k + 20_000).astype(str))) for k in range(0, 200_000, 20_000)])
    tracemalloc.start()
    places = alignment.Places(parts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20 * len(parts) and places.of(["part 7", "part 199999"]).tolist() == [7, 199_999]
