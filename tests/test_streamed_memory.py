"""Memory of the streamed choices: anchors that wait are held as bytes."""

import random
import tracemalloc

import pytest

from trailgrain.operators import bundles as B

ANCHORS = 4000


def waiting():
    """Anchors of which none can be ruled out early, each with four members."""
    r = random.Random(3)
    score = [round(r.random(), 6) for _ in range(ANCHORS)]
    info = lambda m: {"score": score[m], "families": [m % 1000, m % 50], "weight": 1.0}
    for i in sorted(range(ANCHORS), key=lambda i: -score[i]):
        yield {"case": "c", "anchor": i, **info(i), "mandatory": False, "bound": 1.0, "members": [{"id": m, **info(m)} for m in sorted({i, *(r.randrange(ANCHORS) for _ in range(3))})]}


@pytest.mark.parametrize("how", [B.by_coverage, B.diminishing, B.by_evidence])
def test_waiting_anchors_take_little_memory(how):
    rows = waiting()
    tracemalloc.start()
    taken = sum(1 for _ in how(rows, ANCHORS // 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken == ANCHORS // 10
    assert peak < 900 * ANCHORS
