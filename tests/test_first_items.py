"""Sums of whole units by runs without gaps, against the plain fold."""

import random
import time

from strandline.operators.selection import NEVER, first_items


def plain(units):
    entered = {0: -1}
    for item, w in enumerate(units):
        for total in [s + w for s in entered]:
            entered.setdefault(total, item)
    return entered


def test_first_items():
    draw = random.Random(1)
    for _ in range(400):
        most, factor = draw.choice([1, 2, 3, 10, 50, 200]), draw.choice([1, 2, 7])
        units = [draw.randint(1, most) * draw.choice([1, 1, factor]) for _ in range(draw.randint(0, 40))]
        assert {i: int(x) for i, x in enumerate(first_items(units)) if x > NEVER} == plain(units)


def test_many_items():
    draw = random.Random(2)
    units = [draw.randint(10, 120) for _ in range(40_000)]
    began = time.process_time()
    assert (first_items(units)[200:-200] > NEVER).all()
    assert time.process_time() - began < 30  # hours in the plain fold
