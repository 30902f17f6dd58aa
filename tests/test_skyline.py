"""A sweep over a dense pile meets few owners for each box."""

import random

from strandline.operators.boxes import Skyline


def test_a_dense_pile_meets_few_owners():
    """Boxes of many reaches alive at once: owners met are in proportion to boxes, and tie together what overlaps."""
    draw, sky, top, met = random.Random(1), Skyline(), {}, 0

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    boxes = []
    for i in range(3000):
        y = draw.randrange(5000)
        boxes.append((i, i + draw.randrange(500, 3000), y, y + draw.randrange(100, 400)))
    for i, (x0, x1, y0, y1) in enumerate(boxes):
        top[i] = i
        owners = sky.add(x0, x1, y0, y1, i)
        met += len(owners)
        for other in owners:
            top[root(other)] = root(i)
    assert met <= 3 * len(boxes)
    for i in range(0, 3000, 7):
        for j in range(i):
            if boxes[j][1] > boxes[i][0] and boxes[j][2] < boxes[i][3] and boxes[i][2] < boxes[j][3]:
                assert root(i) == root(j)


def test_wide_boxes_over_far_ones():
    """200 low boxes reach further than 300 high ones over all of them: their owners are met once, not by each high box."""
    sky, met = Skyline(), 0
    for i in range(200):
        met += len(sky.add(0, 10_000 + i, 2 * i, 2 * i + 1, i))
    for i in range(200, 500):
        met += len(sky.add(i, i + 5, 0, 400, i))
    assert met <= 3 * 500
