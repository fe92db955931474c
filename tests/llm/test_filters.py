"""The fingerprint's sixteen filters against plain sums over the cells of the image."""

import math

import numpy as np


def plain(image, t, kind, y, h, w, classes):
    cell = lambda i, p: float(image[t + i][p % classes])
    total = lambda times, pitches: math.fsum(cell(i, p) for i in times for p in pitches)
    half_h, half_w = max(1, h // 2), max(1, w // 2)
    low, high = range(y, y + half_h), range(y + half_h, y + 2 * half_h)
    early, late = range(half_w), range(half_w, 2 * half_w)
    if kind == 0:
        return total(range(w), low), total(range(w), high)
    if kind == 1:
        return total(early, range(y, y + h)), total(late, range(y, y + h))
    if kind == 2:
        return total(early, low) + total(late, high), total(early, high) + total(late, low)
    band = total(range(w), range(y, y + h))
    rest = total(range(w), range(y + h, y + classes))
    return band, rest * h / (classes - h)


def test_filters_by_plain_sums():
    from tessera.llm import chroma as C

    assert len(C.FILTERS) == 16
    rng = np.random.default_rng(5)
    gray = [0, 1, 3, 2]
    for image in (rng.random((C.SPAN + 9, C.CLASSES)).astype(np.float32), rng.dirichlet(np.full(C.CLASSES, 0.2), C.SPAN + 4).astype(np.float32)):
        found = C.fingerprint(image)
        assert len(found) == len(image) - C.SPAN + 1
        for t, packed in enumerate(found.tolist()):
            for i, (kind, y, h, w) in enumerate(C.FILTERS):
                a, b = plain(image, t, kind, y, h, w, C.CLASSES)
                value = math.log((1e-2 + a) / (1e-2 + b))
                if min(abs(value - s) for s in C.STEPS) > 1e-6:
                    assert packed >> (2 * i) & 3 == gray[sum(value > s for s in C.STEPS)], (t, i)
    assert len(C.fingerprint(np.zeros((C.SPAN - 1, C.CLASSES), np.float32))) == 0
