"""Made-up prose for the tests."""

from __future__ import annotations

import random


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < words:
        s = ["".join(r.choice(("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 12))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:words])
