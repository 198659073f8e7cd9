"""Edit distances for tests."""

from __future__ import annotations


def best_match(item: bytes, region: bytes, most: int) -> int:
    """The least edit distance between the item and any stretch of the region; most + 1 if it is greater."""
    if item in region:
        return 0
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    plus, minus, score, best, left = full, 0, m, m, len(region)
    for c in region:  # Myers' bit vectors
        left -= 1
        eq = places.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up = minus | (~(d | plus) & full)
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(d | up) & full)
        minus = up & d
        if score < best:
            best = score
        elif score - left > most:
            break  # no later place can be near enough
    return min(best, most + 1)
