"""Random texts for the tests."""

import random


def words(n, seed=0, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def prose(n, seed=0):
    """n words in sentences of 8 to 14 words, several to a line."""
    r, out = random.Random(seed), []
    w = words(n, seed)
    while w:
        k = r.randrange(8, 15)
        out.append(" ".join(w[:k]) + "." + ("\n" if r.random() < 0.4 else " "))
        w = w[k:]
    return "".join(out).strip()
