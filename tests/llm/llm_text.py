"""Made-up texts for small fixtures."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text_of(seed: int, n: int) -> str:
    """n words in an order fixed by the seed; repeats are rare enough to make different shingles."""
    state, out = seed * 2654435761 % (1 << 32) or 1, []
    for _ in range(n):
        state = (state * 1664525 + 1013904223) % (1 << 32)
        out.append(WORDS[state >> 27 & 15] + WORDS[state >> 20 & 15][:3] + str(state >> 16 & 7))
    return " ".join(out)
