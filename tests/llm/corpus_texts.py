"""Words and texts of the corpus tests."""

WORDS = "the of and thereof wonder thing ation under straße être año lumière berg keit 12 x_y don't".split()


def text_of(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
