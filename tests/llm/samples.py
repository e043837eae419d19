"""Texts for the tests: prose by seed, and rows with nulls, empty and long texts, ties and a repeated row."""

WORDS = [a + b + c for a in ("tr", "mo", "ka", "li") for b in ("a", "en", "os", "ir") for c in ("n", "ta", "re", "s")]


def prose(n, seed):
    """n words that differ from those of other seeds in their order."""
    out, state = [], seed * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)])
    return " ".join(out)


LONG = prose(6000, 99)
ROWS = [
    (1, prose(80, 1), "x"),
    (2, prose(80, 2), None),
    (3, prose(80, 1).upper(), "x"),
    (4, None, "x"),
    (5, "", None),
    (6, "  \n ", "x"),
    (7, LONG, "x"),
    (8, LONG, "x"),
    (9, prose(40, 3) + " " + prose(60, 1) + " " + prose(30, 4), "x"),
    (10, prose(79, 2) + " other", "x"),
    (11, "short text", "x"),
    (11, "short text", "x"),
    (12, "Ünïcode ÄÖ words, twice. Ünïcode ÄÖ words, twice.", None),
]
