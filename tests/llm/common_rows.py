"""Rows every operator must survive, and brute-force helpers."""

from __future__ import annotations

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n: int, seed: int = 0, lead: str = "w") -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"{lead}{WORDS[x % len(WORDS)]}{x // 64 % 97}")
    return " ".join(out)


def awkward(spark):
    """Nulls, empty and blank texts, repeats of rows and ids, a long text; extra columns with clashing names."""
    rows = [(1, prose(60, 1)), (2, prose(60, 1)), (2, prose(60, 1)), (3, None), (4, ""), (5, " \n\t "), (None, prose(60, 1)),
            (None, None), (6, "short text"), (7, "short text"), (7, prose(30, 2)), (8, prose(6000, 3)), (9, "é\U0001F600 café")]
    frame = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 0.5, 1, "x") for i, t in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long, score double, n long, node string")
    return frame, rows


def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
