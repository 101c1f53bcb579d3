"""Made-up tables and brute-force versions for the text operators."""

from __future__ import annotations

import random

AWKWARD = [None, "", " ", "\n\n", "A", "a", "the the the the the the the the the the the the the the", "é" * 60, "x" * 700, "tab\tand\x0bfeed\x0c.", "nul \x00 in it", "Zeile mit ÄÖ\nZeile mit ÄÖ"]


def texts(seed: int = 1, count: int = 60) -> list[str | None]:
    """Awkward texts, random prose, exact copies in other case, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    passage, out = prose(40), list(AWKWARD)
    for i in range(count):
        text = prose(rng.randint(1, 200))
        out.append(text)
        if i % 4 == 0:
            out.append(text.upper() if i % 8 else text)
        if i % 5 == 0:
            parts = prose(150).split(" ")
            out.append(" ".join(parts))
            parts[rng.randrange(len(parts))] = "changed"
            out.append(" ".join(parts))
        if i % 6 == 0:
            out.append(prose(10) + "\n" + passage + "\n" + prose(5))
            out.append(prose(3) + passage + prose(5))
    out.append(prose(9_000))
    return out


#: Names that operators and stages use inside.
INSIDE = ("key fp node label size block _kept _kept_text _text _copy _id _words _all _rows _own _turn row id digest spelled copy kept_id kept_text turn "
          "mixed_id mixed_size all_copies all_rows kept_sha256 toxic terms score n sid x q a b sig part keys sketch least class component_id start end ids").split()
SCHEMA = "n_chars long, doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in INSIDE)


def table(spark, rows: list[tuple[int | None, str | None, str | None]]):
    """(doc_id, text, source) with extra columns whose names the operators use inside."""
    data = [(1, d, t, s, *[7] * len(INSIDE)) for d, t, s in rows]
    return spark.createDataFrame(data, SCHEMA)


def corpus(seed: int = 1, count: int = 60) -> list[tuple[int | None, str | None, str | None]]:
    found = texts(seed, count)
    random.Random(seed).shuffle(found)
    return [(3 * i + 1, t, [None, "b", "a", "ä"][i % 4]) for i, t in enumerate(found)]
