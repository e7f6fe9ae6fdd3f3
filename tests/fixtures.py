"""Small credit fixtures written by the tests themselves (FIXTURES.md shapes)."""

from __future__ import annotations

import os

from tests.conftest import write_text

HEADER = "tconst\tordering\tnconst\tcategory\tjob\tcharacters"
SOURCE = "nm0000102"


def chain_rows(levels: int = 5, fan_out: int = 3) -> list[str]:
    """Chain graph: title k joins one person of level k-1 with ``fan_out`` new
    persons of level k (the golden fixture's shape, built from its rule)."""
    rows = []
    nxt = 1
    linker = SOURCE
    for k in range(1, levels + 1):
        t = f"tt{k:07d}"
        members = [linker] + [f"nm{nxt + i:07d}" for i in range(fan_out)]
        for pos, p in enumerate(members, start=1):
            rows.append(f"{t}\t{pos}\t{p}\tactor\t\tLevel {k}")
        linker = members[1]
        nxt += fan_out
    return rows


def expected_chain_distances(levels: int = 5, fan_out: int = 3) -> dict[str, int]:
    out = {SOURCE: 0}
    nxt = 1
    for k in range(1, levels + 1):
        for i in range(fan_out):
            out[f"nm{nxt + i:07d}"] = k
        nxt += fan_out
    return out


def write_chain(dirname: str) -> str:
    # golden file style: no newline at the end of the file
    return write_text(os.path.join(dirname, "chain.tsv"), [HEADER] + chain_rows(), final_newline=False)


def dirty_principals_rows() -> list[str]:
    """Edge rows: \\N fields, a job starting with an unclosed quote, a non-numeric
    ordering, a null category, a person twice in one title, a one-person title,
    a repeated header row, other roles."""
    return [
        HEADER,
        "tt0000001\t1\tnm0000001\tactor\t\\N\t[\"Self\"]",
        "tt0000001\t2\tnm0000002\tactress\t\"unclosed quote\t\\N",
        "tt0000001\t3\tnm0000002\tactress\t\\N\t\\N",
        "tt0000001\tx\tnm0000003\tproducer\tproducer\t\\N",
        "tt0000002\t1\tnm0000001\tactor\t\\N\t\\N",
        "tt0000002\t2\tnm0000004\t\\N\t\\N\t\\N",
        HEADER,
        "tt0000003\t1\tnm0000005\tactor\t\\N\t\\N",
        "tt0000004\t1\tnm0000003\tproducer\t\\N\t\\N",
        "tt0000004\t2\tnm0000004\tactor\t\\N\t\\N",
        "tt0000009\t1\tnm0000006\tactor\t\\N\t\\N",
    ]


def ratings_rows() -> list[str]:
    """A null rating, a title without credits (tt0000007), a credited title without
    rating (tt0000009), a duplicate key (tt0000004)."""
    return [
        "tconst\taverageRating\tnumVotes",
        "tt0000001\t6.5\t100",
        "tt0000002\t8.0\t10",
        "tt0000003\t\\N\t5",
        "tt0000004\t5.0\t7",
        "tt0000004\t7.0\t9",
        "tt0000007\t9.9\t1",
    ]
