"""Awkward rows shared by the tests: nulls, empty and long texts, ties, repeated rows."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, pl long, host string"


def prose(seed: int, n: int, letters: str = "abcdefghij") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


def awkward_docs() -> list[tuple]:
    a, b, shared = prose(1, 80), prose(2, 90), prose(3, 40)
    texts = {
        1: a, 2: a, 3: b + " " + shared, 4: shared + " " + prose(4, 60), 5: None, 6: "", 7: " \t\n", 8: "ab" * 400,
        9: "word " * 300, 10: prose(5, 30) + " " + shared + "é漢😀 " + prose(6, 9), 11: "x" * 99, 12: "x" * 100, 13: "x" * 350,
        14: prose(7, 4000), 15: prose(7, 4000)[:9000] + "!", 16: "short", 17: a.upper(), 18: a[:300] + "\u0000" + a[300:],
        -4: a.replace("a", "A"), 20: "é" * 200,
    }
    rows = [(k, t, "en" if k % 2 else None, "s", None, 7, 8, "h") for k, t in texts.items()]
    rows += [rows[0], rows[2], (None, a, "en", None, 1, 1, 1, None), (None, None, None, None, None, None, None, None)]
    return rows


def awkward_frame(spark):
    return spark.createDataFrame(awkward_docs(), DOC_SCHEMA).repartition(3)


def components(nodes, links):
    """Smallest reachable node of every node, by brute force."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low
