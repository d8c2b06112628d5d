import random

import pyarrow.parquet as pq
import pytest

#: Columns whose names the operators use themselves.
CLASHES = {"h": 1, "n": "x", "w": 2.5, "a": 3, "m": None, "key": "k", "id0": -7, "rep": "r", "component": 5, "part": "p", "stats": "s", "score": 0.25, "seq": 9, "file": "f", "found": True}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, n string, w double, a int, m string, key string, id0 int, rep string, component int, part string, stats string, score double, seq int, file string, found boolean"


def words(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def rows() -> list[tuple]:
    """Documents of every odd kind: nulls, empty and white texts, copies, near copies, shared passages, repeated rows, a long text."""
    base, passage = words(1, 120), words(2, 60)
    near = base.copy()
    near[50] = "changed"
    apart = [w if i % 9 else "other" for i, w in enumerate(base)]
    texts = {
        1: " ".join(base), 2: " ".join(near), 3: " ".join(base), 4: " ".join(apart), 5: None, 6: "", 7: " \n\t ", 8: "one", 9: "Une  Année à l'École\x0bété", 10: "one two three four",
        11: " ".join(words(3, 40) + passage + words(4, 30)), 12: "\n".join(passage) + "\n" + " ".join(words(5, 80)), 13: " ".join(words(6, 20_000)), 14: " ".join(["same"] * 90), 15: "ONE Two three FOUR",
        16: " ".join(words(7, 35)), 17: " ".join(words(7, 35)), 18: " ".join(words(8, 34)), 19: " ".join(words(8, 34)), 20: "\U0001d11eßİ Kſ" * 20,
    }
    out = [(i, t, "en" if i % 2 else None, "src", len(t) if t is not None else None) for i, t in texts.items()]
    out += [(1, texts[1], "en", "src", len(texts[1]))]  # a repeated row
    out += [(None, " ".join(words(9, 50)), None, None, None), (None, None, None, None, None)]
    return out


def row_groups(written) -> list[int]:
    """Rows of each row group of a written table."""
    files = [pq.ParquetFile(x.removeprefix("file://")).metadata for x in written.inputFiles()]
    return [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, *CLASHES.values()) for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
