import random

import pytest


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(["the", "of", "thonre", "érie", "Straße", "ñoque,", "end.", "日本", "a", "tion\nnext"]) for _ in range(n))


@pytest.fixture(scope="session")
def docs_with_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, a clashing extra column."""
    r = random.Random(5)
    same = prose(r, 80)
    rows = [(i, prose(r, r.choice([1, 3, 40, 300])), "en", f"src{i % 3}", 7, f"x{i}") for i in range(40)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "src0", 0, None), (102, same, "en", "src0", 1, "a"), (103, same, None, None, 1, "a"), (103, same, None, None, 1, "a")]
    rows += [(104, prose(r, 30000), "en", "src1", 1, "a"), (105, " ", "en", "src1", 1, "a"), (106, "a\u0000b  c▁▁d", "en", "src2", 1, "a"), (107, "x" * 70000, "en", "src2", 1, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string")
