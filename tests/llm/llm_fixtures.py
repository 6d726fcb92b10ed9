import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORDS = ("the quick brown fox jumps over a lazy dog while seven green birds sing about old rivers and "
         "new mountains near quiet towns where many people walk").split()


def passage(start: int, n: int) -> str:
    return " ".join(WORDS[(start * 7 + i * (1 + start % 5)) % len(WORDS)] + ("." if i % 9 == 8 else "")
                    for i in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, copies, near copies, repeated rows, columns with clashing names."""
    base = passage(1, 60)
    near = base.replace("quick", "slow", 1)
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1), (4, None, "en", "b", None),
            (5, "", "fr", "c", 0), (6, " \n\t ", None, "c", 4), (7, "one two", "en", None, 7), (8, "ONE  two", "en", "d", 8),
            (9, "\n".join(passage(k, 30) for k in range(2, 9)), "de", "e", 9), (10, passage(11, 20000), "en", "e", 9),
            (11, "1234 !!", "en", "f", 7), (12, "Émile ß 日本 ▁ <|im_end|>", "fr", "f", 9), (None, base, "en", "g", 5),
            (13, base + "\n" + passage(3, 25), "en", "h", 5), (13, base + "\n" + passage(3, 25), "en", "h", 5)]
    data = [(*r, 7, 8, 9, 1.5, "x") for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "start long, sequence_id int, key long, score double, line string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("1 = 0")
