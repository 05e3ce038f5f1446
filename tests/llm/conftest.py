import sys
from pathlib import Path

import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a column named like a result."""
    rows = [
        (1, "One two three, four's FIVE.", "en", "a", 3), (2, "One two three, four's FIVE.", "en", "a", 3), (2, "One two three, four's FIVE.", "en", "a", 3),
        (3, None, "fr", None, None), (4, "", None, "b", 0), (5, "  two  spaces \n and \t tabs ", "en", "b", 1), (None, "no id", "de", "a", 2),
        (6, "Straße été 你好 😀 ▁ x", "de", "a", 5), (7, "long " * 3000 + "end", "en", "a", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "'x' AS ids", "1 AS length", "2 AS start", "3 AS score", "'y' AS key", "0 AS n_tokens").repartition(3)
