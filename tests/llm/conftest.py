import pytest

from .helpers import prose

DOCS = "doc_id long, text string, lang string, component_id long, kept boolean, dropped string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, copies, and columns whose names the operators use."""
    base, other = prose(1, 200), prose(2, 200)
    near = base.split()
    near[7] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, other), (5, None), (6, ""), (7, "  \n\t "), (8, "One"), (9, "one"), (10, prose(3, 40_000)), (11, "x" * 300_000),
        (12, other.upper()), (None, base), (13, prose(5, 30)), (13, prose(5, 30)), (14, prose(6, 30)), (14, other), (15, "a\nb\na\n\nb"), (16, "Ünï 𝒳 " + prose(7, 20)),
    ]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", 77, None, "z") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
