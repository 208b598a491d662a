import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fiscolake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = build_session("local[4]", 4, **{
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(root / "shared"),
        "spark.sql.warehouse.dir": str(root / "warehouse")})
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a column function to a list of values."""
    def run(function, values, kind="string"):
        names = [f"c{i}" for i in range(len(values[0]))] if isinstance(values[0], tuple) else ["c0"]
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        kinds = kind.split(",") if "," in kind else [kind] * len(names)
        schema = "i int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
        df = spark.createDataFrame(rows, schema)
        out = df.select("i", function(*[df[n] for n in names]).alias("v"))
        return [r.v for r in sorted(out.collect(), key=lambda r: r.i)]
    return run
