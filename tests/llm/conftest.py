import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Rows of a registered query on a folder of tables equal its DuckDB text's rows."""
    from flankwear.llm import queries

    def check(name: str, sf_dir: str, tables=("documents", "embeddings", "pages", "conversations", "benchmark")):
        con = duckdb.connect()
        for t in tables:
            if (p := Path(sf_dir, f"{t}.parquet")).exists():
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
        df = queries.QUERIES[name](spark, str(sf_dir))
        cols = sorted(df.columns)
        cur = con.execute(queries.ORACLE[name])
        at = {x[0]: i for i, x in enumerate(cur.description)}
        assert sorted(at) == cols
        want = sorted((tuple(r[at[c]] for c in cols) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want
        return want
    return check
