"""What rounds to zero from below is minus zero, as in SQL."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from manyvec.plans.algebra import weights
from manyvec.plans.catalog import ORACLES, QUERIES


def test_projections_keep_the_sign_of_zero(spark, tmp_path):
    import duckdb

    w, v = np.array(weights(4)), []
    for row in w:  # one tiny negative and one tiny positive value in each place
        for sign in (-1, 1):
            x = np.zeros(64)
            x[0] = sign * 1e-7 / row[0] if row[0] else 0.0
            v.append(x.astype(np.float32))
    table = pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "embedding": pa.array([x.tolist() for x in v], pa.list_(pa.float32())), "label": pa.array([0] * len(v), pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    found = {r["vec_id"]: [str(x) for x in r["v"]] for r in QUERIES["projected_vectors"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {i: [str(x) for x in xs] for i, xs in con.sql(ORACLES["projected_vectors"]).fetchall()}
    assert found == want and "-0.0" in want[0]
