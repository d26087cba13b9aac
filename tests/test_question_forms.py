"""Forms of questions in odd characters against their SQL."""

import duckdb

from doclattice.plans import registry

TEXTS = [
    "épump ÉAB-1 thé", "pump² the² causé AB́", "pump\x0bvalve ABC\x0b12AB", "ΟΔΟΣ KİT-AB", "pump valve x", "AB- 12ABé насос_ab", "ßpump_ ſ Kelvin",
    "Pump, pump; unpumped", None, "",
]


def test_odd_characters(spark, tmp_path):
    rows = [(c, turn, "user", text) for turn, text in enumerate(TEXTS) for c in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for t in ("documents", "part"):
        db.execute(f"CREATE TABLE {t} (doc_id BIGINT, p_partkey BIGINT)")
    expected = db.execute(registry.oracle_sql()["r19_u6_query_forms"]).fetchall()
    assert sorted(map(repr, map(tuple, registry.queries()["r19_u6_query_forms"](spark, str(tmp_path)).collect()))) == sorted(map(repr, expected))
