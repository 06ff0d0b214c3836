"""The SQL of the operators gives the same rows, over the smallest tables and over odd ones."""

import random

import duckdb
import pytest

from lodestone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_tables(spark, odd_rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    more = [(300 + i, "the mit license " * i + "permission is hereby granted free of charge to any person obtaining a copy of this software " * (i % 3), "en", "src1", 1) for i in range(8)]
    spark.createDataFrame([*odd_rows, *more], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    r = random.Random(2)
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [r.uniform(-2, 2) for _ in range(16)], r.choice([None, 1, 2])) for i in range(0, 2000, 7)] + [(5000 + i, [0.5] * 16, 3) for i in range(101)]
    vectors += [vectors[1], vectors[100], (9000, [nan] * 16, 1), (9100, [inf, *[0.0] * 15], 1), (9200, [None, *[0.0] * 15], 1), (9300, None, 1), (None, vectors[5][1], None), (9400, [-1e-9] * 16, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, odd_tables, name):
    for folder, files in ((SF, ""), (odd_tables, "/*.parquet")):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{files}'")
        df = QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
        rel = con.sql(ORACLES[name])
        assert sorted(rel.columns) == columns
        assert got == sorted(map(str, rel.project(", ".join(columns)).fetchall()))
