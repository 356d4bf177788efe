import hashlib

import duckdb

from lexmill.plans import text_queries as q


def test_a_case_beyond_one_part_is_whole(spark, tmp_path):
    chunks = [(1, "理由", k, f"段{k}") for k in range(1, 451)] + [(1, "理由", None, f"無號{k:03}") for k in range(300)] + [(1, "主文", 7, "主文。"), (1, "主文", 7, "主文。"), (2, "全文", 3, "短"), (3, "附錄", 1, "不計"), (None, "理由", 1, "無案")]
    spark.createDataFrame(chunks, "case_id int, section string, chunk_no int, content string").repartition(3).write.parquet(str(tmp_path / "judgement_chunks.parquet"))
    got = {r["case_id"]: r for r in q.case_whole(spark, str(tmp_path)).collect()}
    text = [c for s in ("主文", "理由") for _, c in sorted({(10**9 if k is None else k, c) for i, x, k, c in chunks if i == 1 and x == s})]
    hashes = [hashlib.md5(" ".join(text[i : i + 200]).encode()).hexdigest() for i in range(0, len(text), 200)]
    assert set(got) == {1, 2} and (got[1]["n_chunks"], got[1]["n"], got[1]["n_parts"]) == (751, len(" ".join(text)), 4)
    assert got[1]["text_digest"] == hashlib.md5(" ".join(hashes).encode()).hexdigest()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW judgement_chunks AS SELECT * FROM read_parquet('{tmp_path}/judgement_chunks.parquet/*.parquet')")
    assert sorted(con.sql(q.SQL["case_whole"]).fetchall()) == sorted(tuple(r) for r in got.values())
