"""Registration: one query for each operator, the contracts' columns, and the SQL where there is some."""

import duckdb
import pytest

from contestlab.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": "doc_id held_out score predicted",
    "op3": "doc_id size source_size target taken",
    "op5": "doc_id fingerprint component_id",
    "op6": "query_id rank vec_id score",
    "op7": "doc_id size text_crc32 law shard slot grown_shard",
    "op8": "vec_id n_links component_id kept",
    "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op11": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op13": "vec_id component n deviation whitened explained identity_error",
    "op10": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, SF)
    want = COLUMNS.get(name.split("_")[0], "").split()
    assert got.columns[: len(want)] == want
    rows = got.collect()
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
        found = con.execute(ORACLES[name])
        order = [got.columns.index(c[0]) for c in found.description]
        plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
        assert sorted((plain(r[i] for i in order) for r in rows), key=repr) == sorted(map(plain, found.fetchall()), key=repr)


def test_reruns_agree(spark):
    one, two = (sorted(tuple(r) for r in QUERIES["op3_mixing"](spark, SF).collect()) for _ in range(2))
    assert one == two
