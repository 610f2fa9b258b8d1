import os
import sys

import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

from tessera.llm import oracle as sql  # noqa: E402
from tessera.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_hash_in_sql():
    con = oracle.connect(SF)
    texts = "['', 'a', 'abcd', 'abcdefgh', 'abcdefghijk', 'the quick brown fox', 'x' || repeat('abcdefg', 9), repeat('é', 40)]"
    for seed in (42, (1 << 64) - 3):
        rows = con.execute(f"WITH k AS (SELECT unnest({texts}) AS t), {sql.xxh64('z', 'k', 't', str(seed))} SELECT t, h FROM z").fetchall()
        assert len(rows) == 8 and all(h == xxhash.xxh64_intdigest(t.encode(), seed) for t, h in rows)


@pytest.mark.parametrize("name", list(sql.oracle_sql()))
def test_query(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF) == {"op11_vectors": 500, "op12_dialogues": 20}.get(name, 200)
