"""Every registered query of the library at the smallest size, against its SQL where it has some."""

import pytest

from loxodrome.plans import registry
from tests.compare import connection, differing

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert not differing(df, SQL[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry_imports_without_the_llm_folder(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("loxodrome.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "loxodrome.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "group_agg" in entry.queries() and not [k for k in entry.queries() if k.startswith("op") and k[2:3].isdigit()]
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_date_rest_to_the_last_digit(spark, tmp_path):
    """Microseconds around half a millisecond, before 1970 and less than a minute after it."""
    sf_dir = str(tmp_path)
    micros = [0, 1, 499, 500, 501, 1500, 59_999_500, 60_000_500, -1, -499, -500, -501, -1500, 1_704_067_207_179_499, 1_704_067_207_179_500, 1_704_067_207_179_575, 1_705_276_800_000_500, 1_705_276_799_999_999]
    with connection(sf_dir) as con:
        con.sql(f"copy (select cast(i - 1 as bigint) as event_id, make_timestamp({micros}[i]) as ts from range(1, {len(micros) + 1}) r(i)) to '{sf_dir}/events.parquet' (format parquet)")
    df = QUERIES["date_rest"](spark, sf_dir).orderBy("event_id")
    with connection(sf_dir) as con:
        expected = con.sql(f"select {', '.join(df.columns)} from ({SQL['date_rest']}) order by event_id").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(micros) and got == expected
