"""Queries over tables as larger inputs bring them: samples beyond 16 bits, silence, addresses that repeat, sums that tie."""

import math

import duckdb
import pytest

from kelpie.plans import registry
from kelpie.sources import media
from tests.test_queries import FOLDER, TABLES, plain


@pytest.fixture
def same(spark, tmp_path):
    """compare(name, events=SQL over the small tables, ...): the query and its SQL, over tables of which some are replaced."""

    def compare(name, **other):
        folder = tmp_path / name
        folder.mkdir()
        small = duckdb.connect()
        for t in TABLES:
            small.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        for t in TABLES:
            small.execute(f"COPY ({other.get(t, f'SELECT * FROM {t}')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        df = registry.QUERIES[name](spark, str(folder))
        columns = sorted(df.columns)
        got = sorted(repr([plain(x) for x in r]) for r in df.select(*columns).collect())
        cur = con.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())

    return compare


LOUD = "SELECT * REPLACE (CASE WHEN event_id % 50 = 0 THEN value + 656 ELSE value END AS value) FROM events"


@pytest.mark.parametrize("name", ["container_chunks", "gated_stages", "wave_blocks", "wave_hashes", "wave_levels"])
def test_samples_beyond_16_bits(same, name):
    same(name, events=LOUD)


def test_silent_day(same):
    same("crest_timeline", events="SELECT * REPLACE (CASE WHEN user_id = 3 AND event_id % 2 = 0 THEN 0.0 ELSE value END AS value, CASE WHEN user_id = 3 AND event_id % 2 = 0 THEN TIMESTAMP '2024-02-02' ELSE ts END AS ts) FROM events")


def test_silence_has_no_crest(spark):
    blocks = spark.createDataFrame([("a", 0, [0.0, 0.0]), ("b", 0, [0.5, -0.5])], "path string, channel int, samples array<float>")
    assert {r.path: r.crest_db if r.crest_db is None else math.isclose(r.crest_db, 0.0) for r in media.channel_levels(blocks).collect()} == {"a": None, "b": True}


def test_pages_of_one_url(same):
    same("cached_lookup", pages="SELECT * REPLACE ('http://a/' || page_id // 7 AS url) FROM pages")
