import pytest

from conftest import SF, same
from quillon.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_equals_batch(spark):
    from quillon.operators.validate import route
    from quillon.plans.table_queries import _checked_events

    events = catalog.table(spark, SF, "events")
    batch = route(_checked_events(events), events.limit(0), "user_id", order="event_id").where("route = 'keep'")
    stream = catalog.QUERIES["stream_ingest_events"](spark, SF)
    assert sorted(r[0] for r in batch.select("event_id").collect()) == sorted(r[0] for r in stream.select("event_id").collect())
