"""Every checked query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks import all_entries
from checks.compare import differences
from netweave.operators import featurize
from netweave.plans import ordering

ENTRIES = all_entries()


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, small, name):
    entry = ENTRIES[name]
    if entry.sql is None:
        assert entry.run(spark, small).count() > 0
    else:
        assert differences(spark, small, entry.run, entry.sql) == []


# Queries whose plan cuts the ordered table once it is large.
ORDERED = """buffer_epochs inter_packet_gaps robust_scaler_transform sequence_familiarity sliding_sequences
latest_sequence bounded_history training_window_join running_counters batch_losses train_validation_split
dynamic_threshold dynamic_threshold_flags early_stopping registry_append flagged_sequences""".split()


@pytest.mark.parametrize("name", ORDERED)
def test_query_in_many_pieces(spark, small, name, monkeypatch):
    whole = ordering.find_splits
    monkeypatch.setattr(ordering, "find_splits", lambda df, order, *_: whole(df, order, 60))
    monkeypatch.setattr(featurize, "MAX_LITERAL_WINDOWS", 0)
    entry = ENTRIES[name]
    assert differences(spark, small, entry.run, entry.sql) == []


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
