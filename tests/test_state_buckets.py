"""Customers and devices that share a bucket of state keep results of their own and cost few entries."""

import pytest
from test_state import HOUR, START, feed, same_as_batch, txn

from riskloom.streaming import stateful as S


@pytest.mark.parametrize("late", [True, False])
def test_customers_of_a_bucket_share_entries(spark, monkeypatch, late):
    monkeypatch.setattr(S, "BUCKETS", 2, raising=False)
    rows = [txn(i, START + i * 45_000_000 + (i % 3) * (1 if late else 40 * HOUR), customer=f"c{i % 60}", device=f"d{i % 11}", merchant=f"m{i % 4}",
                amount=5.0 + i % 17, **(dict(lat=10.0 + i % 5, lng=70.0 + i % 3) if i % 4 else {})) for i in range(240)]
    batches = [rows[::3], rows[1::3], rows[2::3]]  # late rows, or expired ones, of every customer
    emitted, progress = feed(spark, batches, "10 days" if late else "1 hour")
    same_as_batch(spark, emitted, rows)
    held = [operator.numRowsTotal for operator in progress[-1][-1].stateOperators]
    assert max(held) < 150  # a head and a chunk per customer made over 180
