"""Leads and the messages of their phones, dealt in parts."""

import pytest

from hitweave.operators import leads as L

LEAD, MESSAGE = "lead_id long, phone_number string, own_message_id string", "_id long, message_id string, user_id string, timestamp long"


@pytest.mark.parametrize("dealt", [2, 512])
def test_lead_messages_against_pairs(spark, monkeypatch, dealt):
    monkeypatch.setattr(L, "DEALT", dealt)
    leads = [(i, "p0" if i % 3 else f"p{i % 5}", f"c{i % 9}" if i % 4 == 0 else ("" if i % 4 == 1 else None)) for i in range(40)]
    leads += [(3, "p2", "c1"), (3, "p2", "c1"), (7, "p0", None), (None, "p1", "c1"), (None, "p1", "c5"), (None, "p2", None), (50, None, None), (51, "", "c99"), (52, "px", None), (53, "px", "c1")]
    log = [(i, f"c{i % 12}" if i % 13 else None, f"p{i % 4}" if i % 11 else None, i) for i in range(90)] + [(5, "c5", "p1", 5)]
    wrote = {(u, c) for _, c, u, _ in log if u is not None}
    ids = {(l, c) for l, p, _ in leads if p for u, c in wrote if u == p} | {(l, o) for l, _, o in leads if o}
    want = [(l, m[0]) for l, c in ids for m in log if c is not None and m[1] == c]
    first = [m[0] for m in sorted(log, key=lambda m: (m[3], m[0]))[:3]]
    served = {l for l, _ in ids}
    want += [(l, i) for l, _, _ in leads if l is None or l not in served for i in first]
    out = L.lead_messages(spark.createDataFrame(leads, LEAD), spark.createDataFrame(log, MESSAGE), 3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.lead_id, r._id) for r in out.collect()), key=key) == sorted(want, key=key)


def test_messages_of_a_phone_go_to_parts_of_its_leads(spark):
    leads = spark.createDataFrame([(i, "p") for i in range(3000)], "lead_id long, phone_number string")
    log = spark.createDataFrame([("p", i) for i in range(10)], "phone_number string, _id long")
    out = L._by_phone(leads, log)
    assert out.count() == out.distinct().count() == 30000
    assert "_part" in out._jdf.queryExecution().optimizedPlan().toString()
