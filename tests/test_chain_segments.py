"""The chain is the same however many tasks link it, and no task links more than a segment."""

from pyspark.sql import functions as F

from attesta.sources import ledger


def test_segments_link_to_one_chain(spark, monkeypatch):
    actors = ["agent:\x1f \"q\" \\ é", "agent:b", None]
    said = [(i * 7 if i % 5 else None, "observation", actors[i % 3], f"{i:064x}" if i % 4 else "no/hash\n", None if i % 2 else f"s{i}", None) for i in range(500)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(said)], "n long, ts long, kind string, actor string, payload_hash string, source_ref string, context_sig string").orderBy(F.hash("n"))
    prev, want = "ab" * 32, []
    for seq, row in enumerate(said, 4):
        own = ledger.event_hash(seq, *row, prev)
        want.append((seq, *row, prev, own))
        prev = own
    link, lengths = ledger._link, []
    monkeypatch.setattr(ledger, "_link", lambda rows, *more: (lengths.append(rows.count()), link(rows, *more))[1])
    for segment, least in ((1000, 1), (90, 5)):
        lengths.clear()
        monkeypatch.setattr(ledger, "SEGMENT", segment)
        out = ledger.chain(rows, ["n"], (3, "ab" * 32))
        assert sorted(map(tuple, out.collect())) == want
        assert len(lengths) >= least and max(lengths) <= 2 * segment
    assert ledger.chain(rows.limit(0), ["n"]).count() == 0
