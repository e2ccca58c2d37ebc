"""The composed chain on a hand-made gene."""

from isoloom.operators.filters import EventFilter
from isoloom.plans import pipeline as P


def test_chain_from_exons_to_model(spark):
    exons = [("t1", 1, 101, 200), ("t1", 1, 301, 400), ("t1", 1, 501, 600), ("t2", 1, 101, 200), ("t2", 1, 501, 600), ("t3", 2, 2001, 2100), ("t3", 2, 2201, 2300)]
    df = spark.createDataFrame([(t, g, "chrZ", "+", s, e, "protein_coding", "1") for t, g, s, e in exons], "tx string, gene int, seq string, strand string, start long, end long, biotype string, tsl string")
    ref = P.build_reference(df, ["protein_coding"], "nonsense_mediated_decay")
    events = {r.event_type: r for r in ref["events"].collect()}
    se = events["SE"]
    assert (se.event1a, se.event2a, se.event1b, se.region) == ("chrZ:201-300/+", "chrZ:401-500/+", "chrZ:201-500/+", "chrZ:201-500/+")
    assert (se.jg_up, se.jg_down) == ("1_1", "1_2") and se.event_name.startswith("SE:t1-exon2;t2-int1")
    assert {r.locus for r in ref["measurable"].collect()} == {"chrZ:201-300/+", "chrZ:401-500/+", "chrZ:2101-2200/+"}  # the skip holds an exon

    jump = lambda s, e: [(s - 20, s - 1), (e + 1, e + 20)]
    frags = [("A", jump(201, 300))] * 3 + [("A", jump(401, 500))] + [("A", jump(201, 500))] * 2 + [("A", [(190, 310)])] * 4 + [("B", jump(2101, 2200))] * 5
    fr = spark.createDataFrame([(s, "chrZ", "+", b) for s, b in frags], "sample string, seq string, direction string, blocks array<struct<start:bigint,end:bigint>>")
    cond = spark.createDataFrame([("A", "x"), ("B", "y")], "sample string, condition string")
    counts = P.quantify(fr, ref)
    assay = P.collate(ref, counts, cond)
    rows = {(r.event_id, r.sample): r for r in assay.collect()}
    assert len(rows) == 2 * (len(events) + 3) and {r.condition for r in rows.values()} == {"x", "y"}
    a, b = rows[se.event_id, "A"], rows[se.event_id, "B"]
    assert (a.included, a.excluded, a.up_inc, a.down_inc) == (2.0, 2.0, 3.0, 1.0) and (b.included, b.excluded, b.depth) == (0.0, 0.0, 0.0)
    assert a.coverage == 3 / 5 or a.coverage == 1.0  # upstream island: 5 reads, 3 + 2 of them the event's
    ir = {r.locus: r for r in counts["introns"].where("sample = 'A'").collect()}["chrZ:201-300/+"]
    assert (ir.depth, ir.coverage, ir.splice_exact, ir.splice_left, ir.span_left, ir.span_right) == (4.0, 1.0, 3, 5, 4, 4)
    model = P.make_model(ref, assay, cond)
    assert {r.event_id for r in model.filtered([EventFilter("Depth", 50, 1, types=("SE",)), EventFilter("ExclusiveMXE")]).assay.collect()} >= {se.event_id}
    assert model.row_data.count() == len(events) + 3


def test_filters_without_their_tables_raise(spark):
    import pytest

    from isoloom.operators.filters import apply_filters, casette_exons, exclusive_mxe
    from isoloom.plans import views as V

    assay = V.assays(spark, "/root/testdata/sf0.001")
    for kind in ("ExclusiveMXE", "Terminus"):
        with pytest.raises(ValueError):
            apply_filters(assay, [EventFilter(kind)])
    mxe = spark.createDataFrame([(1, "c:11-20/+", "c:31-50/+", "c:11-34/+", "c:41-50/+"), (2, "c:11-20/-", "c:31-50/-", "c:11-26/-", "c:41-50/-")], "event_id long, event1a string, event2a string, event1b string, event2b string")
    got = {r.event_id: (r.a_start, r.a_end, r.b_start, r.b_end) for r in casette_exons(mxe).collect()}
    assert got == {1: (21, 30, 35, 40), 2: (21, 30, 27, 40)}
    assert {r.event_id: r.passed for r in exclusive_mxe(casette_exons(mxe)).collect()} == {1: True, 2: False}
