from pyspark.sql import functions as F

import corpus_pipeline as P
from tapewright.llm.common import fold_of, table
from tapewright.llm.decontam import contaminated
from tapewright.llm.near_dedup import near_duplicates
from tapewright.llm.quality import fit_quality, with_quality

from .helpers import empty_docs, odd_docs, odd_rows


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = start = table(spark, sf, "documents")
    seen = []
    for name, stage in P.STAGES:
        before, docs = docs, P.materialise(stage(spark, docs, sf), f"t-{name}")
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if name == "quality":
            model = fit_quality(start, table(spark, sf, "labels"), fold_of("doc_id", 4) != 2)
            assert ids == {r[0] for r in with_quality(before, model, "s").where("s >= 0.7").select("doc_id").collect()}
        if name == "lines":
            assert ids == {r[0] for r in before.select("doc_id").collect()} and docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "near_dedup":
            assert ids == {r[0] for r in near_duplicates(before, 80).where("kept").select("doc_id").collect()}
        if name == "decontamination":
            bad = {r[0] for r in contaminated(before, table(spark, sf, "benchmark")).select("doc_id").collect()}
            assert bad and ids == {r[0] for r in before.select("doc_id").collect()} - bad
        if name != "mixing":
            assert docs.columns == start.columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert P.run(spark, sf).exceptAll(docs).count() == 0


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns: what each stage keeps, row by row."""
    sf = "/root/testdata/sf0.001"
    rows = odd_rows()
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)
    every = sorted(((r[0], r[1]) for r in rows), key=repr)
    for name, stage in P.STAGES:
        out = P.materialise(stage(spark, odd_docs(spark), sf), f"odd-{name}")
        got = texts(out)
        if name != "mixing":
            assert out.columns == odd_docs(spark).columns
        if name == "quality":  # equal texts are judged alike, with and without an id
            assert set(got) <= set(every) and len({(r[1] or "") in {t or "" for _, t in got} for r in rows if not (r[1] or "")}) == 1
            assert all(got.count(x) == every.count(x) for x in set(got))
        elif name == "lines":  # one line stands on three documents of src2: they keep an empty text
            assert got == sorted(((i, "" if t == "one two" else t) for i, t in every), key=repr)
        elif name == "near_dedup":  # 6 and 7, the two of 5 and 8, and 1 with its copy without an id are groups; rows without an id stay
            assert got == sorted([(1, rows[0][1]), (2, None), (3, ""), (None, rows[3][1]), (4, rows[4][1]), (5, "one two"), (6, rows[7][1]), (None, None)], key=repr)
        elif name == "decontamination":
            assert got == every
        else:
            assert {x[0] for x in got} <= {x[0] for x in every} and out.agg(F.min("copies")).first()[0] >= 1
        none = P.materialise(stage(spark, empty_docs(spark), sf), f"none-{name}")
        assert none.count() == 0
