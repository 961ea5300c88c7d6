import corpus_pipeline
from crewgate.llm import gam, quality_rules
from crewgate.llm.common import table
from tests.llm.conftest import frame
from tests.llm.test_near_dedup import brute_classes

SF = "/root/testdata/sf0.01"


def staged(spark, docs, scratch, sf=SF):
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{scratch}/{k}"
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_on_documents(spark, scratch):
    docs = table(spark, SF, "documents")
    _, rules, classed, unique, packed = staged(spark, docs, scratch)
    assert rules.columns == classed.columns == unique.columns == docs.columns
    model = quality_rules.fit(docs, table(spark, SF, "labels"))
    assert {r.doc_id for r in rules.collect()} == {
        r.doc_id for r in quality_rules.score(docs, model).where("kept").collect()}
    model = gam.fit(docs, table(spark, SF, "labels"))
    assert {r.doc_id for r in classed.collect()} == {
        r.doc_id for r in gam.score(rules, model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in classed.collect()]
    assert sorted(r.doc_id for r in unique.collect()) == sorted(
        {c for _, c in brute_classes(rows)[1]})
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in unique.collect()}
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    short = {r.doc_id for r in quality_rules.score(docs, None).where("base_failed").collect()}
    assert good - short <= {r.doc_id for r in classed.collect()}      # clean documents stay
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, ran.select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_messy_and_empty_documents(spark, rows, nothing, scratch):
    out = staged(spark, frame(spark, rows), scratch + "/messy")
    assert out[3].schema.names == frame(spark, rows).schema.names
    assert 1 not in {r.doc_id for r in out[1].collect()}
    assert len({r.text for r in out[3].collect()}) == out[3].count()
    assert staged(spark, nothing, scratch + "/empty")[-1].count() == 0
