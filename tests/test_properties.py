"""Properties over the stand-in inputs of the smallest test tables."""

from pyspark.sql import functions as F

from crewgate.functions import exprs as X
from crewgate.operators import companies, flags, quality, workers
from crewgate.plans import catalog as Q
from crewgate.sources import testviews as V

SF = "/root/testdata/sf0.001"


def seqs(df):
    return sorted(r[0] for r in df.select("seq").collect())


def test_outcomes_partition_the_input(spark):
    W, C, R = V.workers(spark, SF), V.companies(spark, SF), V.roles(spark, SF)
    cand = V.company_candidates(spark, SF)
    _, out = companies.add_companies(cand, C)
    assert seqs(out) == seqs(cand)
    wc = V.worker_candidates(spark, SF)
    _, out = workers.add_workers(wc, W, C)
    assert seqs(out) == seqs(wc)
    ed = V.worker_edits(spark, SF)
    _, out = workers.edit_workers(ed, W, C, R)
    assert seqs(out) == seqs(ed)
    ch = V.flag_change_records(spark, SF)
    assert seqs(flags.change_outcomes(ch, W, C)) == seqs(ch)


def test_accepted_companies_never_conflict(spark):
    C = V.companies(spark, SF)
    cand = V.company_candidates(spark, SF)
    new_c, out = companies.add_companies(cand, C)
    acc = cand.join(out.where("outcome = 'accepted'"), "seq").select(
        X.name_key("company_name").alias("nk"), X.typed_vat_key("vat_number").alias("vk"))
    n = acc.count()
    assert acc.select("nk").distinct().count() == n
    assert acc.where("vk is not null").select("vk").distinct().count() == \
        acc.where("vk is not null").count()
    # and none of them matches a stored company
    assert quality.existing_companies(
        cand.join(out.where("outcome = 'accepted'"), "seq").select(cand.columns), C).count() == 0
    # ids continue after the largest stored id, densely, in seq order
    top = C.agg(F.max("company_id")).first()[0]
    got = [r["company_id"] for r in out.where("outcome = 'accepted'").orderBy("seq").collect()]
    assert got == list(range(top + 1, top + 1 + n))


def test_cascade_leaves_no_orphans(spark):
    W, C, R = V.workers(spark, SF), V.companies(spark, SF), V.roles(spark, SF)
    new_c, new_w, _ = companies.delete_companies(V.company_deletions(spark, SF), C, W)
    assert quality.orphans(new_w, new_c, "company_id", "company_id", "worker_id").count() == 0
    new_r, w2, _ = workers.delete_roles(V.role_deletions(spark, SF), R, W)
    assert quality.orphans(w2, new_r, "role_id", "role_id", "worker_id").count() == \
        quality.orphans(W, R, "role_id", "role_id", "worker_id").count()


def test_bulk_load_resolves_every_company(spark):
    w = Q.QUERIES["bulk_load"](spark, SF)
    c = Q.QUERIES["bulk_load_companies"](spark, SF)
    out = Q.QUERIES["bulk_load_outcomes"](spark, SF)
    # only a refused company name leaves a worker without a company
    refused = out.where("outcome = 'loaded' and warning = 'company_too_long'").count()
    assert refused > 0 and w.where("company_id is null").count() == refused
    assert w.select("worker_id").distinct().count() == w.count()
    assert c.select("company_name").distinct().count() == c.count()
