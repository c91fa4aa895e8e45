"""A cross-section of the queries against their SQL twins on the smallest tables."""

import pytest

from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["scan_tsv", "scan_gt", "norm_text", "norm_top2", "key_all", "key_ch7", "ng_comb", "flt_bucket", "join_exact", "join_ch5", "join_two_stage", "blk_generate", "set_except", "sim_lev", "sim_edit", "sim_overlap", "blk_posting", "blk_iface", "flt_country", "sink_missed_csv", "sink_report", "sink_shard", "scan_json", "srch_best", "agg_categ2", "agg_translit", "agg_namesim", "ml_batch", "feat_ranker", "feat_matcher", "pol_evid", "dec_elbow", "cnf_greedy", "agg_detail", "agg_attrib", "agg_prauc", "agg_calib", "agg_errors", "ml_split", "ml_neg_rank", "val_prefix", "link"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    import __spark_entry__ as entry

    compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_no_cartesian_product_in_the_plan(spark):
    from linkweave.plans.queries import Plan

    plan = Plan(spark, SF)
    text = plan.scored._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text
