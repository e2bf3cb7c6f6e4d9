"""Registered queries against their SQL twins on the smallest tables."""

import pytest
from parity import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PICKED = """a5_group_size_by_label a2_children_per_parent a7_agree_rate a8_soft_vote j3_integrity j4_chain_join j7_parent_label
m4_domain m6_key_check m9_long_paths p8_mode_impute p9_rare_collapse p11_snap p14_dense_ids w2_ordinal_unseen w7_leave_one_out
f7_efficacy_scale f17_noise f18_randomised_response o7_covering_split o9_stratified o11_weighted_draws l9_expand_children
l14_synthetic_fk l16_shapes l19_cardinality l22_coverage j13_knn j9_match_repair l25_dcr l24_alpha_beta l29_prdc l27_metrics
l3_em_step l4_variational_step m8_relation_order j15_decode w4_normal_score_order l1_joint_features l13_class_counts x1_smote_rows l25_distances_wide
s4_layouts s7_encode s8_splits s9_scores s6_stages p12_discard""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", PICKED)
def test_query_agrees_with_sql(spark, con, name):
    _, problem = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
