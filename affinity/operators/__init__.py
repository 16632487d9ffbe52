from affinity.operators.context import (
    interaction_matrix, recommend_items_in_context, recommend_users_in_context, similar_items,
    similar_users, with_matrices,
)
from affinity.operators.dictionary import (
    block_of, build_dictionaries, build_dictionary, decode, dense_index, distinct_terms, encode, feature_layout,
)
from affinity.operators.factors import (
    MFModel, by_score, factors_of, predict_one, predict_pairs, recommend_items, recommend_users,
    rmse, score_pairs, train_als,
)
from affinity.operators.machine import (
    CARModel, fm_params, fm_score_points, predict_context, predict_points, score_context,
    solve_block, train_fm, train_fm_blocks,
)
from affinity.operators.points import (
    active_item_columns, active_items, active_user_columns, active_users, assemble_features,
    block_widths, context_subset, dense_points, encode_context, filter_columns, filter_context,
    made_once, points_of_user, rated_items_block, sparse_points,
)
from affinity.operators.preferences import (
    build_context_preferences, build_preferences, last_transaction, rated_items, related_item,
)
from affinity.operators.rules import (
    closed_rules, distinct_baskets, match_rules, mine_top_k_rules, minimal_generators,
    recommend_from_rules, rules_of_users,
)
from affinity.operators.topk import top_k_scores, unit_rows

__all__ = [n for n in dir() if not n.startswith("_")]
