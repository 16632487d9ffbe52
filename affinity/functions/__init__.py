from affinity.functions.arrays import (
    cosine, dot, join_list, magnitude, multi_hot, one_hot, one_hot_position,
    split_list, time_blocks, zip_pairs,
)
from affinity.functions.encoding import parse_result, parse_user_rules, to_result_json

__all__ = [
    "cosine", "dot", "join_list", "magnitude", "multi_hot", "one_hot",
    "one_hot_position", "parse_result", "parse_user_rules", "split_list",
    "time_blocks", "to_result_json", "zip_pairs",
]
