from tidemark.functions.numeric import (
    at_least, at_most, clamp, exact_avg, exact_sum, greatest_strict, least_strict,
    money_sum, percent, ratio, squash,
)
from tidemark.functions.noise import bernoulli, hash_uniform
from tidemark.functions.rules import code_map, first_match, flag
from tidemark.functions.temporal import (
    at, days_back, days_between, floor_day, floor_hour, resolve_as_of, same_day,
    wall_clock, wall_instant,
)

__all__ = [
    "at", "at_least", "at_most", "bernoulli", "clamp", "code_map", "days_back",
    "days_between", "exact_avg", "exact_sum", "first_match", "flag", "floor_day", "floor_hour", "greatest_strict",
    "hash_uniform", "least_strict", "money_sum", "percent", "ratio", "resolve_as_of",
    "same_day", "squash", "wall_clock", "wall_instant",
]
