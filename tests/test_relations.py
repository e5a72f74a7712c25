"""Relations, against an evaluation of their own: random trees written out in random ways, and token rows that a reduction refuses."""

import itertools
import random
import re

import pytest

from pathlume.plans.errors import ProblemKind, QueryProblem
from pathlume.plans.relation import conditions_in, fold, parse_relation, simple_relation

NAMES = {"late": 0, "cheap_x": 1, "b2": 2}
N = 4


def tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return rng.randrange(N)
    return (rng.choice(["and", "or"]), [tree(rng, depth - 1) for _ in range(rng.randint(2, 3))])


def value(t, given):
    if isinstance(t, int):
        return given[t]
    return (all if t[0] == "and" else any)(value(x, given) for x in t[1])


def written(t, rng, within=None):
    """Text of a tree, with the parentheses it needs and some it does not, any spelling of operators and blanks."""
    if isinstance(t, int):
        called = [n for n, i in NAMES.items() if i == t]
        text = "$" + (rng.choice(called) if called and rng.random() < 0.5 else str(t))
        return text.upper() if rng.random() < 0.2 else text
    signs = {"and": [" and ", " AND ", "&&", " && "], "or": [" or ", " Or ", "||", "  ||"]}[t[0]]
    text = rng.choice(signs).join(written(x, rng, t[0]) for x in t[1])
    return f"({text} )" if (within == "and" and t[0] == "or") or rng.random() < 0.3 else text


def evaluated(text, given):
    return fold(parse_relation(text, NAMES, N), lambda i: given[i], lambda a, b: a and b, lambda a, b: a or b)


@pytest.mark.parametrize("seed", range(40))
def test_a_written_tree_has_the_value_of_the_tree(seed):
    rng = random.Random(seed)
    t = tree(rng)
    text = written(t, rng)
    for given in itertools.product([False, True], repeat=N):
        assert evaluated(text, given) == value(t, given), text


def reducible(tokens):
    """Whether a row of tokens is a relation, by writing each part over until nothing changes."""
    row = " ".join("x" if t.startswith("$") else "o" if t not in "()" else t for t in tokens)
    while (less := re.sub(r"\( x \)|x o x", "x", row)) != row:
        row = less
    return row == "x"


def test_token_rows_are_read_exactly_where_they_reduce():
    rng = random.Random(5)
    seen = {True: 0, False: 0}
    for _ in range(600):
        tokens = [rng.choice(["$0", "$late", "and", "||", "(", ")"]) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.6:  # near misses: a good row with one token gone, added or doubled
            tokens = rng.choice([["$0", "and", "$1"], ["(", "$0", "or", "$b2", ")", "and", "$1"], ["$3"]]).copy()
            i = rng.randrange(len(tokens))
            tokens[i : i + rng.randint(0, 1)] = rng.choice([[], [tokens[i]] * 2, [rng.choice(["and", "(", ")", "$2"])]])
        fine = reducible(tokens)
        seen[fine] += 1
        if fine:
            parse_relation(" ".join(tokens), NAMES, N)
        else:
            with pytest.raises(QueryProblem) as problem:
                parse_relation(" ".join(tokens), NAMES, N)
            assert problem.value.kind is ProblemKind.RELATION
    assert min(seen.values()) > 50


def test_references_outside_the_conditions_and_signs_outside_the_grammar():
    for odd in [f"${N}", f"${10**30}", "$nobody", "$0late", "$", "$ 0", "late", "$late$late", "$0 xor $1", "!$0", "$0;", "$0 and $1 -- x", "“$0”"]:
        with pytest.raises(QueryProblem):
            parse_relation(odd, NAMES, N)


def test_parts_of_relations():
    for n, sign in itertools.product((1, 2, 5), ("and", "or", "&&", "||")):
        text = simple_relation(sign, n)
        assert conditions_in(parse_relation(text, {}, n)) == list(range(n))
    assert conditions_in(parse_relation("$3 or ($1 and $3) or $0", NAMES, N)) == [3, 1, 0]
