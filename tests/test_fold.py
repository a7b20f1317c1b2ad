import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hitpath.functions.fold import Folder, fold, nests, pattern_text

# Sequences and their patterns.
GOLDENS = [
    ("", ""),
    ("A", "A"),
    ("A B C", "A -> B -> C"),
    ("A B B B", "A -> (B)*"),
    ("A A A B B C A A", "(A)* -> (B)* -> C -> (A)*"),
    ("A B C A B C D", "(A -> B -> C)* -> D"),
    ("A B B C A B C D", "(A -> (B)* -> C)* -> D"),
    ("A B C B C D B C D E", "A -> ((B -> C)* -> D)* -> E"),
    ("A B A B B C", "(A -> (B)*)* -> C"),
    ("A B C A B C B C D", "(A -> (B -> C)*)* -> D"),
    ("A B C B C A B C B C D", "(A -> (B -> C)*)* -> D"),
    ("A B C D E B C D E C D E D E", "A -> (B -> (C -> (D -> E)*)*)*"),
    ("A B B C A A B C C D", "((A)* -> (B)* -> (C)*)* -> D"),
    ("A B C B C D B C C D E", "A -> ((B -> (C)*)* -> D)* -> E"),
    ("A B C C A B B C B C D", "(A -> ((B)* -> (C)*)*)* -> D"),
    ("A B C C D A B B C B C D E", "(A -> ((B)* -> (C)*)* -> D)* -> E"),
    ("A B C B C A B A B C D", "A -> (B -> C)* -> (A -> B)* -> C -> D"),
    ("A B A B C A B C", "((A -> B)* -> C)*"),
    ("A B C A A B C A", "((A)* -> B -> C)* -> A"),
]


@pytest.mark.parametrize("sequence, pattern", GOLDENS)
def test_goldens(sequence, pattern):
    assert pattern_text(*fold(sequence.split())) == pattern


def plain_fold(sequence):
    """The fold by its definition, trying every size and looking at every loop."""
    word, loops = [], set()
    for leaf in sequence:
        word.append(leaf)
        n = len(word)
        for size in range(1, n // 2 + 1):
            p = n - 1 - size
            s = p - size + 1
            if word[s : p + 1] != word[p + 1 :] or any(lo <= p < hi for lo, hi in loops):
                continue
            head = {loop for loop in loops if loop[1] <= p}
            tail = {(lo - size, hi - size) for lo, hi in loops if lo > p}
            merged = head | tail | {(s, p)}
            if all(a[1] < b[0] or b[1] < a[0] or a[0] <= b[0] <= b[1] <= a[1] or b[0] <= a[0] <= a[1] <= b[1] for a in merged for b in merged):
                word, loops = word[: p + 1], merged
                break
    return word, sorted(loops)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ABC"), max_size=60))
def test_matches_definition(sequence):
    assert fold(sequence) == plain_fold(sequence)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("ABCDEFGH"), min_size=1, max_size=9), st.lists(st.sampled_from("AB"), max_size=6))
def test_matches_definition_with_long_copies(block, between):
    sequence = (block + between) * 3 + block * 3 + between
    assert fold(sequence) == plain_fold(sequence)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ABC"), max_size=40), st.integers(2, 6))
def test_run_length_beyond_two_does_not_matter(sequence, times):
    twice, often = [], []
    for i, leaf in enumerate(sequence):
        n = 2 if i % 3 == 0 else 1
        twice += [leaf] * n
        often += [leaf] * (times if n == 2 else 1)
    assert fold(twice) == fold(often)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ABCD"), min_size=1, max_size=80))
def test_pattern_is_a_tree_over_its_leaves(sequence):
    leaves, loops = fold(sequence)
    assert nests(loops)
    assert all(0 <= lo <= hi < len(leaves) for lo, hi in loops)
    assert set(leaves) == set(sequence) and leaves[0] == sequence[0] and leaves[-1] == sequence[-1]
    text = pattern_text(leaves, loops)
    assert text.replace("(", "").replace(")*", "").split(" -> ") == leaves


def test_crossing_loops_are_kept_apart():
    # Both copies of the second half hold loops that would straddle each other.
    leaves, loops = fold("X A B C B C X A B A B C".split())
    assert nests(loops)
    assert leaves == "X A B C X A B C".split()


def test_state_shrinks_with_the_pattern():
    folder = Folder()
    for _ in range(5000):
        for leaf in "ABCDEFGHIJKL":
            folder.add(leaf)
    assert len(folder.leaves) == 12 and folder.loops == [(0, 11)]
    assert sum(map(len, folder._grams.values())) <= 12


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ABC"), max_size=80), st.lists(st.integers(0, 80), max_size=5))
def test_a_fold_goes_on_from_its_pattern(sequence, cuts):
    whole, parts = Folder(), Folder()
    for i, leaf in enumerate(sequence):
        if i in cuts:
            parts = Folder.resume(parts.leaves, parts.loops)
        for folder in (whole, parts):
            folder.add(leaf)
    assert (whole.leaves, whole.loops, whole._part_end) == (parts.leaves, parts.loops, parts._part_end)
    assert {k: v for k, v in whole._grams.items() if v} == {k: v for k, v in parts._grams.items() if v}


def test_repeated_blocks_do_not_settle():
    """Why only runs of one leaf are thinned: longer blocks may need many repetitions, or never settle."""

    def patterns(start, block, times):
        return [fold([*start, *block * n]) for n in range(1, times)]

    found = patterns("aa", "adbadbdbad", 9)
    assert found[4] != found[5]
    found = patterns("", "ccabababa", 13)
    assert all(a != b for a, b in zip(found, found[1:]))
