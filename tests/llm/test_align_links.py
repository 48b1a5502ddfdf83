"""Groups and links of crafted ends."""

import numpy as np
from barloom.llm import align


def test_groups_and_links_without_a_walk():
    a, ends_a = np.array([5, 6, 7, 8, 9]), np.array([1, 3, 5, 6, 9])
    b, ends_b = np.array([0, 1, 2, 3]), np.array([1, 4, 6, 9])
    groups, text, links = align.aligned(a, ends_a, b, ends_b, align.marked_names(10, 4), 10)
    assert (groups, text) == (3, "5|0;6,7,8|1,2;9|3")
    assert sorted((x // align.SHIFT, x % align.SHIFT) for x in links.tolist()) == [(5, 0), (6, 1), (7, 1), (7, 2), (8, 2), (9, 3)]
