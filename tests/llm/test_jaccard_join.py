import re
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import jaccard_join as J
from lodestone.llm.components import components
from lodestone.llm.shingles import shingle_sets
from tests.llm.fixtures import docs, rows, words


def shingles(t):
    w = [x for x in re.split("[\t-\r ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def brute(data):
    s = [(i, shingles(t)) for i, t in data]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(s)):
        groups[find(k)].append(k)
    out = []
    for g in groups.values():
        ids = [s[k][0] for k in g if s[k][0] is not None]
        out += [(s[k][0], min(ids, default=None), len(g), links[k], s[k][0] == min(ids, default=None)) for k in g]
    return sorted(out, key=str)


def run(spark, data):
    return sorted((tuple(r) for r in J.jaccard_join(docs(spark, data).repartition(3)).collect()), key=str)


def variants(seed, n, count):
    base = words(seed, n).split()
    out = []
    for k in range(count):
        w = list(base)
        w[(k * 7) % n] = f"x{k}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    data = rows() + [(300 + k, t) for k, t in enumerate(variants(31, 100, 25))] + [(400 + k, t.upper()) for k, t in enumerate(variants(31, 100, 3))] + [(500 + k, " ".join(words(33, 60).split()[k:])) for k in range(0, 40, 4)]
    assert run(spark, data) == brute(data)


def test_blocks_of_a_large_node(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    data = [(k, t) for k, t in enumerate(variants(41, 150, 60))]
    got = run(spark, data)
    assert got == brute(data) and got[0][2] == 60


def test_empty_table(spark):
    assert run(spark, []) == []


def test_prefix_is_shortened_to_the_recall():
    depth = J.prefix_depth()
    assert 1 - (1 - J.SIMILARITY**depth) ** J.TREES >= J.RECALL > 1 - (1 - J.SIMILARITY ** (depth + 1)) ** J.TREES
    assert J.prefix_depth(recall=0.5) > depth >= J.prefix_depth(recall=0.9999999)


def test_prefixes_are_shortened_as_far_as_the_links_need():
    least = J.prefix_depth()
    unseen = J.shortened(set(), J.SIMILARITY, least)
    assert J.meeting(J.SIMILARITY, unseen) >= J.UNSEEN_RECALL > J.meeting(J.SIMILARITY, unseen + 1)
    assert J.shortened({80}, J.SIMILARITY, least) == least == J.shortened({80, 90, 99}, J.SIMILARITY, least)  # however many the others are
    for found in ({98}, {90, 99}, {85}, {82}):
        depth = J.shortened(found, J.SIMILARITY, least)
        assert all(J.meeting(s / 100, depth) >= J.RECALL for s in found) and J.meeting(J.SIMILARITY, depth) >= J.UNSEEN_RECALL


def test_copies_do_not_hide_links_at_the_threshold(spark):
    """Many near-identical texts beside pairs at 0.80 to 0.82: every link is found."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(400)]
    data = [(i, " ".join(base[:k] + ["x"] + base[k:])) for i, k in enumerate(range(1, 400, 2))]
    for i in range(40):
        text = [word() for _ in range(94)]  # 90 shingles; four changed words apart change 20 of them at most
        data += [(1000 + 2 * i, " ".join(text)), (1001 + 2 * i, " ".join([*text[:45], word(), *text[46:55], word(), *text[56:]]))]
    got = {x.doc_id: x.n_links for x in J.jaccard_join(docs(spark, data)).collect()}

    def sets(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    made = [(i, sets(t)) for i, t in data]
    near = {i: sum(5 * len(s & o) >= 4 * len(s | o) for j, o in made if j != i) for i, s in made}
    assert sum(near[1000 + k] for k in range(80)) == 80 and got == near


def test_nodes_of_a_prefix_are_within_those_of_shorter_ones():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, 80).astype(np.uint64)
    k = J.prefix_keys([np.unique(np.concatenate([base, r.integers(0, 1 << 62, 8).astype(np.uint64)])) for _ in range(30)], 2)
    for d in range(1, k.shape[1]):
        same = k[:, None, d] == k[None, :, d]
        assert (k[:, None, d - 1] == k[None, :, d - 1])[same].all()
    assert (k[:, None, 0] == k[None, :, 0]).sum() > (k[:, None, -1] == k[None, :, -1]).sum()


def test_sets_that_only_rows_without_an_id_have(spark):
    data = [(None, t) for t in variants(51, 100, 4)] + [(None, variants(51, 100, 1)[0]), (7, words(52, 50)), (None, words(53, 50))]
    assert run(spark, data) == brute(data)


def test_recall_of_the_query_against_all_pairs(spark):
    """Many chains of ever less alike texts: links found of those that there are."""
    data = []
    for c in range(30):
        base = words(600 + c, 60).split()
        for k in range(8):
            w = list(base)
            w[(5 * k) % 60] = f"y{c}x{k}"
            data.append((100 * c + k, " ".join(w)))
    got, want = run(spark, data), brute(data)
    assert sum(min(g[3], w[3]) for g, w in zip(got, want, strict=True)) >= 0.999 * sum(w[3] for w in want) > 0


def test_recall_of_the_forest():
    """Pairs of similarity 0.8 to 0.85 that meet in some trie, over 400 pairs."""
    met = total = 0
    r = np.random.default_rng(1)
    for _ in range(400):
        both = r.integers(0, 1 << 62, 200).astype(np.uint64)
        a, b = np.concatenate([both, r.integers(0, 1 << 62, 22).astype(np.uint64)]), np.concatenate([both, r.integers(0, 1 << 62, 22).astype(np.uint64)])
        k = J.prefix_keys([np.unique(a), np.unique(b)], J.prefix_depth())
        met += bool((k[0][0] == k[1][0]).any())
        total += 1
    assert met >= 0.995 * total


def test_shared_counts_are_exact():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (J.shared(sets) == want).all() and (J.shared(sets[:5], sets[5:]) == np.array(want)[:5, 5:]).all()


@pytest.mark.parametrize("text", ["a b c d e f", "A  B\tc d e f ", "x a b c d e f"])
def test_shingles_do_not_depend_on_place(text):
    data = np.frombuffer(("zz " * 7 + "|" + text).encode(), np.uint8)
    ends = np.array([0, 22, len(data)])
    alone = shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
    assert (shingle_sets(data, ends)[1] == alone).all() and len(alone) == len(shingles(text))


def test_components_of_chains_and_stars(spark):
    links = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(20)] + [("x", "x"), ("p", "q"), ("q", "p")]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert all(got[f"a{i:03d}"] == "a000" for i in range(61)) and all(got[f"s{i}"] == "hub" for i in range(20)) and got["q"] == "p" and "x" not in got
    assert components(spark.createDataFrame([], "u string, v string")).collect() == []
