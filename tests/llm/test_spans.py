import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noteglass.llm import records, spans


def longest(a, b):
    """Length of the longest common substring."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def corpus(seed, least):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghij \né漢🙂") for _ in range(n))
    shared = [noise(n) for n in (least - 1, least, least + 1, 2 * least, 3 * least)]
    out = []
    for k in range(40):
        text = noise(rng.randint(0, 2 * least))
        for _ in range(rng.randint(0, 2)):
            text += rng.choice(shared) + noise(rng.randint(0, least))
        out.append((f"r{k}", text))
    return [*out, ("copy1", "same " * least), ("copy2", "same " * least), ("copy1", "same " * least), ("short", "x" * (least - 1)), ("short2", "x" * (least - 1)), ("null", None), ("empty", ""), ("run", "y" * 4 * least), ("run2", "y" * 4 * least + "z")]


@pytest.mark.parametrize("seed, crowd, chunk", [(1, 48, 10**6), (2, 48, 900), (3, 2, 10**6), (4, 5, 900)])
def test_pairs_match_brute_force(spark, seed, crowd, chunk):
    least = 40
    rows = corpus(seed, least)
    texts = {r: t for r, t in rows if t}
    names = sorted(texts)
    want = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if longest(texts[a], texts[b]) >= least}
    frame = spark.createDataFrame([(r, t, "x") for r, t in rows], "rec string, text string, block string").repartition(3)
    between = spans.shared(frame, False, least, 16, crowd, chunk)
    own = {r.rec: bytes(r.block) for r in spans.members(frame, least).collect()}
    blocks = {tuple(sorted((bytes(a), bytes(b)))) for a, b in between.collect()}
    got = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if a in own and b in own and (own[a] == own[b] or tuple(sorted((own[a], own[b]))) in blocks)}
    assert got == want


def test_production_sizes_and_coverage(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    long, near = noise(500), noise(199)
    rows = [("a", noise(300) + long + noise(50)), ("b", long), ("c", noise(100) + near + noise(100)), ("d", near + noise(10)), ("e", long.upper()), ("f", noise(400)), ("g", None)]
    frame = spark.createDataFrame(rows, "rec string, text string")
    assert {tuple(r) for r in spans.pairs(frame).collect()} == {("a", "b")}
    part = {r.rec: (r.n_chars, r.shared_chars) for r in spans.coverage(frame).collect()}
    assert part["a"] == (850, 500) and part["b"] == (500, 500) and part["c"][1] == 0 and "g" not in part
    assert spans.pairs(frame.limit(0)).collect() == []


def covered(a, b, least):
    """Places of a that lie in a common substring of at least that length."""
    out = set()
    for k in range(len(a) - least + 1):
        if a[k : k + least] in b:
            out |= set(range(k, k + least))
    return out


@pytest.mark.parametrize("seed, crowd, chunk", [(5, 48, 10**6), (6, 48, 900), (7, 2, 10**6)])
def test_covered_places_match_brute_force(spark, seed, crowd, chunk):
    least = 40
    texts = {r: t for r, t in corpus(seed, least) if t}
    frame = spark.createDataFrame(list(texts.items()), "rec string, text string").repartition(3)
    own = {bytes(r.block): texts[r.rec] for r in spans.members(frame, least).collect()}
    got = {}
    for r in spans.shared(frame, True, least, 16, crowd, chunk).collect():
        got.setdefault(own[bytes(r.block)], set()).update(range(r.start, r.start + r.size))
    distinct = set(own.values())
    for t in distinct:
        want = set().union(*(covered(t, x, least) for x in distinct if x != t))
        assert got.get(t, set()) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=60), st.text(alphabet="ab", max_size=60), st.sampled_from([6, 9, 12]))
def test_factors_find_every_span(a, b, least):
    """Factors of a against b, all places indexed: they cover what the texts share, and nothing else."""
    gram = 4
    places = [(k, [j for j in range(len(b) - gram + 1) if b[j : j + gram] == a[k : k + gram]]) for k in range(len(a) - gram + 1)]
    got = list(spans.factors(spans.Block([0], [a]), spans.Block([0], [b]), [p for p in places if p[1]], least, gram))
    assert all(a[i : i + n] == b[j : j + n] and n >= least for i, j, n in got)
    assert {x for i, _, n in got for x in range(i, i + n)} == covered(a, b, least)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", min_size=0, max_size=200), st.text(alphabet="ab", min_size=0, max_size=200), st.integers(0, 200), st.integers(0, 200))
def test_agree(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    want = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
    assert spans.agree(a, i, b, j) == want
    want = next((k for k in range(min(i, j)) if a[i - 1 - k] != b[j - 1 - k]), min(i, j))
    assert spans.agree_before(a, i, b, j) == want


def test_long_texts_are_indexed_in_pieces():
    text = "".join(random.Random(9).choice("abcdef") for _ in range(3000))
    pieces = list(spans.cut(text, 40, 500))
    assert all(text[at : at + len(p)] == p for at, p in pieces) and len(pieces) > 5
    assert {at + k for at, p in pieces for k in range(len(p) - 39)} == set(range(len(text) - 39))
    assert list(spans.cut("ab", 40)) == [(0, "ab")]


def test_crowded_anchors_on_the_tables(spark, data):
    """Sending anchors of more than two texts through whole windows changes nothing."""
    texts = records.passages(spark, data, "note")
    few, many = ({(bytes(r.a), bytes(r.b)) for r in spans.shared(texts, False, crowd=c).collect()} for c in (spans.CROWD, 2))
    assert few == many and few


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=30, max_size=120), st.integers(2, 20))
def test_window_minima(values, width):
    import numpy as np

    keys = np.array(values, dtype=np.uint64)
    assert spans.window_minima(keys, width).tolist() == [min(values[k : k + width]) for k in range(len(values) - width + 1)]
