import random

import numpy as np

from artifactgate.llm import decontaminate, embeddings, minhash
from artifactgate.llm.groups import connected_components


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_minhash_matches_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    texts = []
    for _ in range(160):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += [None, "", " \t\n", "one", "ONE", "x" * 50_000, "two words", texts[0].upper()]
    rows = [(k, t) for k, t in enumerate(texts)]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(len(rows), links)
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, cls string, node int")
    got = {r.doc_id: r for r in minhash.near_duplicates(frame).collect()}
    assert [got[k].component_id for k in range(len(rows))] == want
    assert all(got[k].kept == (want[k] == k) and got[k].n_shingles == len(sets[k]) for k in range(len(rows)))
    assert {r.doc_id for r in minhash.deduplicate(frame).collect()} == {k for k in range(len(rows)) if want[k] == k}
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (1, "quite another text of some more words here"), (None, text), (None, "nothing like it at all in this one")]
    out = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.component_id is not None)
    assert out == [(-1, 1, False), (1, 1, True), (1, 1, True), (1, 1, True)]


def test_sequential_test_keeps_what_is_similar():
    steps = minhash.least_matches(0.75)
    rng = np.random.default_rng(1)
    agree = rng.random((20_000, minhash.PERMUTATIONS)) < 0.75
    live = np.ones(len(agree), dtype=bool)
    for n, least in steps:
        live &= agree[:, :n].sum(axis=1) >= least
    assert live.mean() > 0.999


def test_connected_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(60)}}


def test_embeddings_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    x = [centres[k % 20] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35]) for k in range(300)]
    rows = [(k, v.astype(float).tolist(), k % 3) for k, v in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 1), (303, rows[5][1], 1), (304, [2 * y for y in rows[5][1]], 1), (305, [1.0, 2.0], 1), (306, [None] * 16, 1), (307, [], 1)]
    good = {k: np.array(v) for k, v, _ in rows if k < 300 or k in (303, 304)}
    links = [(i, j) for i in good for j in good if j < i and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.9]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, copies int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    want = components(308, links)
    n = [sum(k in pair for pair in links) for k in range(308)]
    # Retrieval may miss a link now and then; it never adds one.
    assert all(got[k].n_links <= n[k] for k in range(308)) and sum(got[k].n_links for k in range(308)) >= 0.95 * sum(n)
    assert sum(got[k].component_id == want[k] for k in range(308)) >= 300
    assert all(got[k].n_links == 0 and got[k].kept for k in (300, 301, 302, 305, 306, 307)) and got[303].n_links >= 2
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_decontamination_edge_cases(spark):
    item = " ".join(f"k{i}" for i in range(15))
    docs = [(0, f"start {item.upper()} end"), (1, "short ITEM, here!"), (2, None), (3, ""), (4, "clean words only " * 30), (5, " ".join(["pad"] * 400) + " " + item), (0, f"start {item} end")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, n_hit int, items string")
    bench = spark.createDataFrame([(7, item), (8, "item here"), (9, None), (None, "item"), (10, "..."), (7, item)], "item_id bigint, text string")
    want = {(0, 17, 15, 1, True), (1, 3, 2, 1, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 90, 0, 0, False), (5, 415, 15, 1, False)}
    got = decontaminate.report(frame, bench).collect()
    assert len(got) == 7 and {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == want
    assert {(r.doc_id, r._n_words) for r in decontaminate.find_hits(frame, bench, max_windows=2).where("size(_hits) > 0").collect()} == {(0, 17), (1, 3), (5, 415)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()) == [2, 3, 4, 5]
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(frame, bench, mode="spans").collect()}
    assert spans[1] == "short !" and spans[2] is None and "k3" not in spans[5] and "K3" not in spans[0]
    assert decontaminate.report(frame.limit(0), bench.limit(0)).count() == 0


def test_component_steps_run_in_tasks_by_their_links(spark):
    """Whatever the number of shuffle partitions, a few links are not dealt over all of them."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = connected_components(spark.createDataFrame([(k, k + 1) for k in range(6)], "a bigint, b bigint"))
        assert out.rdd.getNumPartitions() < 40 and {(r.node, r.component) for r in out.collect()} == {(k, 0) for k in range(7)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
