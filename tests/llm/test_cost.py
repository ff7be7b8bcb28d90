"""What the corpus operators take for their work: memory of a worker, passes over arrays."""

import sys
import tracemalloc

import numpy as np

from bidlake.llm import common, langid, line_dedup, ngram_join


def _peak(f) -> float:
    """MB that f takes at most, once what is kept between calls is there."""
    f()
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_reading_takes_little_memory():
    net = langid.Network.fresh(["a", "b", "c", "d"])
    text = "a text of some words " * 25_000
    assert _peak(lambda: net.judged([text])) < 50


def test_a_learning_step_is_few_calls():
    net = langid.Network.fresh(["a", "b", "c"])
    r = np.random.default_rng(1)
    x, y = r.integers(97, 123, (64, 32)).astype(np.uint8), r.integers(0, 3, 32)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        net.gradients(x, y, np.ones(x.shape, bool))
    finally:
        sys.setprofile(None)
    assert calls < 600


def test_word_hashes_are_the_polynomials_of_their_bytes():
    data = ("ab é \n" * 30_000 + "x" * 200_000 + " y " + "zz\t" * 40_000).encode()
    start, end = common.word_bounds(data)
    words = data.split()
    assert [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)] == words
    value = {w: sum((c + 1) * int(p) for c, p in zip(w, common.powers(len(w)).tolist(), strict=True)) % (1 << 64) for w in set(words)}
    want = common.mix64(np.array([value[w] for w in words], np.uint64))
    assert (common.word_hashes(data, start, end) == want).all()


def test_hashing_words_takes_little_memory():
    data = b"some words " * 100_000
    start, end = common.word_bounds(data)
    assert _peak(lambda: common.word_hashes(data, start, end)) < 8


def test_lines_begin_at_the_first_word_after_each_break():
    units = line_dedup.Units(["\n\na b\n \nc\n", None, "", "\n", "d\ne f"])
    assert units.first.tolist() == [0, 2, 3, 4, 6]
    assert [len(units.of(line_dedup.LINES_KIND, i)) for i in range(5)] == [2, 0, 0, 0, 2]
    assert line_dedup.Units(["", None]).first.tolist() == [0]


def test_a_learning_step_asks_for_little_memory():
    net, work, r = langid.Network.fresh(["a", "b", "c", "d"]), langid.Work(), np.random.default_rng(1)
    x, y = r.integers(97, 123, (64, 144)).astype(np.uint8), r.integers(0, 4, 144)
    assert _peak(lambda: net.gradients(x, y, np.ones(x.shape, bool), work=work)) < 4
    fresh, again = net.gradients(x, y, x > 99), net.gradients(x, y, x > 99, work=work)
    assert fresh[0] == again[0] and all((fresh[1][k] == again[1][k]).all() for k in fresh[1])


def test_probabilities_are_worked_out_a_few_bytes_at_a_time():
    net = langid.Network.fresh([str(i) for i in range(40)])
    text = "a text of some words " * 25_000
    assert _peak(lambda: net.judged([text])) < 25


def _prints(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(int(h), int(d), int(d % 3), int(p) << 16 | int(t) << 1) for h, d, p, t in zip(r.integers(0, 900, 1500), r.integers(0, 50, 1500), r.integers(0, 9, 1500), r.random(1500) < 0.02, strict=True)]
    rows += [(7, d, 0, 1 << 16) for d in range(60, 400)]
    return rows, spark.createDataFrame(rows, "hash long, doc_id long, th long, place long")


def test_places_of_a_hash_and_the_earliest_one(spark):
    rows, prints = _prints(spark, 1)
    by = {}
    for h, *row in rows:
        by.setdefault(h, []).append(row)
    want = []
    for of in by.values():
        first, thin = min(of), any(p >> 1 & 1 for *_, p in of)
        want += [(d, th, p >> 16, first[0], first[1], first[2] >> 16, thin) for d, th, p in of if thin or (d, th, p >> 16) != (*first[:2], first[2] >> 16)]
    prints = common.written(prints.repartition(5), "test-prints")
    got = line_dedup._marked(prints, ["hash"]).select("doc_id", "th", "pos", "odoc", "oth", "opos", "thin").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_keys_are_shuffled_once(spark):
    _, prints = _prints(spark, 2)
    prints = common.written(prints.where("hash <> 7").limit(200), "test-prints")
    plan = line_dedup._marked(prints, ["hash"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_the_rows_of_a_key_go_on_over_batches():
    columns = [np.array(x, np.int64) for x in ([1, 1, 2, 2, 2], [5, 3, 9, 8, 8], [0] * 5, [1 << 16] * 5)]
    assert line_dedup._last(columns[:1]) == 2 and line_dedup._last(columns[:2]) == 3
    doc_id, *_, odoc, _, _, thin = line_dedup._shared_keys(columns, 1)
    assert doc_id.tolist() == [5, 9] and odoc.tolist() == [3, 8] and not thin.any()


def test_equal_runs_of_many_pieces_at_once():
    a, b = np.array([1, 2, 3, 4, 4, 4, 9]), np.array([1, 2, 0, 4, 4, 4, 9])
    found = line_dedup.equal_runs(a, b, np.array([0, 2, 2, 5, 7]), np.array([2, 1, 2, 3]))
    assert [x.tolist() for x in found] == [[0, 2], [0, 1], [2, 3]]


def test_cutting_needs_no_hashes():
    units = line_dedup.Units(["a b\nc", "d"])
    assert [len(x) for x in units.words(0)] == [3, 3] and units.word_spans(line_dedup.LINES_KIND, 0, [(1, 2)]) == [(2, 3)]
    assert "units" not in vars(units)


def test_comparing_sets_takes_little_memory():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 40_000, 100)) for _ in range(256)]
    got = ngram_join._overlap(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in r.integers(0, 256, (200, 2)))
    assert _peak(lambda: ngram_join._overlap(sets)) < 10
    tokens, paths = r.integers(0, 1 << 62, 3000).astype(np.uint64), r.integers(0, 1 << 62, 900).astype(np.uint64)
    assert _peak(lambda: ngram_join.children(tokens, paths, 0.8)) < 15
