import base64
import random

import numpy as np
import pytest

from tesserae.llm import bpe, packing, ranking, repetition, splitting

public_tokenizers = pytest.importorskip("public_tokenizers")


def _public():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_those_of_the_public_tokenizer():
    random.seed(3)
    parts = ["'", "'s", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "1", "é", "中", "a", "B", "-", "<|endoftext|>", "x'", "　", "😀"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    texts += [None, "", " " * 3000 + "a", "=" * 5000, "ab" * 3000, "\n" * 700]
    machine, public = bpe.transducer(bpe.default_vocabulary()), _public()
    flat, ends = machine.encode_batch(texts)
    for i, text in enumerate(texts):
        assert list(flat[ends[i] : ends[i + 1]]) == public.encode_ordinary(text or "")


def test_round_trip_and_extra_columns(spark):
    rows = [(1, "héllo 中文 😀", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "a" * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    coded = bpe.encode(df)
    assert {r.doc_id: r.ids for r in coded.collect()}[2] == []
    assert {r.doc_id: r.text for r in bpe.decode(coded).collect()} == {1: "héllo 中文 😀", 2: "", 3: "", 4: "a" * 50_000}
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_utf8_machine_agrees_with_the_codec():
    random.seed(4)
    for _ in range(500):
        data = "".join(random.choice("aé中😀") for _ in range(8)).encode()
        machine, out = bpe.Utf8Machine(), []
        for b in data:
            out.append(machine.feed(bytes((b,))))
        assert "".join(out) + machine.close() == data.decode()
    machine = bpe.Utf8Machine()
    assert machine.feed(b"\xe4\xb8a") + machine.close() == "�a"


def test_best_fit_respects_every_constraint():
    random.seed(5)
    sizes = np.array([random.randint(0, 100) for _ in range(500)])
    found = packing.best_fit(sizes, 100, 3, 6000.0)
    for k in np.unique(found):
        own = sizes[found == k]
        assert own.sum() <= 100 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= max(6000, own.max() ** 2)
    free = packing.best_fit(sizes, 100, 500, 1e9)
    assert len(np.unique(free)) <= 1.03 * -(-sizes.sum() // 100)


def test_each_capacity_binds():
    sizes = np.array([50, 50, 40, 40, 10, 10, 0, 0])
    used = lambda found, sizes=sizes: sorted(tuple(sorted(sizes[found == k].tolist())) for k in np.unique(found))
    assert sorted(map(sum, used(packing.best_fit(sizes, 100, 8, 1e4)))) == [100, 100]
    assert max(map(len, used(packing.best_fit(sizes, 100, 2, 1e4)))) == 2 and len(used(packing.best_fit(sizes, 100, 2, 1e4))) == 4
    assert all(sum(x * x for x in own) <= 4300 for own in used(packing.best_fit(sizes, 100, 8, 4300.0))) and (50, 50) not in used(packing.best_fit(sizes, 100, 8, 4300.0))
    # dearer than the bound: alone but for empty items
    dear = np.array([80, 18, 10, 0])
    assert used(packing.best_fit(dear, 100, 8, 1000.0), dear) in ([(0, 80), (10, 18)], [(0, 10, 18), (80,)])


def test_production_capacities_bind(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([(i, rng.choice([700, 900, 1300])) for i in range(40)] + [(1000 + i, 3 * (i % 2)) for i in range(4000)], "doc_id bigint, n_tokens bigint")
    own = {}
    for r in packing.pack(df, "doc_id", 2048).collect():
        own.setdefault(r.container_id, []).append(r.n_tokens)
    cap = packing.COST_SHARE * 2048**2
    assert all(sum(v) <= 2048 and len(v) <= packing.MAX_DOCUMENTS and sum(x * x for x in v) <= cap for v in own.values())
    loose = packing.pack(df, "doc_id", 2048, max_documents=10_000, cost_share=1.0).select("container_id").distinct().count()
    assert len(own) > loose and max(map(len, own.values())) == packing.MAX_DOCUMENTS


def test_pack_cuts_only_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 250), (2, 100), (3, 0), (4, 60), (4, 60), (5, 40)], "doc_id bigint, n_tokens bigint")
    rows = packing.pack(df, "doc_id", 100).collect()
    assert sorted((r.doc_id, r.piece_no, r.token_start, r.n_tokens) for r in rows) == [(1, 0, 0, 100), (1, 1, 100, 100), (1, 2, 200, 50), (2, 0, 0, 100), (3, 0, 0, 0), (4, 0, 0, 60), (5, 0, 0, 40)]
    used = {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 100 and len(used) == 5
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), "doc_id", 100).count() == 0


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, "Line one.\r\n" * 500, "。".join(["文字" * 20] * 90), "para\n\n" * 800])
def test_pieces_cover_the_text_and_overlap(text):
    pieces = splitting.cut_points(text, 400, 40)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, _) in zip(pieces, pieces[1:]):
        assert b - a <= 400 and a < c <= b and abs(b - c - 40) <= 1
    assert pieces[-1][1] - pieces[-1][0] <= 400


def test_pieces_end_at_words_and_other_units_work():
    text = "alpha beta gamma delta " * 100
    assert all(text[b - 1] == " " for _, b in splitting.cut_points(text, 200, 20)[:-1])
    sums = np.arange(len(text) + 1) * 2
    assert all(sums[b] - sums[a] <= 200 for a, b in splitting.cut_points(text, 200, 20, sums))


def test_overlap_is_whole_or_an_error():
    rng = random.Random(9)
    for limit, overlap in ((20, 15), (20, 19), (7, 3), (1, 0), (50, 49)):
        for _ in range(20):
            text = "".join(rng.choice(["ab", " ", "\r\n", ". ", "x", "\n\n"]) for _ in range(120))
            pieces = splitting.cut_points(text, limit, overlap)
            assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
            for (a, b), (c, _) in zip(pieces, pieces[1:]):
                assert b - a <= limit and a < c and b - c in (overlap, overlap + 1)
                assert b - c == overlap or text[c - 1 : c + 1] != "\r\n"
    for overlap in (20, 25, -1):
        with pytest.raises(ValueError):
            splitting.cut_points("x" * 100, 20, overlap)


def test_kinds_without_a_limit_stay_whole(spark):
    limits = spark.createDataFrame([("excerpt", 5, None), ("note", None, 3)], "item_kind string, max_size int, overlap_size int")
    items = spark.createDataFrame([("excerpt", 1, "abcdefg"), ("other", 2, "abcdefghij"), ("note", 3, "abcdefghij")], "item_kind string, item_id bigint, text string")
    assert sorted((r.item_id, r.char_start, r.char_end) for r in splitting.split_items(items, limits).collect()) == [(1, 0, 5), (1, 5, 7), (2, 0, 10), (3, 0, 10)]
    assert {r.item_id for r in splitting.split_items(items, limits, only_over=True).collect()} == {1}


def test_distinct_tells_hashes_apart_by_both_halves():
    pairs = np.array([[1, 1, 0, 1, 0], [2, 3, 5, 2, 5]], np.uint64)
    first, kind = bpe.distinct(pairs)
    assert (pairs[:, first][:, kind] == pairs).all() and len(first) == 3
    assert len(bpe.distinct(pairs[:, :0])[0]) == 0


def test_oversized_counts_code_points(spark):
    limits = spark.createDataFrame([("excerpt", 5, 1), ("window", 3, 0)], "item_kind string, max_size int, overlap_size int")
    excerpts = spark.createDataFrame([(1, "😀" * 5), (2, "abcdef"), (2, "abcdef"), (3, None), (4, "")], "excerpt_id bigint, text string")
    slices = spark.createDataFrame([(1, "abcd"), (2, "abc")], "slice_id bigint, text string")
    assert sorted(map(tuple, splitting.oversized(excerpts, slices, limits).collect())) == [("excerpt", 2), ("window", 1)]


def _rank_rows(spark):
    main = [(1, 1, 1000.0, 0.1, "e"), (1, 2, 900.0, 0.9, "e"), (1, 3, None, 0.8, "e"), (1, 3, None, 0.8, "e"), (2, 7, float("nan"), None, "e"), (2, 8, float("nan"), None, "e")]
    candidates = spark.createDataFrame(main, "query_id bigint, element_id bigint, lexical_score double, semantic_score double, rrf_score string")
    others = spark.createDataFrame([(1, 2, 0.03), (1, 3, 0.02)], "query_id bigint, element_id bigint, rrf_score double")
    options = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.2)], "query_id bigint, alpha double")
    return candidates, others, options


def test_ranking_is_not_ruled_by_range(spark):
    assert sorted(map(tuple, ranking.first_candidates(*_rank_rows(spark)).collect())) == [(1, 2), (2, 7)]


def test_hot_queries_get_the_same_places(spark):
    random.seed(6)
    rows = [(q, i, float(random.randint(0, 60)), float(random.randint(0, 2)), random.random()) for q in (1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "query_id bigint, element_id bigint, lexical double, semantic double, rrf double")
    columns = ["query_id", "element_id", "place_lexical", "place_semantic", "place_rrf"]
    one = sorted(map(tuple, ranking.window_places(df).select(columns).collect()))
    assert one == sorted(map(tuple, ranking.ranged_places(df, 100).select(columns).collect()))
    for q, i, *places in one:
        own = [r for r in rows if r[0] == q]
        me = next(r for r in own if r[1] == i)
        for k, place in enumerate(places, 2):
            assert place == sum(r[k] > me[k] for r in own) + (sum(r[k] == me[k] for r in own) + 1) / 2


def test_ranking_order_and_hot_path(spark):
    frames = _rank_rows(spark)
    one = sorted(map(tuple, ranking.median_rank(*frames).collect()))
    assert one == sorted(map(tuple, ranking.median_rank(*frames, hot_rows=1).collect()))
    # places of element 2 are 2, 1 and 1 with weights 0.5, 0.25 and 0.25: half of the weight is reached two thirds of the way from 1 to 2
    assert next(r for r in one if r[:2] == (1, 2)) == (1, 2, round(1 + 1 / 3, 6), 1.5)
    assert sorted(map(tuple, ranking.first_candidates(*frames, hot_rows=1).collect())) == [(1, 2), (2, 7)]
    assert ranking.first_candidates(frames[0].limit(0), frames[1], frames[2]).count() == 0


def _brute_share(text, least):
    number, _, place, unspaced = repetition.words_of([text])
    n, mark, best = len(number), [False] * len(number), 0
    least = 2 * least if unspaced.sum() * 2 > n else least
    for p in range(n):
        size = 0
        for q in range(p):
            k = 0
            while p + k < n and number[q + k] == number[p + k]:
                k += 1
            size = max(size, k)
        best = max(best, size)
        if size >= least:
            mark[p : p + size] = [True] * size
    weight = [(place[i + 1] if i + 1 < n else len(text)) - place[i] for i in range(n)]
    return sum(w for w, m in zip(weight, mark) if m) / max(1, sum(weight)), best


def test_repetition_agrees_with_brute_force():
    random.seed(7)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 25))) for _ in range(80)] + ["日本日本日本語日本日本日本語日本", "", "..."]
    share, longest = repetition.repeated(texts, 3)
    for i, text in enumerate(texts):
        a, b = _brute_share(text, 3)
        assert abs(a - share[i]) < 1e-9 and b == longest[i]


def test_short_phrases_and_numbers():
    rng = random.Random(12)
    noise = lambda k: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(k))
    spam = " ".join(f"buy the best cheap watches now {noise(3)}" for _ in range(200))
    turns = " ".join(f"as a matter of fact {noise(60)}" for _ in range(30))
    few = " ".join(f"one two three four five {noise(5)}" for _ in range(5))
    numbers, table = "12 7 5 99 1\n" * 500, "\n".join(f"{i * 37 % 1009} {i * 91 % 1013} {i * 17 % 991}" for i in range(400))
    logs = "\n".join(f"{i} {i * 7} {noise(12)} {i}" for i in range(60))
    shares, _, parts = repetition.measures([spam, turns, few, numbers, table, logs, "=" * 5000])
    assert shares[0] > 0.55 and shares[1] < 0.01 and shares[2] < 0.01 and shares[3] > 0.99 and shares[4] < 0.05 and shares[5] < 0.01 and shares[6] == 0
    assert parts[3] > 0.99 and parts[0] == 0


def test_each_limit_counts(spark):
    once = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    df = spark.createDataFrame([(1, once + " " + once), (2, once)], "doc_id bigint, text string")
    ids = lambda **k: [r.doc_id for r in repetition.repetitive(df, **k).collect()]
    assert ids(limit=2.0, longest_limit=0.45) == [1] and ids(limit=0.4, longest_limit=2.0) == [1] and ids(limit=2.0, longest_limit=0.55) == []


def test_repetition_rows(spark):
    same = "the quick brown fox jumps over the lazy dog near river {}. "
    rows = [(1, "".join(same.format(i) for i in range(9))), (1, "".join(same.format(i) for i in range(9))), (2, None), (3, ""), (4, "all different words here " + " ".join(chr(97 + i % 26) * (i // 26 + 1) for i in range(200)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in repetition.repetitive(df).collect()] == [1]
    assert repetition.repetition(df).count() == 4
    assert repetition.repetitive(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
