"""URL filters (1), audio fingerprints (2), resharding (3), mixing (5) and token counts (10) against brute force, and their edge cases."""

import re

import numpy as np
import pytest

from codelattice.llm import op1_urls, op2_audio, op3_shard, op5_mix, op10_tokens

RNG = np.random.default_rng(5)


def urls(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y", 1) for i, u in rows], "page_id long, url string, key string, action string, part int")


def rules(spark, rows):
    return spark.createDataFrame(rows, "rule_id long, pattern string, action string")


def brute_key(url):
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)[^/?#]*([^#]*)", url.strip())
    return m and ",".join(reversed(m[1].lower().rstrip(".").split("."))) + ",)" + (m[2] if m[2].startswith("/") else "/" + m[2])


def brute_decision(key, rows):
    best = []
    for number, pattern, action in rows:
        if pattern and (m := re.match(r"=?([^/?#]+)(.*)", pattern)):
            prefix = ",".join(reversed(m[1].lower().split("."))) + "," + (")" + m[2] if m[2] or pattern.startswith("=") else "")
            if key.startswith(prefix):
                best.append((len(prefix), action == "allow", number, action))
    return len(best), max(best)[2:] if best else (None, None)


def test_url_filters_match_brute_force(spark):
    labels, paths = ["a", "b", "www", "shop", "com", "org", "xn"], ["", "/", "/a", "/a/b", "/ab", "/a?q=1", "/b#frag"]
    pick = lambda: ".".join(RNG.choice(labels, RNG.integers(1, 4)))
    pages = [(i, f"{RNG.choice(['http', 'HTTPS'])}://{pick().upper() if i % 3 else pick()}{RNG.choice(['', ':80'])}{RNG.choice(paths)}") for i in range(600)]
    made = [(j, ("=" if j % 5 == 0 else "") + pick() + str(RNG.choice(["", "", "/a", "/a/b", "/"])), str(RNG.choice(["allow", "block"]))) for j in range(80)]
    for parts in (1, 4, 16):
        got = {r["page_id"]: (r["active"], r["rule_id"], r["action"], r["keep"]) for r in op1_urls.filtered(urls(spark, pages), rules(spark, made), parts=parts).collect()}
        for i, u in pages:
            active, (number, action) = brute_decision(brute_key(u), made)
            assert got[i] == (active, number, action, action != "block")


def test_url_filters_edges(spark):
    pages = [(1, None), (2, ""), (3, "no url"), (None, "http://a.com/x"), (5, "http://a.com/x"), (5, "http://a.com/x"), (6, "http://b.com/" + "y" * 100_000)]
    made = [(1, "a.com", "block"), (1, "a.com", "block"), (2, None, "block"), (3, "", "block"), (4, "b.com/y", "block"), (5, "b.com/y", "allow")]
    got = sorted(((r["page_id"], r["active"], r["rule_id"], r["keep"]) for r in op1_urls.filtered(urls(spark, pages), rules(spark, made)).collect()), key=str)
    assert got == sorted([(1, 0, None, True), (2, 0, None, True), (3, 0, None, True), (None, 2, 1, False), (5, 2, 1, False), (5, 2, 1, False), (6, 2, 5, True)], key=str)
    assert op1_urls.filtered(urls(spark, []), rules(spark, made)).collect() == []
    assert all(r["keep"] for r in op1_urls.filtered(urls(spark, pages), rules(spark, [])).collect())


def brute_aligned(prints):
    """All pairs at all offsets: the least share of differing bits, for pairs within MOST_BITS."""
    out = {}
    for a in prints:
        for b in prints:
            if a < b:
                pa, pb = prints[a][0], prints[b][0]
                for offset in range(-len(pa), len(pb) + 1):
                    first, last = max(0, -offset), min(len(pa), len(pb) - offset)
                    if last - first >= op2_audio.LEAST_OVERLAP:
                        share = int(np.bitwise_count(pa[first:last] ^ pb[first + offset : last + offset]).sum()) / (32 * (last - first))
                        if share <= min(op2_audio.MOST_BITS, out.get((a, b), (0, 1))[1] - 1e-15):
                            out[a, b] = (offset, share)
    return out


def test_audio_alignment_matches_brute_force(spark):
    songs = [op2_audio.rendered(RNG.normal(size=64)) for _ in range(5)]
    cut = 6 * op2_audio.HOP
    noisy = songs[0][cut:] + 0.01 * RNG.normal(size=len(songs[0]) - cut)
    media = [(i, bytearray(op2_audio.wav_bytes(s))) for i, s in enumerate([*songs, noisy, songs[1]])]
    df = spark.createDataFrame([(i, m, 1, "k") for i, m in media], "id long, media binary, fingerprint int, key string")
    prints = op2_audio.fingerprints(df)
    got = {(r["a"], r["b"]): (r["offset"], r["error_rate"]) for r in op2_audio.aligned(prints).collect()}
    assert got == brute_aligned({i: op2_audio.fingerprint(op2_audio.wav_samples(bytes(m))) for i, m in media if i < 6})
    assert {k: o for k, (o, _) in got.items()} == {(0, 5): -6}
    rows = {r["id"]: tuple(r)[1:6] for r in op2_audio.matches(prints).collect()}
    assert rows == {0: (0, 0, 1, 5, -6), 5: (5, 0, 1, 0, 6), 1: (1, 1, 0, None, None), 6: (1, 1, 0, None, None)}


def test_audio_recall_over_all_pairs_and_offsets(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 60")
    near = [(v + 1000, [x + float(RNG.normal(0, 0.001 + 0.0003 * (v % 40))) for x in e]) for v, e in table.select("vec_id", "embedding").collect()]
    media = table.select("vec_id", "embedding").union(spark.createDataFrame(near, "vec_id long, embedding array<float>"))
    wanted = brute_aligned({r[0]: op2_audio.fingerprint(op2_audio.rendered_wav(r[1])) for r in media.collect()})
    got = {(r["a"], r["b"]): r["error_rate"] for r in op2_audio.aligned(op2_audio.fingerprints(media, "vec_id", "embedding", op2_audio.rendered_wav)).collect()}
    assert len(wanted) >= 30 and len(got.keys() & wanted.keys()) >= 0.9 * len(wanted) and got.keys() <= wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k][1]) for k in got)


def test_audio_edges(spark):
    song, silence = op2_audio.wav_bytes(op2_audio.rendered(RNG.normal(size=64))), op2_audio.wav_bytes(np.zeros(30_000))
    long = op2_audio.wav_bytes(np.tile(op2_audio.rendered(RNG.normal(size=64)), 20))
    rows = [(1, None), (2, b""), (3, b"RIFF no wave"), (4, song[:2000]), (None, song), (6, song), (6, song), (7, song), (8, silence), (9, silence), (10, long)]
    df = spark.createDataFrame([(i, m and bytearray(m)) for i, m in rows], "id long, media binary")
    prints = op2_audio.fingerprints(df)
    assert op2_audio.aligned(prints).collect() == []
    assert sorted((r["id"], r["class_id"], r["copies"], r["links"]) for r in op2_audio.matches(prints).collect()) == [(6, 6, 1, 0), (7, 6, 1, 0), (8, 8, 1, 0), (9, 8, 1, 0)]
    assert op2_audio.aligned(op2_audio.fingerprints(df.limit(0))).collect() == [] == op2_audio.matches(op2_audio.fingerprints(df.limit(0))).collect()
    again = op2_audio.wav_samples(op2_audio.wav_bytes(samples := op2_audio.rendered([1.0, 0.5, -1])))
    assert np.abs(again - samples).max() < 1e-4


@pytest.mark.parametrize("seed", range(6))
def test_flow_moves_the_fewest_bytes(seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 1000, 9))}
    room = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 1000, 12), 3)}
    room["s20"] = max(0, sum(sizes.values()) - sum(room.values())) + 5
    flows = op3_shard.solve(sizes, room)
    least = sum(max(0, n - room.get(s, 0)) for s, n in sizes.items())
    assert sum(n for a, b, n in flows if a != b) == least
    assert all(sum(n for a, _, n in flows if a == s) == sizes[s] for s in sizes)
    assert all(sum(n for _, b, n in flows if b == s) <= room[s] for s in room)


def shards(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, new_shard string, block int")


def test_resharding_keeps_every_row_and_meets_capacities(spark):
    rows = [(i, "t" * int(RNG.integers(1, 200)), f"s{min(3, int(RNG.exponential(0.7)))}") for i in range(4000)]
    out = op3_shard.resharded(shards(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in out) == sorted(rows)
    total, load = sum(len(t) for _, t, _ in rows), {}
    for r in out:
        load[r["new_shard"]] = load.get(r["new_shard"], 0) + len(r["text"])
    assert max(load.values()) <= total / 4 * (1 + op3_shard.SLACK) * 1.03


def test_one_large_shard_fills_a_hundred(spark):
    rows = [(i, "t" * (100 + i % 7), "only") for i in range(20_000)]
    total = sum(len(t) for _, t, _ in rows)
    out = op3_shard.resharded(shards(spark, rows), shard_bytes=-(-total // 100))
    load = {r[0]: r[1] for r in out.groupBy("new_shard").sum().select("new_shard", "sum(block)").collect()}
    sizes = {r[0]: r[1] for r in out.selectExpr("new_shard", "length(text) AS n").groupBy("new_shard").sum("n").collect()}
    assert len(load) >= 96 and sum(sizes.values()) == total
    assert max(sizes.values()) <= (total / 100 * (1 + op3_shard.SLACK) + 1) * (1 + 2 / op3_shard.FINE) + 600  # a block of a few documents


def test_rewrite_round_trip(spark, tmp_path):
    manifest, rows = {}, []
    for s, n in (("a", 900), ("b", 100), ("c", 500)):
        own = [(len(rows) + i, "t" * 50, s) for i in range(n)]
        rows += own
        spark.createDataFrame(own, "doc_id long, text string, source string").write.parquet(manifest.setdefault(s, str(tmp_path / s)))
    after = op3_shard.rewrite(spark, manifest, str(tmp_path / "new"))
    back = [tuple(r) for p in after.values() for r in spark.read.parquet(p).select("doc_id", "text", "source").collect()]
    assert sorted(back) == sorted(rows)
    assert after["c"] == manifest["c"] and after["a"] != manifest["a"]


def test_resharding_edges(spark):
    rows = [(1, None, "a"), (None, "x", "a"), (None, "x", "a"), (3, "", None), (4, "y" * 300_000, "b"), (4, "y", "b")]
    out = op3_shard.resharded(shards(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "block", "old_shard", "new_shard"]
    assert sorted(((r["doc_id"], r["source"]) for r in out.collect()), key=str) == sorted(((i, s) for i, _, s in rows), key=str)
    assert op3_shard.resharded(shards(spark, [])).collect() == []
    with pytest.raises(ValueError):
        op3_shard.solve({"a": 10}, {"b": 5})


def test_raking_meets_all_margins(spark):
    rows = [(i, "word " * int(RNG.integers(1, 60)) + ("https://x.y" if i % 7 == 0 else ""), f"s{i % 3}", "en" if i % 4 else "fr") for i in range(3000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, lang string, topic int, __mix_p string")
    wanted = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"general": 0.7, "technical": 0.3}}
    out = op5_mix.sampling(df, wanted).collect()
    for dim, shares in wanted.items():
        expected = {k: sum(r["tokens"] * r["probability"] for r in out if r[dim] == k) for k in shares}
        for k, share in shares.items():
            assert expected[k] / sum(expected.values()) == pytest.approx(share, abs=0.005)
    assert {r["doc_id"] for r in out if r["taken"]} == {r["doc_id"] for r in op5_mix.mixed(df, wanted).collect()}
    assert sorted(map(tuple, op5_mix.weights(df, wanted, rounds=2).selectExpr("source", "lang", "topic", "round(probability, 9)").collect())) == sorted(map(tuple, op5_mix.weights(df, wanted, rounds=2, driver_cells=0).selectExpr("source", "lang", "topic", "round(probability, 9)").collect()))


def test_mixing_edges(spark):
    rows = [(1, None, None, None), (2, "", "a", "en"), (None, "some words", "a", "en"), (4, "w " * 100_000, "a", "en"), (5, "w", "b", None), (5, "w", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = op5_mix.sampling(df).collect()
    assert len(out) == len(rows) and all(0 <= r["probability"] <= 1 for r in out)
    assert len({r["taken"] for r in out if r["doc_id"] == 5}) == 1
    assert op5_mix.sampling(df.limit(0)).collect() == [] and op5_mix.mixed(df.limit(0)).collect() == []
    assert op5_mix.mixed(df.where("doc_id <= 2")).count() == 2


SCORES = {"▁": -300, "a": -900, "b": -1000, "c": -1100, "ab": -1500, "abc": -1900, "▁a": -1200, "▁ab": -2000, "bc": -2100, "cc": -2000, "1": -700, ",": -500, "é": -900}


def brute_count(word):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[-1][0] + op10_tokens.unknown_score(SCORES) * size, -best[-1][1] - size)]
        options += [(best[i][0] + SCORES[word[i:end]], -best[i][1] - 1) for i in range(end) if word[i:end] in SCORES]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def brute_tokens(text):
    total = 0
    for m in re.finditer(r"[^\W_]+|[^\w\s]+", text):
        total += brute_count(("▁" if m.start() == 0 or text[m.start() - 1].isspace() else "") + m[0])
    return total


def test_token_counts_match_brute_force(spark):
    texts = ["".join(RNG.choice(list("aabbcc1é ,xß"), RNG.integers(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, tokens int, pre_tokens int")
    got = {r["doc_id"]: r["tokens"] for r in op10_tokens.token_counts(df, scores=SCORES).collect()}
    assert got == {i: brute_tokens(t) for i, t in enumerate(texts)}


def test_token_counts_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a"), (4, "abc"), (4, "abc"), (5, "ab " * 300_000), (6, "c" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["tokens"]) for r in op10_tokens.token_counts(df, scores=SCORES).collect()), key=str)
    per = brute_count("▁ab")
    assert got == sorted([(1, 0), (2, 0), (3, 0), (None, 1), (4, brute_count("▁abc")), (4, brute_count("▁abc")), (5, 300_000 * per), (6, 1 + 25_000)], key=str)
    assert op10_tokens.token_counts(df.limit(0), scores=SCORES).collect() == []
    words = sorted({"▁abcab", "▁abcc", "▁abx", "abcabc", "bcbc", ""})
    assert op10_tokens.counts_of(words, op10_tokens.piece_trie(SCORES), op10_tokens.unknown_score(SCORES)) == [brute_count(w) for w in words]
