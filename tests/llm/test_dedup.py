"""Near duplicates (4), decontamination (7) and repeated passages (9) against brute force, and their edge cases."""

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from codelattice.llm import op4_jaccard, op7_decontaminate, op9_repeats

SCHEMA = "doc_id long, text string, lang string, id long, hash string, size int, head long, a int, __drop_id long, sig array<int>"
RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(3, 9))) for _ in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "h", 2, 3, 4, 5, [1]) for i, t in rows], SCHEMA)


def prose(n):
    return [VOCABULARY[i] for i in RNG.integers(0, len(VOCABULARY), n)]


def grams(text, n=3):
    words = re.findall(r"[a-z0-9]+", text.lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def changed(words, share):
    out = list(words)
    for i in np.flatnonzero(RNG.random(len(out)) < share):
        out[i] = VOCABULARY[RNG.integers(0, len(VOCABULARY))]
    return out


@pytest.fixture(scope="module")
def near():
    rows, number = [], 0
    for size in (4, 9, 15, 30, 60, 150, 400, 1500):
        for _ in range(6):
            base = prose(size)
            for share in (0.0, 0.0, 0.02, 0.05, 0.08, 0.15):
                rows.append((number, " ".join(changed(base, share))))
                number += 1
    return rows


def brute_components(rows, threshold):
    sets = {i: grams(t) for i, t in rows if t}
    pairs, parent = {}, {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and (j := shared / len(sets[a] | sets[b])) >= threshold:
                pairs[a, b] = j
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return pairs, {i: root(i) for i in ids}


def test_near_duplicates_match_brute_force(spark, near):
    pairs, heads = brute_components(near, op4_jaccard.THRESHOLD)
    got = {r["doc_id"]: r for r in op4_jaccard.near_duplicates(frame(spark, near)).collect()}
    together = sum(a in got and b in got and got[a]["group_id"] == got[b]["group_id"] for a, b in pairs)
    assert together >= 0.95 * len(pairs)
    for i, r in got.items():
        low, high = sorted((i, r["partner_id"]))
        assert r["jaccard"] == pytest.approx(pairs[low, high])
        assert heads[i] == heads[r["group_id"]] and r["group_id"] <= i


def test_links_count_every_pair_of_different_sets(spark, near):
    pairs, _ = brute_components(near, op4_jaccard.THRESHOLD)
    sets, linked = {i: frozenset(grams(t)) for i, t in near}, defaultdict(set)
    for a, b in pairs:
        if sets[a] != sets[b]:
            linked[a].add(sets[b])
            linked[b].add(sets[a])
    got = {r["doc_id"]: r for r in op4_jaccard.near_duplicates(frame(spark, near)).collect()}
    assert sum(r["links"] == len(linked[i]) for i, r in got.items()) >= 0.97 * len(got)
    assert all(r["links"] <= len(linked[i]) and sets[r["class_id"]] == sets[i] and r["class_id"] <= i for i, r in got.items())
    assert all(got[i]["links"] == len(linked[i]) for i in got if len(sets[i]) <= 15)


@pytest.mark.parametrize("size", [4, 10, 12, 15, 24])
def test_small_sets_lose_no_pair(size):
    rng = np.random.default_rng(size)
    for _ in range(400):
        shared = rng.integers(0, 1 << 62, size, np.uint64)
        more = [rng.integers(0, 1 << 62, rng.integers(0, 1 + size // 3), np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate((shared, x))) for x in more)
        if len(shared) / (len(shared) + len(more[0]) + len(more[1])) < op4_jaccard.THRESHOLD or max(len(a), len(b)) > op4_jaccard.SMALL:
            continue
        row = np.repeat([0, 1], [len(a), len(b)])
        owner, sig = op4_jaccard.signatures(row, np.concatenate((a, b)), 2, op4_jaccard.THRESHOLD)
        assert set(sig[owner == 0]) & set(sig[owner == 1])


@pytest.mark.parametrize("size", [26, 40, 80, 200, 600, 3000])
def test_large_sets_lose_no_pair(size):
    rng = np.random.default_rng(size)
    counts = rng.integers(0, 5, 1 << op4_jaccard.CELLS).astype(np.uint16)
    for k in range(200):
        shared = rng.integers(0, 1 << 62, size, np.uint64) << np.uint64(2)
        apart = int(size / op4_jaccard.THRESHOLD) - size  # as many as leave the pair just similar
        first = [0, apart // 2, apart, int(rng.integers(0, apart + 1))][k % 4]
        a, b = (np.unique(np.concatenate((shared, rng.integers(0, 1 << 62, m, np.uint64)))) for m in (first, apart - first))
        row, sizes = np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)])
        owner, sig = op4_jaccard.signatures(row, np.concatenate((a, b)), 2, op4_jaccard.THRESHOLD, counts)
        assert set(sig[owner == 0]) & set(sig[owner == 1])
        reach = sizes[owner] - np.concatenate([np.arange(n) for n in np.bincount(owner)])
        order = np.argsort(sig, kind="stable")
        kept, _ = op4_jaccard.mated(sig[order], owner[order], sizes[owner][order], reach[order], op4_jaccard.THRESHOLD)
        assert {0, 1} <= set(owner[order][kept])
        odd = op4_jaccard.parities(row, np.concatenate((a, b)), 2).to_pylist()
        assert op4_jaccard.least_difference(*odd) <= apart


def test_mated_keeps_every_row_of_a_possible_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        sig, ids, size = np.sort(rng.integers(0, 8, n)), rng.permutation(n), rng.integers(1, 60, n)
        reach = rng.integers(np.ceil(0.6 * size - 1e-9).astype(int), size + 1)
        kept, first = op4_jaccard.mated(sig, ids, size, reach, 0.6)
        need = {i for i in range(n) for j in range(n) if i != j and sig[i] == sig[j] and min(size[i], size[j]) >= 0.6 * max(size[i], size[j]) and min(reach[i], reach[j]) >= 0.375 * (size[i] + size[j])}
        assert need <= set(kept.tolist()) and all(sig[k] == sig[f] and ids[f] == min(ids[kept][sig[kept] == sig[k]]) for k, f in zip(kept, first, strict=True))


def barely_similar(size, pairs):
    """Two and two texts of ``size`` words that would not be similar with a few more words changed."""
    rows = []
    for k in range(pairs):
        base, c = prose(size), (size - 2) // 4
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[: size - c], *prose(c)]))]
    return rows


@pytest.mark.parametrize("size", [40, 90, 250])
def test_every_pair_at_the_threshold_is_found(spark, size):
    rows = barely_similar(size, 150)
    pairs, _ = brute_components(rows, op4_jaccard.THRESHOLD)
    got = {(r["doc_id"], r["links"], r["partner_id"]) for r in op4_jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert len(pairs) == 150 and min(pairs.values()) < 0.62
    assert got == {(i, 1, j) for p in pairs for i, j in (p, p[::-1])}


def test_pipeline_keeps_one_of_every_pair_at_the_threshold(spark):
    rows = barely_similar(90, 200)
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 400, 2))


def test_pipeline_keeps_one_of_every_text_and_its_beginning(spark):
    rng, rows, size = np.random.default_rng(20), [], 600
    for k in range(300):  # their sets of 598 and 359 n-grams are just similar; texts from a generator of their own, whatever ran before
        words = [VOCABULARY[i] for i in rng.integers(0, len(VOCABULARY), size)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:361]))]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 600, 2))


def test_tiles_agree_with_plain_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, 6000, np.uint64).astype(np.uint32)
    sets = [np.unique(np.concatenate((base[rng.random(6000) < 0.9], rng.integers(0, 1 << 32, 50).astype(np.uint32)))) for _ in range(7)]
    similar, jaccard = op4_jaccard.tile_links(np.array([1, 1, 2, 3, 4, 5, 6]), sets, np.arange(3), np.arange(2, 7), 0.6)
    for i in range(3):
        for j in range(2, 7):
            exact = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
            assert similar[i, j - 2] == (exact >= 0.6 and i != j)
            assert i == j or jaccard[i, j - 2] == pytest.approx(exact, abs=1e-6)


def test_groups_are_the_same_by_driver_and_by_joins(spark, near):
    key = lambda df: sorted((r["doc_id"], r["group_id"]) for r in df.collect())
    assert key(op4_jaccard.near_duplicates(frame(spark, near))) == key(op4_jaccard.near_duplicates(frame(spark, near), driver_edges=0))


def test_near_duplicates_edges(spark):
    long = " ".join(prose(60_000))
    rows = [(1, None), (2, ""), (3, " ?! "), (None, "the same five words here"), (5, "the same five words here"), (6, "The same, five words HERE!"), (6, "The same, five words HERE!"), (7, "two words"), (8, "words two"), (9, "two words"), (10, long), (11, long + " end")]
    got = {(r["doc_id"], r["group_id"]) for r in op4_jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(5, 5), (6, 5), (7, 7), (9, 7), (10, 10), (11, 10)}
    kept = op4_jaccard.without_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 5, 7, 8, 10], key=str)
    assert op4_jaccard.near_duplicates(frame(spark, [])).collect() == []
    assert op4_jaccard.without_near_duplicates(frame(spark, [])).count() == 0


ITEMS = [
    (1, "A train leaves the station at 9 o'clock and travels 120 km in 2 hours, how fast does the train travel on average?"),
    (2, "Our teacher Maria gave 15 apples to every pupil called Peter, and then Maria took 4 apples back from Peter; what remains?"),
    (3, "Which of the following rivers flows through the largest number of capital cities on the continent of Europe today?"),
]
BENCH = "item_id long, text string, doc_id long, hash int"


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in items], BENCH)


def brute_contaminated(docs, items):
    units, window = set(op7_decontaminate.UNITS), op7_decontaminate.WINDOW

    def template(text):
        out, last = [], None
        for m in re.finditer(r"[A-Za-z0-9]+", text):
            w, low = m[0], m[0].lower()
            number = w[0].isdigit() and w[-1].isdigit()
            if number and last and last[2]:
                out[-1] = (1, text[out[-1][2] : m.end()].lower(), out[-1][2])
                last = (m.start(), m.end(), True)
                continue
            unit = not number and bool(last) and last[2] and low in units
            name = bool(last) and w[0].isupper() and not unit and not number and not re.search(r"[\n!.:?]", text[last[1] : m.start()])
            out.append((1 if number else 2 if unit else 3 if name else 0, low, m.start()))
            last = (m.start(), m.end(), number)
        return [(k, v) for k, v, _ in out]

    def windows(t, size):
        for at in range(len(t) - size + 1):
            part = t[at : at + size]
            for named in (False, True):
                kinds = (1, 2, 3) if named else (1, 2)
                slots = [(k, v) for k, v in part if k in kinds]
                if 2 * len(slots) <= size and (not named or any(k == 3 for k, _ in part)):
                    yield at, named, tuple((k if k in kinds else 0, "" if k in kinds else v) for k, v in part), slots

    found = set()
    for item, text in items:
        t = template(text)
        size = min(window, len(t))
        if size < op7_decontaminate.SHORTEST:
            continue
        own = defaultdict(list)
        for at, named, key, slots in windows(t, size):
            own[named, key].append((at, slots))
        every = {at for places in own.values() for at, _ in places}
        for doc, dtext in docs:
            hits = defaultdict(list)
            for _, named, key, slots in windows(template(dtext or ""), size):
                hits[named] += [(at, list(zip(mine, slots, strict=True))) for at, mine in own.get((named, key), [])]
            matched = set()
            for places in hits.values():
                pairs = {p for _, ps in places for p in ps}
                if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                    matched |= {at for at, _ in places}
            if every and len(matched) >= op7_decontaminate.COVERAGE * len(every) and matched:
                found.add((doc, item, len(matched), len(every)))
    return found


def leaks():
    filler = lambda: " ".join(prose(30))
    return [
        (10, f"{filler()}. {ITEMS[0][1]} {filler()}"),
        (11, f"{filler()}. {ITEMS[0][1].replace('120', '310').replace('9 o', '7 o').replace('2 hours', '5 hours')} {filler()}"),
        (12, f"{filler()}. {ITEMS[1][1].replace('Maria', 'Olga').replace('Peter', 'Ivan').replace('15', '90')} {filler()}"),
        (13, f"{filler()}. {ITEMS[1][1].replace('called Peter', 'called Ivan').replace('15', '90')} {filler()}"),
        (14, ITEMS[2][1].upper()),
        (15, filler()),
        (16, ITEMS[2][1][:40]),
    ]


def test_decontamination_matches_brute_force(spark):
    docs = leaks()
    got = {(r["doc_id"], r["item_id"], r["matched"], r["windows"]) for r in op7_decontaminate.contaminated(frame(spark, docs), benchmark(spark)).collect()}
    assert got == brute_contaminated(docs, ITEMS)
    assert {d for d, *_ in got} >= {10, 11, 12, 14} and not {d for d, *_ in got} & {15, 16}
    unfiltered = op7_decontaminate.contaminated(frame(spark, docs), benchmark(spark), filter_hashes=0)
    assert got == {(r["doc_id"], r["item_id"], r["matched"], r["windows"]) for r in unfiltered.collect()}


def test_decontamination_edges(spark):
    rows = [(1, None), (2, ""), (None, ITEMS[2][1]), (4, ITEMS[2][1]), (4, ITEMS[2][1]), (5, " ".join(prose(50_000)) + ". " + ITEMS[2][1])]
    items = [*ITEMS, (3, ITEMS[2][1]), (None, ITEMS[0][1]), (8, None), (9, "too short")]
    got = [(r["doc_id"], r["item_id"]) for r in op7_decontaminate.contaminated(frame(spark, rows), benchmark(spark, items)).collect()]
    assert sorted(got) == [(4, 3), (5, 3)]
    kept = op7_decontaminate.decontaminated(frame(spark, rows), benchmark(spark, items))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, None], key=str)
    assert op7_decontaminate.contaminated(frame(spark, []), benchmark(spark)).collect() == []
    assert op7_decontaminate.contaminated(frame(spark, rows), benchmark(spark, [])).collect() == []


def brute_passages(rows, size):
    words = defaultdict(list)
    for i, t in rows:
        if i is not None and t:
            words[i].append([(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", t)])
    owners = defaultdict(set)
    windows = lambda w: [tuple(x[0] for x in w[k : k + size]) for k in range(len(w) - size + 1)]
    for i, texts in words.items():
        for w in texts:
            for key in windows(w):
                owners[key].add(i)
    out = set()
    for i, texts in words.items():
        for w in texts:
            spans = []
            for k, key in enumerate(windows(w)):
                if len(owners[key]) > 1:
                    if spans and k <= spans[-1][1]:
                        spans[-1][1] = k + size
                    else:
                        spans.append([k, k + size])
            out |= {(i, w[s][1], w[e - 1][2], e - s) for s, e in spans}
    return out


def test_repeated_passages_match_brute_force(spark):
    rows = [(i, " ".join(prose(int(RNG.integers(20, 300))))) for i in range(40)]
    for k in range(12):
        passage = " ".join(prose(int(RNG.integers(45, 120))))
        for i in (2 * k, 2 * k + 1):
            rows[i] = (i, f"{rows[i][1]}, {passage.title()}! {' '.join(prose(20))}")
    rows += [(50, rows[0][1]), (51, "é " * 30 + rows[2][1])]
    got = {tuple(r) for r in op9_repeats.repeated_passages(frame(spark, rows)).collect()}
    assert got == brute_passages(rows, op9_repeats.PASSAGE)
    small = op9_repeats.repeated_passages(frame(spark, rows), phrases=3, documents=2)
    assert got == {tuple(r) for r in small.collect()}


def test_repeated_passages_edges(spark):
    passage = " ".join(prose(50))
    rows = [(1, None), (2, ""), (None, passage), (4, passage), (5, "x " + passage), (6, " ".join(prose(49))), (7, passage[: len(passage) // 2]), (8, " ".join(prose(40_000)) + " " + passage)]
    got = sorted((r["doc_id"], r["words"]) for r in op9_repeats.repeated_passages(frame(spark, rows)).collect())
    assert got == [(4, 50), (5, 50), (8, 50)]
    alone = [(1, passage), (1, passage)]
    assert op9_repeats.repeated_passages(frame(spark, alone)).collect() == []
    assert op9_repeats.repeated_passages(frame(spark, [])).collect() == []


def test_repeated_passages_inside_a_group_that_shares_only_a_phrase(spark):
    shared = prose(40)
    rows = [(i, " ".join([*prose(60), *shared, *prose(60)])) for i in range(20)]
    for pair in ((9, 10), (12, 15)):
        before, after = prose(10), prose(10)
        for i in pair:
            rows[i] = (i, " ".join([*prose(60), *before, *shared, *after, *prose(60)]))
    base = prose(300)
    rows += [(30 + i, " ".join(changed(base, 0.05))) for i in range(30)]
    got = {tuple(r) for r in op9_repeats.repeated_passages(frame(spark, rows)).collect()}
    assert got == brute_passages(rows, op9_repeats.PASSAGE)
    assert {(i, 60) for i in (9, 10, 12, 15)} == {(i, n) for i, _, _, n in got if i < 20}
    assert got == {tuple(r) for r in op9_repeats.repeated_passages(frame(spark, rows), phrases=3, documents=2).collect()}


def test_decontamination_checks_each_occurrence_by_itself(spark):
    item = "A train travels 120 km in 2 hours to the coast. A train travels 90 km in 3 hours to the hills."
    long = "The red barge of the old miller carries 40 sacks of flour down the quiet river to the town of the bakers every week."
    filler = lambda: " ".join(prose(30))
    docs = [
        (1, f"{filler()}. {item}"),
        (2, f"{filler()}. {long} {filler()}. {long.replace('40', '70')}"),
        (3, f"{filler()}. {item.replace('120', '80').replace('90', '80')}"),
        (4, filler()),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in op7_decontaminate.contaminated(frame(spark, docs), benchmark(spark, [(1, item), (2, long)])).collect()}
    assert got == {(1, 1), (2, 2), (3, 1)}


def test_decontamination_finds_renamed_subjects_of_sentences(spark):
    items = [(1, "Tom has 5 apples. Tom gives 2 to Ann."), (2, "Clara walks to school in the morning. Clara walks home by bus when it rains. How does Clara walk?")]
    renamed = {"Tom": "Sam", "Ann": "Eve", "Clara": "Julia"}
    docs = [(i, " ".join(prose(30)) + ". " + re.sub("Tom|Ann|Clara", lambda m: renamed[m[0]], t)) for i, t in items]
    docs += [(3, "Rain falls on 5 days. Wind blows 2 to three.")]
    got = {(r["doc_id"], r["item_id"]) for r in op7_decontaminate.contaminated(frame(spark, docs), benchmark(spark, items)).collect()}
    assert got == {(1, 1), (2, 2)}
