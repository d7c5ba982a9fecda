"""SimHash, decontamination, top-k, quality, HTML and the pipeline against brute force."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verdigris.llm import common, components, decontaminate, html_text, quality, shingle_links, simhash, topk
from verdigris.llm.dom import Matching, Shape, fold, in_order, parse


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, bits, sets=None):
    """Components of fingerprints within bits, or of sets with a Jaccard similarity of 0.8."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= bits or sets is not None and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if near and find(i) != find(j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_are_by_majority(docs):
    for r in docs.where("text is null or length(text) < 1000").collect():
        assert simhash.fingerprint(r.text or "", 3) == plain_fingerprint(r.text, 3)


def test_anchors_cover_every_pair():
    rng, c = np.random.default_rng(1), simhash.Covering(2)
    x = rng.integers(-(2**63), 2**63 - 1, 300)
    which, anchor, _ = c.anchors(x)
    own = {}
    for i, a in zip(which.tolist(), anchor.tolist(), strict=True):
        assert a not in own.setdefault(i, set())
        own[i].add(a)
    assert 143 < len(which) / len(x) < 163
    for i in range(300):
        y = int(x[i]) & (2**64 - 1)
        for b in rng.choice(64, i % 3, replace=False):
            y ^= 1 << int(b)
        _, a, home = simhash.Covering(0).anchors(np.array([y], np.uint64).view(np.int64))
        assert home.all() and int(a[0]) in own[i]


def test_components_equal_brute_force(spark, docs, none):
    rng = np.random.default_rng(2)
    base = [int(v) for v in rng.integers(0, 2**63, 30)]
    fps = list(dict.fromkeys(base + [b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(8)] + [0, 1, 3, 7, 15, 31, 63]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2)
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}
    got = rows(links)
    assert set(got) == want and len(got) == len(want)
    root = dict(rows(components.connected_components(links)))
    by = {}
    for f, g in zip(signed, groups(fps, 2), strict=True):
        by.setdefault(g, []).append(f)
    for members in by.values():
        assert {root.get(m, m) for m in members} == {min(members)}
    found = simhash.near_duplicates(docs, words=3, bits=2).collect()
    data = docs.collect()
    fp = [plain_fingerprint(r.text, 3) for r in data]
    g = groups(fp, 2)
    least = {x: min([r.doc_id for r, y in zip(data, g, strict=True) if y == x and r.doc_id is not None], default=None) for x in g}
    assert sorted([(r.doc_id, r.component_id) for r in found], key=str) == sorted([(r.doc_id, least[x]) for r, x in zip(data, g, strict=True)], key=str)
    assert simhash.near_duplicates(none).collect() == []
    for near in (8_000_000, 0):
        kept = simhash.keep_one(docs, words=3, similarity=None, near_ids=near)
        assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted({least[x] for x in g}, key=str) and kept.columns == docs.columns


def test_similar_texts_are_linked_and_others_are_not(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [[word() for _ in range(120)] for _ in range(12)]

    def edited(w, n):
        w = list(w)
        for i in range(n):  # each change of a word changes five shingles
            w[7 + i * 11] = word()
        return " ".join(w)

    texts = [(100 * b + i, edited(w, n)) for b, w in enumerate(base) for i, n in enumerate([0, 1, 2, 2, 2, 5, 9])] + [(9000, None), (9001, ""), (9002, "one two"), (9003, "One  TWO"), (9004, "one three")]
    texts += [(9100 + i, " ".join(base[0])) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in texts]
    g = groups([plain_fingerprint(t, 5) for _, t in texts], 2, sets)
    least = {x: min(d for (d, _), y in zip(texts, g, strict=True) if x == y) for x in g}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 2, 0.8).collect()}
    assert got == {d: least[x] for (d, _), x in zip(texts, g, strict=True)}
    assert got[103] == 100 and got[106] == 106  # two changed words of 120 are near, nine are not


def test_texts_with_one_fingerprint_are_compared_by_their_own_sets(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(100)) for c in "xy")
    # a shingle that is over half of a text is its fingerprint; a set holds it once
    texts = ["0 " * 200 + y, "0 " * 200 + x, "0 " * 10 + x, "0 " * 10 + y, "z " + x[::-1]]
    assert simhash.fingerprint(texts[0], 5) == simhash.fingerprint(texts[1], 5) and len({simhash.fingerprint(t, 5) for t in texts}) == 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 2, 0.8).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert {r.doc_id for r in simhash.keep_one(df, 5, 2, 0.8).collect()} == {0, 4}


@pytest.mark.parametrize("cell", [1024, 1])
def test_members_far_from_their_leader_are_compared_with_all(spark, monkeypatch, cell):
    monkeypatch.setattr(shingle_links, "CELL", cell)
    sets = {1: range(100), 2: range(15, 110), 3: range(30, 125), 4: range(500, 600)}
    packed = spark.createDataFrame([(k, bytearray(np.array(list(v), np.uint64).tobytes())) for k, v in sets.items()], "node long, shingles binary")
    members = spark.createDataFrame([(7, n) for n in sets] + [(8, 1), (9, 4)], "key long, node long")
    asked = lambda nodes: packed.join(nodes, "node")
    for least in (0.5, 0.7, 0.9):
        want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= least * len({*sets[a]} | {*sets[b]})}
        root = {n: n for n in sets} | dict(rows(components.connected_components(shingle_links.similar_links(members, asked, least))))
        expected = {n: n for n in sets} | dict(rows(components.connected_components(spark.createDataFrame(list(want) or [(1, 1)], "a long, b long"))))
        assert root == expected
    assert shingle_links.similar_links(members.where("false"), asked, 0.8).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicas_are_not_broadcast(spark):
    fps = common.materialize(spark.range(300).select(F.xxhash64("id").alias("fp")).unionAll(spark.sql("select xxhash64(5L) ^ 3")), "test-fps")
    for kind in (simhash.near_links(fps, 2), simhash.near_links(fps.where("false"), 2)):
        assert "SortMergeJoin" in plan_of(kind) and "BroadcastHashJoin" not in plan_of(kind)
    links = simhash.near_links(fps, 2)
    assert len(links.collect()) == 1 and "BroadcastHashJoin" not in plan_of(links)  # as it ran
    common.discard(fps)


def test_cells_of_large_buckets_are_not_broadcast(spark):
    """Members of a bucket of 20,000 are 40 rows each, which Spark's estimate does not show."""
    members = common.materialize(spark.range(8).selectExpr("1L as key", "id as node", "20000L as size", "id as comp"), "test-members")
    sets = common.materialize(spark.createDataFrame([(n, bytearray(np.arange(n // 2, 100, dtype=np.uint64).tobytes())) for n in range(8)], "node long, shingles binary"), "test-sets")
    links = shingle_links.settled(members, sets, 0.8)
    assert "SortMergeJoin" in plan_of(links) and "BroadcastHashJoin" not in plan_of(links)
    assert len(set(dict(rows(components.connected_components(links))).values())) == 1
    common.discard(members, sets)


def test_the_stage_finds_the_pairs_that_brute_force_finds(spark):
    """Recall and precision of the near-duplicates at a similarity of 0.8, on given documents."""
    data = [r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 5000").collect() if r.text]
    sets = {}
    for r in data:
        sets.setdefault(frozenset(simhash.shingle_hashes(r.text, 5).tolist()), []).append(r.doc_id)
    distinct = [s for s in sets if s]
    holders = {}
    for i, s in enumerate(distinct):
        for h in s:
            holders.setdefault(h, []).append(i)
    # texts so alike share shingles that few others have
    near = {(i, j) for h in holders.values() if len(h) <= 50 for k, i in enumerate(h) for j in h[k + 1 :]}
    pairs = [(i, j) for i, j in near if len(distinct[i] & distinct[j]) >= 0.8 * len(distinct[i] | distinct[j])]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(data), 5, 2, 0.8).collect()}
    linked = [got[sets[distinct[i]][0]] == got[sets[distinct[j]][0]] for i, j in pairs]
    assert len(pairs) > 10 and sum(linked) >= 0.99 * len(pairs)
    partner = {d for i, j in pairs for k in (i, j) for d in sets[distinct[k]]} | {d for ids in sets.values() if len(ids) > 1 for d in ids}
    sizes = Counter(got.values())
    assert sum(sizes[c] > 1 and d not in partner for d, c in got.items()) <= 0.01 * len(got)


def test_long_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    root = dict(rows(components.connected_components(links)))
    assert {root[i] for i in range(1, 201)} == {0} and root[501] == 500 and 7 in root
    assert components.connected_components(links.where("false")).collect() == []


ITEM = "Tom has 3 apples and buys 5 more apples from Anna in Paris. How many apples does Tom have after 2 days if each costs 4 dollars?"
CHANGED = "Noise first. Tim has 7 apples and buys 9 more apples from Jane in Rome. How many apples does Tim have after 6 days if each costs 8 euros? More noise."
TORN = ITEM.replace("3 apples and buys 5", "3 apples and buys 6").replace("Anna", "Eve")


def leaks(spark, items, texts, coverage=0.5, run=99):
    """{(document's place, item's place): (coverage, longest run, changed)}."""
    bench, d = (spark.createDataFrame(list(enumerate(x)), f"{c} long, text string") for c, x in (("item_id", items), ("doc_id", texts)))
    return {(r.doc_id, r.item_id): (r.coverage, r.longest_run, r.changed) for r in decontaminate.find_leaks(d, bench, coverage, run).collect()}


def test_decontamination_finds_copies_and_changed_values(spark, docs, none):
    bench = spark.createDataFrame([(1, ITEM), (2, "one two"), (3, None), (None, "this is a question with only seven words"), (1, ITEM), (7, ITEM), (5, "")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x " + ITEM.upper().lower() + " y"), (2, CHANGED), (3, "apples and days and dollars, nothing else to see here at all"), (4, None), (5, "so this IS a question: with only seven words!"), (6, ITEM), (6, ITEM), (7, ITEM[:70]), (None, ITEM)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(d, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, None), (6, 1), (None, 1), (1, 7), (2, 7), (6, 7), (None, 7)}  # half of an item is not enough
    assert got[2, 1].changed and not got[6, 1].changed and got[6, 1].coverage == 1.0
    for near in (8_000_000, 0):
        kept = [r.doc_id for r in decontaminate.drop_leaks(d, bench, near_ids=near).collect()]
        assert sorted(kept) == [3, 4, 7]
    assert decontaminate.find_leaks(docs, bench).collect() == [] and decontaminate.find_leaks(none, bench).collect() == []
    assert rows(decontaminate.drop_leaks(docs, bench).select("doc_id")) == rows(docs.select("doc_id")) and decontaminate.drop_leaks(docs, bench).columns == docs.columns
    assert decontaminate.find_leaks(d, bench.where("false")).collect() == [] and decontaminate.drop_leaks(d, bench.where("false")).count() == 9


def test_decontamination_needs_consistent_values(spark):
    item = "Anna gave 3 pears to Bill and then Bill gave 3 pears back to Anna so who has 3 pears now"
    good = "Eva sent it. Anna gave 4 pears to Carl and then Carl gave 4 pears back to Anna so who has 4 pears now"
    torn = "Anna gave 4 pears to Carl and then Dora gave 5 pears back to Emil so who has 6 pears now"
    # over the whole item: words in between make two alignments, which must agree as well
    long = "Anna gave 3 pears to Bill and then Bill gave 3 pears back to Anna. After that the two friends went home with 3 pears that Anna had left for Bill and his dog"
    parted = lambda a, n: f"{a} gave {n} pears to Carl and then Carl gave {n} pears back to {a}. This is said in between. After that the two friends went home with 7 pears that Fred had left for Carl and his dog"
    got = leaks(spark, [item, long], [good, torn, parted("Fred", 7), parted("Gina", 9)], 0.6)
    assert (0, 0) in got and (1, 0) not in got and (2, 1) in got and (3, 1) not in got


def test_decontamination_finds_changed_names_at_sentence_starts(spark):
    item = "Tom has 12 apples and Anna has 7 pears. Tom buys 3 more apples. How many fruits does Tom have?"
    consistent = "Sam has 15 apples and Lisa has 9 pears. Sam buys 4 more apples. How many fruits does Sam have?"
    got = leaks(spark, [item], [consistent, "Well, " + consistent, "Sam has 15 apples and Lisa has 9 pears. Max buys 4 more apples. How many fruits does Eve have?"])
    assert got == {(0, 0): (1.0, 20, True), (1, 0): (1.0, 20, True)}


def test_runs_of_numbers_and_names_are_one_placeholder(spark):
    item = "the train from Paris to Rome takes 25 hours and the bus takes Anna 3 days more than that"
    got = leaks(spark, [item], ["the train from New York to San Juan takes twenty five hours and the bus takes Mary Ann 12 days more than that", "the train from Oslo to Rome takes 25 hours or so"])
    assert got == {(0, 0): (1.0, 19, True)}


def test_decontamination_finds_short_items_and_scripts_without_spaces(spark):
    got = leaks(spark, ["Name the 3", "日本の首都は東京です", "Paris"], ["He said: name THE 3!", "name the 4", "問題。日本の首都は東京ですか", "中国の首都は北京です", "to paris, then", "so?\nPARIS\nyes", "", "name the 3 things"])
    assert set(got) == {(0, 0), (2, 1), (5, 2)}  # few words match only as a whole sentence or line


def test_rows_of_numbers_are_no_template(spark):
    numbers = lambda seed, n: ", ".join(str(x) for x in np.random.default_rng(seed).integers(0, 10**6, n))
    words, begins = decontaminate.Canonicalizer()([numbers(1, 6000)])
    begin = time.time()
    mine = [np.unique(decontaminate.windows(r, 8)[1]) for r in words]
    assert all(len(x) > 5900 for x in mine) and time.time() - begin < 0.1
    assert leaks(spark, [numbers(2, 400)], [numbers(1, 6000), numbers(3, 50) + ", " + numbers(2, 400)]) == {(1, 0): (1.0, 400, False)}


def test_large_benchmark_in_one_pass(spark):
    word = lambda x: "".join(chr(97 + x // 26**k % 26) for k in range(5))
    items = [" ".join([f"what is {i} of", *(word(7 * i + j) for j in range(9)), "together?"]) for i in range(20_000)]
    got = leaks(spark, items, ["So " + items[5].replace("is 5 of", "is 99 of"), items[19_999], "nothing of it"])
    assert set(got) == {(0, 5), (1, 19_999)} and got[0, 5][2]


def slow_readings(text):
    """The three readings by plain loops: lists of (code, value, is a slot, is a head)."""
    d = decontaminate
    kind = lambda t: d._kind(t, t.lower())
    tokens = [t.lower() if kind(t) == d.LITERAL else t for t in d.TOKEN.findall(text)]
    words, begins, apart, last = [], True, True, None
    for t in tokens:
        k = kind(t)
        if k in (d.STOP, d.COMMA):
            begins, apart = begins or k == d.STOP, True
            continue
        if k == d.UNIT and (last != d.NUM or apart):
            k = d.LITERAL
        words.append([k, t.lower(), begins and k == d.NAME, apart])
        begins, apart, last = False, False, k
    plain = [(w[1], (w[1],), False, False) for w in words]
    out = {d.PLAIN: plain}
    for way in (d.TEMPLATE, d.NAMED):
        reading, before = [], None
        for k, t, head, cut in words:
            if head and way == d.TEMPLATE:
                k = d.LITERAL
            if k in (d.NUM, d.NAME) and k == before and not cut:
                reading[-1] = (reading[-1][0], (*reading[-1][1], t), True, reading[-1][3])
            else:
                reading.append((t if k == d.LITERAL else k, (t,), k != d.LITERAL, head and way == d.NAMED))
            before = k
        out[way] = reading
    return out


def slow_matches(text, item, coverage, run):
    """The template matcher without hashes, filters or joins."""
    theirs, best = slow_readings(text), None
    for way, mine in slow_readings(item).items():
        n = min(8, len(mine))
        if n < 5:
            continue
        by = {}
        for other, words in theirs.items():
            if (way == decontaminate.PLAIN) != (other == decontaminate.PLAIN):
                continue
            for i in range(len(mine) - n + 1):
                for j in range(len(words) - n + 1):
                    a, b = mine[i : i + n], words[j : j + n]
                    if [x[0] for x in a] != [x[0] for x in b]:
                        continue
                    same = [x[1] for x in a] == [x[1] for x in b]
                    literal = sum(not x[2] or x[3] and x[1] == y[1] for x, y in zip(a, b, strict=True))
                    if same or 2 * literal >= n:
                        by.setdefault((other, j - i), {})[i] = (same, {(x[1], y[1]) for x, y in zip(a, b, strict=True) if x[2]})
        good = []
        for key, ws in by.items():
            pairs = set().union(*(p for _, p in ws.values()))
            torn = {x for x, y in pairs if any(x == u and y != v for u, v in pairs)}
            ok = {i: w for i, w in ws.items() if w[0] or not torn & {x for x, _ in w[1]}}
            good.append((-len(ok), key, ok))
        taken, covered, longest, changed = {}, set(), 0, False
        for _, _, ws in sorted(good, key=lambda g: g[:2]):
            ws = {i: w for i, w in ws.items() if all(taken.get(x, y) == y for x, y in w[1])}
            for _, pairs in ws.values():
                taken.update(pairs)
            covered |= set(ws)
            changed |= not all(w[0] for w in ws.values())
            for i in ws:
                k = i
                while k in ws:
                    k += 1
                longest = max(longest, k - i + n - 1)
        found = (len(covered) / (len(mine) - n + 1), longest, changed)
        if covered and (found[0] >= coverage or longest >= run) and (best is None or (found[0], not changed, longest) > (best[0], not best[2], best[1])):
            best = found
    return best


def test_decontamination_equals_a_slow_template_matcher(spark):
    rng = random.Random(3)
    words = ["has", "apples", "and", "then", "pears", "gives", "to", "Anna", "Tom", "New York", "Rome", "3", "twenty five", "7 km", "Who", "How many", ".", ",", "?"]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 22))) for _ in range(25)]

    def variant(t):
        for a, b in (("Anna", "Eva"), ("Tom", "Max"), ("3", "44"), ("Rome", "San Juan"), ("7", "twenty one")):
            if rng.random() < 0.5:
                t = t.replace(a, b, rng.choice([-1, -1, 1]))
        return t

    texts = [" ".join([rng.choice(["Intro here.", ""]), variant(rng.choice(items)), rng.choice(["", "said so.", variant(rng.choice(items))])]) for _ in range(60)]
    want = {(i, j): m for i, t in enumerate(texts) for j, x in enumerate(items) if (m := slow_matches(t, x, 0.5, 12))}
    assert leaks(spark, items, texts, 0.5, 12) == want and sum(m[2] for m in want.values()) > 10 and sum(not m[2] for m in want.values()) > 3


def test_decontamination_equals_brute_force_windows(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"\w+", t.lower())
    items = {r.item_id: words(r.text) for r in b.collect()}
    want = set()
    for r in d.collect():
        w = words(r.text or "")
        have = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for i, t in items.items():
            own = [tuple(t[j : j + 8]) for j in range(len(t) - 7)]
            if own and sum(x in have for x in own) >= 0.9 * len(own):
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()} == want and want


def plain_top(vectors, wanted, k):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max([len(v) for _, v in ok], default=0)
    ok = [(i, v + [0] * (width - len(v))) for i, v in ok]
    out = []
    for q, v in ok:
        if q in wanted:
            scored = sorted([(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q])[:k]
            out += [(q, n + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_is_exact(spark, scale):
    rng = np.random.default_rng(3)
    v = [(i, [float(x) * scale for x in rng.normal(size=6)]) for i in range(300)] + [(300 + i, [0.5 * scale, -0.25, 0.0, 1.0, 2.0, -1e-20]) for i in range(60)]
    v += [(400, None), (401, [1.0, None, 2.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, []), (405, [3.0]), (20, v[3][1]), (40, v[40][1]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, x, "extra") for i, x in v], "vec_id long, embedding array<double>, score string")
    wanted = {i for i, _ in v if i is not None and i % 20 == 0}
    index = topk.PivotIndex(df, pivots=8, annulus=16)
    want = plain_top([x for x in v if x[0] is not None], wanted, 7)
    index_rows = topk.PivotIndex(df.where("vec_id is not null"), pivots=8, annulus=16)
    got = sorted(map(tuple, index_rows.search(df.where("vec_id % 20 = 0"), 7).collect()))
    assert got == want
    assert sorted(map(tuple, index_rows.search(df.where("vec_id % 20 = 0"), 7, block=3).collect())) == want
    assert sum(len(r.ids) for r in index.annuli.collect()) == 300 + 60 + 5


def test_bounds_rule_out_most_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(50, 16))
    v = [(i, (centres[i % 50] * (1 + i % 3) + 0.05 * rng.normal(size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    index = topk.PivotIndex(df, annulus=64)
    got = sorted(map(tuple, index.search(df.where("vec_id % 100 = 0"), 5).collect()))
    assert got == plain_top(v, {i for i, _ in v if i % 100 == 0}, 5)
    assert 0 < index.share < 0.5


def test_top_k_of_nothing_and_of_few(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert list(map(tuple, topk.PivotIndex(df).search(df.where("vec_id = 20")).collect())) == [(20, 1, 1, 64 * 32 + 128 * 32)]
    assert topk.PivotIndex(df.where("false")).search(df.where("false")).collect() == []


def plain_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by its definition, with dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        p = "\0" * (order - 1) + t
        counts[order].update(p[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


def test_kneser_ney_equals_its_definition(spark):
    trusted, other = ["abracadabra abra", "banana band", "cabbage"], ["abba zz", "quux", "brabant"]
    counts = quality.gram_counts(spark.createDataFrame([(t,) for t in trusted], "text string"), 3)
    raw = plain_kneser_ney(trusted, 3)
    assert {r.g: r.n for r in counts.collect()} == dict(raw[3])
    rows, unseen = quality.model_rows(counts, 3)
    rows = quality.hashed_rows(rows)
    whole = quality.Model(rows.toArrow(), 3, unseen)
    parts = [quality.Model(rows.where(f"middle < 0 or pmod(middle, 3) = {i}").toArrow(), 3, unseen, i, 3) for i in range(3)]
    disc = {k: quality.discounts(*[sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for k, c in raw.items()}

    def p(g):
        k = len(g)
        own = {x: n for x, n in raw[k].items() if x[:-1] == g[:-1]}
        d = disc[k]
        off = lambda n: d[min(n, 3) - 1] if n else 0.0
        low = 1 / (len(raw[1]) + 1) if k == 1 else p(g[1:])
        total = sum(own.values())
        return low if not total else (own.get(g, 0) - off(own.get(g, 0))) / total + sum(off(n) for n in own.values()) / total * low

    want = [sum(math.log(p(("\0\0" + t)[i : i + 3])) for i in range(len(t))) for t in trusted + other]
    assert whole.sums(trusted + other)[0].tolist() == pytest.approx(want, abs=1e-9)
    assert sum(m.sums(trusted + other)[0] for m in parts).tolist() == pytest.approx(want, abs=1e-9)


def test_quality_paths_agree_and_edges_are_defined(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (6, 1, 0), (10, 0, 0), (8, 1, 1), (None, 1, 0), (9, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    a, b = quality.classify(docs, labels), quality.classify(docs, labels, near_rows=40, near_ids=0)
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    x, y = sorted(map(tuple, a.collect()), key=key), sorted(map(tuple, b.collect()), key=key)
    assert len(x) == len(y) == docs.count()
    for r, s in zip(x, y, strict=True):
        assert r[:3] == s[:3] and r[5:] == s[5:] and (r[3] is None) == (s[3] is None) and (r[3] is None or r[3] == pytest.approx(s[3], rel=1e-9))
    by = {r[0]: r for r in x}
    assert by[3][3] is None and by[3][6] is False and by[4][6] is False and by[9][5] is False and by[1][5] is True
    assert quality.classify(none, labels).collect() == []
    untrained = quality.classify(docs, labels.where("false")).collect()
    assert all(r.keep == (r.n_chars > 0) for r in untrained)


def test_quality_tells_good_from_bad(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, lab.where("doc_id % 2 = 0")).join(lab.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.keep for r in got if r.quality == 1 and not r.toxic], [r.keep for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.25


def test_a_rare_language_is_judged_by_its_own_quantile(spark):
    rng = np.random.default_rng(3)
    # many wild texts of one language must not loosen the threshold of a language that has few, even ones
    wild = [(i, "".join(chr(97 + x) for x in rng.integers(0, 26, 60)), "aa") for i in range(60)]
    even = [(i, "la le li " * 20, "bb") for i in range(100, 103)]
    bad = [(200, "".join(chr(97 + x) for x in rng.integers(0, 26, 60)), "bb")]
    d = spark.createDataFrame(wild + even + bad, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.classify(d, spark.createDataFrame([(i, 1, 0) for i, _, _ in wild + even], "doc_id long, quality int, toxic int")).collect()}
    assert got[200].threshold == got[100].threshold < 2 < got[0].threshold and not got[200].keep
    assert all(got[i].keep for i in (100, 101, 102))


PAGE = "<html><head><title>T{0}</title></head><body><div class=top><a>Home</a></div><div id=x>Site name</div><div><h2>Title {0}</h2><p>text {0} &amp; more<p>second {0}<ul><li>a {0}<li>b</ul></div><div>Same notice here</div><div class=comments><p>hi {0}</div></body></html>"


def test_wrapper_drops_constants_and_keeps_slots(spark):
    pages = [(i, "http://A.example.org/x", PAGE.format(i)) for i in range(6)] + [(9, "http://b.example.org/", PAGE.format(1))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\ntext 3 & more\nsecond 3\na 3\nb"
    assert got[9].startswith("Home\nSite name\nTitle 1")  # alone on its host: the markup alone decides


def test_every_layout_of_a_host_has_its_own_template(spark):
    one = "<html><head><title>T{0}</title></head><body><div><p>Layout one says hello</p></div><div><p>text {0} of one</p></div></body></html>"
    two = "<html><head><title>U{0}</title></head><body><section><p>Layout two says hello</p><div><p>text {0} of two</p></div></section></body></html>"
    odd = "<html><head><title>Not found</title></head><body><p>Nothing here</p></body></html>"
    pages = [(i, "http://d.example.org/x", (one if i < 60 else two).format(i)) for i in range(64)] + [(64, "http://d.example.org/y", odd)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i} of {'one' if i < 60 else 'two'}" for i in range(64)} | {64: "Nothing here"}


def test_constant_paragraph_between_varying_ones_goes(spark):
    page = "<html><head><title>T{0}</title></head><body><article><h1>Head {0}</h1><p>first {0} words</p><p>Get our letter every week</p><p>second {0} words</p><p>Yes</p></article></body></html>"
    pages = [(i, "http://e.example.org/x", page.format(i)) for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nfirst {i} words\nsecond {i} words\nYes" for i in range(12)}


def test_copies_of_an_article_are_no_template(spark):
    body = "<html><head><title>Same</title></head><body><article><h1>Same</h1><p>words {0}</p></article></body></html>"
    pages = [(i, "http://c.example.org/", body.format("x" if i < 5 else i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "Same\nwords x" and got[7] == "Same\nwords 7"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<article><header><h1>A</h1><p>by me</p></header><p>x<br>y &lt;b&gt; &nbsp; z</p><div class='ad-slot'>no</div><table><tr><td>1<td>2</table><form>f</form><script>if(a<b){}</script><style>p</style><!-- c --> tail</article> out", "A\nx y <b> z\n1\n2\ntail"),
        ("<p title=don't>it's</p><p x='>'>a</p><p y=\">\" z>b</p><p w=\"open>c</p>", "it's\na\nb\nc"), ("a < b <3 <!DOCTYPE x> c", "a < b <3 c"),
        ("", ""), (None, ""), ("<p>a <b>b</b>c<p hidden>z</p>", "a bc"), ("<nav>n</nav><aside>s</aside><p>a</p><footer>f</footer><div class='reader-comments'>c</div><div role='search'>s</div>", "a"),
        ("<article><p>1 &lt 2 &amp;&amp; &am</p></article", "1 < 2 && &am"), ("<main><p>in</p></main><p>out</p>", "in"), ("<p>deep" + "<div>" * 3000 + "x", "deep\nx"),
        ('<article><script>var t="</p>";</script><p><b>One.<br><p>Two <a href="x">link</a>.</p><div style="display: none">h</div></article>', "One.\nTwo link."),
    ],
)
def test_main_text(source, want):
    assert html_text.main_text(source or "") == want


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (None, "x", "<p>a</p>", "b"), (1, "http://h/", "<p>a</p>", "c"), (1, "http://h/", "<p>a</p>", "c")], "page_id long, url string, html string, text string")
    assert rows(html_text.extract(df)) == sorted([(1, None, ""), (None, "x", "a"), (1, "http://h/", "a"), (1, "http://h/", "a")], key=str)
    assert html_text.extract(df.where("false")).collect() == []


def heaviest(a, b):
    """Simple tree matching by trying every choice."""
    if a.tag != b.tag:
        return 0

    def lists(xs, ys):
        if not xs or not ys:
            return 0
        w = heaviest(xs[0], ys[0])
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), w + lists(xs[1:], ys[1:]) if w else 0)

    return 1 + (a.classes == b.classes) + lists(a.kids, b.kids)


def random_tree(rng, depth):
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
    return Shape(rng.choice("abc") if depth < 3 else "a", rng.choice(["", "x"]), kids, [object()])


def test_tree_matching_equals_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        exact, linear = Matching(a, b), Matching(a, b, cells=0)
        assert exact.total == heaviest(a, b) and linear.total <= exact.total
        for m in (exact, linear):
            pairs = list(m.pairs())
            assert m.total == sum(1 + (x.classes == y.classes) for x, y in pairs) and all(x.tag == y.tag for x, y in pairs)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
    xs, ys = ([Shape(t, "", [], []) for t in w] for w in ("abcab", "bcaab"))
    assert len(in_order(xs, ys)) == 4 and in_order(xs, []) == []


def test_runs_of_one_form_fold():
    tree = fold(parse("<ul><li>1<li>2<li>3</ul><div>a</div><div>b</div><section><p>x</section><section><p>y</section><section><p>z</section>"))
    assert [(k.tag, k.repeated, len(k.nodes)) for k in tree.kids] == [("ul", False, 1), ("div", False, 1), ("div", False, 1), ("section", True, 3)]


def test_very_wide_and_very_deep_pages_cost_little(spark):
    wide = "<body><div><h1>T {0}</h1>" + "".join(f"<h2>k{i} {{0}}</h2><p>v{i} {{0}}</p><ul><li>x {{0}}<li>y {{0}}</ul>" for i in range(13_000)) + "</div></body>"
    deep = "<body><div><h1>T {0}</h1>" + "<div>" * 20_000 + "deep {0}</body>"
    for page in (wide, deep):
        begin = time.time()
        template = html_text.induce([page.replace("{0}", str(i)) for i in range(3)])
        html_text.page_blocks(parse(page), template)
        assert template and time.time() - begin < 60


def test_content_is_found_without_article_and_class_names(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    own = pages.selectExpr("*", f"lower(regexp_extract(url, '{html_text.HOST}', 1)) as host", "xxhash64(html) as h")
    hosts = {r.host for r in own.select("host").distinct().collect()}
    assert {r.host for r in html_text.induce_templates(own).collect()} == hosts  # every host has a template
    want = {r.page_id: html_text.main_text(r.html or "") for r in pages.collect()}
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want
    bare = lambda h: re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", re.sub(r' (?:class|id)="[^"]*"', "", h or ""))
    stripped = spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in pages.collect()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(stripped).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_near_and_far_templates_agree(spark):
    one = "<html><head><title>T{0}</title></head><body><div>menu {0}</div><div><p>text {0} of one, and so on and on</p></div></body></html>"
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example.org/x", one.replace("{0}", str(i))) for i in range(30)] + [(99, None, "<p>x</p>"), (98, "http://lone.example.org", "<p>y</p>"), (3, "http://h0.example.org/x", None)], "page_id long, url string, html string")
    near, far = (rows(html_text.extract(pages, near_bytes=n)) for n in (1 << 20, -1))
    assert near == far and (5, "http://h2.example.org/x", "text 5 of one, and so on and on") in near and (98, "http://lone.example.org", "y") in near


def test_only_tokens_that_say_nothing_else_mark_a_section():
    page = "<article><p>a</p><math>x</math><section class=discussion>d</section><div id=related-work>r</div><div class=recipe-menu>m</div><p class=share-price>s</p><output>o</output><label>l</label>"
    assert html_text.main_text(page + "<div class='ad-slot x1'>no</div><section id=reader-comments>no</section><div class=sideBar>no</div></article>") == "a\nx\nd\nr\nm\ns\no\nl"


def test_pipeline_equals_its_parts_by_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "decontaminate", "bpe"]
    step = corpus_pipeline.language(spark, d, sf)
    assert step.columns == d.columns and step.count() >= 0.99 * d.count()
    data = [(r.doc_id, r.text) for r in step.collect()]
    from tests.llm.test_text_ops import expected_lines

    lines = {i: t for i, t, _, _ in expected_lines(data, 10)}
    ids = sorted(lines)
    fp = [plain_fingerprint(lines[i], 5) for i in ids]
    g = groups(fp, 2, [set(simhash.shingle_hashes(lines[i], 5).tolist()) for i in ids])
    kept = sorted({min(i for i, y in zip(ids, g, strict=True) if y == x) for x in g})
    left = {(r.doc_id) for r in decontaminate.find_leaks(spark.createDataFrame([(i, lines[i]) for i in kept], "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == [i for i in kept if i not in left]


def test_all_queries_are_registered():
    """The entry point hides what cannot be imported, so a plain mistake would take the queries away without a word."""
    import __spark_entry__
    import corpus_pipeline
    from verdigris.llm import registry

    every = __spark_entry__.queries()
    assert {n for n in every if n.startswith("op")} == set(registry.QUERIES) and every["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_odd_rows(spark, docs, none):
    import corpus_pipeline

    sf, step, empty = "/root/testdata/sf0.001", docs, none
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step, empty = stage(spark, step, sf), stage(spark, empty, sf)
        assert step.columns == docs.columns and empty.columns == docs.columns, name
    assert empty.collect() == [] and corpus_pipeline.bpe(spark, empty, sf).collect() == []
    got = corpus_pipeline.bpe(spark, step, sf).collect()
    kept = [r.doc_id for r in step.collect()]
    assert sorted([r.doc_id for r in got], key=str) == sorted(kept, key=str) and kept.count(2) == 0 and kept.count(1) == 1
