"""Rules, line dedup, near-duplicates, quality, toxicity and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talkloom.llm import linededup, neardup, quality, rules, toxicity
from talkloom.llm._words import sets, words
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = sum(any(c.isalpha() for c in x) for x in w)
    bullets, ellipses = sum(x.strip(" \t\n\x0b\x0c\r")[0] in "-*\u2022" for x in lines), sum(x.strip(" \t\n\x0b\x0c\r").endswith(("...", "\u2026")) for x in lines)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), letters, bullets, ellipses


def test_rules_are_brute_force(spark, edges, empty, clashing):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcd") + r.choice(["", "", "#", "\n"]) for _ in range(n)) for n in (2, 3, 4, 60, 200)]
    texts += ["- a b\n * c\n\u2022d\nx - y\n-\n" * 9, "so...\nand\u2026 \n...\nmore... no\n" * 9, "12 34. a1 1a !! \u4f60 \u00e9" * 20, "-- 1 2"]
    more = spark.createDataFrame([(200 + i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    docs = edges.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(more)
    want = {d.doc_id: brute_rules(d.text) for d in docs.collect()}
    for row in rules.apply_policy(rules.ledger(docs)).collect():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.n_letter_words, row.n_bullet_lines, row.n_ellipsis_lines) == want[row.doc_id]
        n, repeated = want[row.doc_id][0], want[row.doc_id][4]
        assert row.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (row.kept and row.base_failed)
    assert rules.ledger(empty).count() == 0 and rules.reject_documents(empty).count() == 0
    assert rules.reject_documents(clashing).columns == clashing.columns
    for policy in rules.POLICIES:
        kept = {r.doc_id for r in rules.apply_policy(rules.ledger(docs), policy).where("kept").collect()}
        assert {r.doc_id for r in rules.reject_documents(docs, policy).collect()} == kept
    assert rules.ledger(edges).count() == edges.count()


def test_rules_exact_path_agrees(spark, monkeypatch):
    docs = spark.createDataFrame([(1, prose(4, 500) + " " + prose(4, 100), None, None, None)], SCHEMA)
    want = rules.ledger(docs).first().n_repeat_words
    monkeypatch.setattr(rules, "POSITION_BITS", 5)  # more words than positions: the windows themselves are sorted
    assert rules.ledger(docs).first().n_repeat_words == want == brute_rules(docs.first().text)[4]


def test_ablation_counts(spark, edges):
    ledger = rules.ledger(edges)
    rows = {r.rule: r for r in rules.ablation(ledger).collect()}
    kept = rules.apply_policy(ledger).where("kept").count()
    for rule in rules.RULES:
        failed = [r for r in ledger.collect() if r.failed_bits >> rule.bit & 1]
        assert rows[rule.name].n_failed == len(failed)
        assert rows[rule.name].n_kept_without == kept + sum(r.failed_bits == 1 << rule.bit for r in failed)


def test_lines(spark, edges, empty, clashing):
    rows = [(i, f"menu\nbody {i}\n\nfooter", None, "a", None) for i in range(10)] + [(20, "menu", None, "a", None), (21, "menu\nx", None, "b", None), (22, None, None, None, None), (23, "", None, "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in linededup.dedup_lines(docs, ratio=0.5).collect()}
    assert out[3].text == "body 3\n" and out[3].n_dropped_lines == 2 and out[3].n_lines == 4
    assert out[20].text == "" and out[21].text == "menu\nx" and out[22].text is None and out[23].text == ""
    whole = {r.doc_id: r for r in linededup.dedup_lines(docs, ratio=0.5, spare="all").collect()}
    assert whole[20].text == "menu" and whole[20].n_dropped_lines == 0 and whole[3] == out[3]
    with pytest.raises(ValueError):
        linededup.dedup_lines(docs, spare="some")
    # nothing reaches three pages of a host here: texts come back byte for byte
    same = linededup.strip_boilerplate(edges, ratio=0.99)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, same.collect())) == sorted(map(key, edges.collect()))
    assert linededup.dedup_lines(empty).count() == 0
    assert linededup.strip_boilerplate(clashing).columns == clashing.columns and linededup.dedup_lines(clashing).count() == 2


def brute_lines(rows, ratio, min_pages, spare):
    pages, hosts = defaultdict(int), Counter(h for _, h, _ in rows)
    lines = {(h, t): {x for x in (t or "").split("\n") if WORD.search(x)} for _, h, t in rows}
    same = Counter((h, t) for _, h, t in rows)
    for _, h, t in rows:
        for x in lines[h, t]:
            pages[h, x] += 1
    gone = {k for k, n in pages.items() if n >= min_pages and n > ratio * hosts[k[0]]}
    out = {}
    for i, h, t in rows:
        whole = bool(lines[h, t]) and all((h, x) in gone for x in lines[h, t])
        spared = whole and (spare == "all" or spare == "copies" and same[h, t] > 1)
        kept = [x for x in (t or "").split("\n") if spared or (h, x) not in gone]
        out[i] = (len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), None if t is None else "\n".join(kept))
    return out


@pytest.mark.parametrize("ratio, min_pages, spare", [(0.05, 1, "none"), (0.2, 1, "copies"), (0.1, 3, "all"), (0.5, 2, "none")])
def test_lines_are_brute_force(spark, ratio, min_pages, spare):
    r = random.Random(7)
    pool = ["menu", "footer", "Share this", "", "  ", *[prose(i, 5) for i in range(30)]]
    rows = [(i, r.choice(["a", "b", None]), "\n".join(r.choice(pool[: r.choice([3, 8, 35])]) for _ in range(r.randrange(1, 7)))) for i in range(150)]
    rows += [(200 + i, "a", "menu\nfooter") for i in range(60)] + [(300, "a", None), (301, "c", "only")]
    docs = spark.createDataFrame([(i, t, "en", h, 0) for i, h, t in rows], SCHEMA)
    got = {x.doc_id: (x.n_lines, x.n_dropped_lines, x.text) for x in linededup.dedup_lines(docs, ratio=ratio, min_pages=min_pages, spare=spare).collect()}
    assert got == brute_lines(rows, ratio, min_pages, spare)


def shingle_set(text, size):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    found = {i: shingle_set(t, size) for i, t in rows}
    parent = {i: i for i in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(found)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = found[a], found[b]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(found[i]), root(i), root(i) == i) for i in ids}


def near_copies(seed):
    r = random.Random(seed)
    rows, i = [], 0
    for group, copies in enumerate([1, 2, 5, 60, 40]):
        base = prose(100 * seed + group, r.choice([12, 60, 200, 300])).split(" ")
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                text[r.randrange(len(text))] = r.choice(["swap", "other", "Word", "new"])
            rows.append((i, " ".join(text)))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, "  "), (i + 3, "lone"), (i + 4, "LONE")]


@pytest.mark.parametrize("size, threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates_are_brute_force(spark, size, threshold):
    rows = near_copies(size)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, size, threshold).collect()}
    assert got == brute_components(rows, size, round(100 * threshold))


#: Seeds whose pairs share no node of 14 trees after nine levels of one branch each.
PARTED = [764, 1152, 1302, 1863, 2151, 2416, 2903, 3263, 3409, 3907, 4257, 4298, 4827, 4887, 5367, 5536, 5969]


def loose_cluster(n, seeds):
    """Pairs of word sets of a similarity just over 0.85, by seed, with the smallest ids, and ``n`` sets alike to 0.7."""
    core = [f"w{i}" for i in range(300)]

    def member(r):
        return [w for w in core if r.random() < 0.82]

    rows = []
    for seed in seeds:
        r = random.Random(seed)
        text = member(r)
        swap = int(len(text) * 0.15 / 1.85)
        rows += [text, r.sample(text, len(text) - swap) + [f"x{seed}y{k}" for k in range(swap)]]
    r = random.Random(n)
    return [(i, " ".join(t)) for i, t in enumerate(rows + [member(r) for _ in range(n)])]


@pytest.mark.parametrize("n, wide", [(4000, None), (500, 64)])
def test_planted_pairs_in_a_loose_cluster(spark, monkeypatch, n, wide):
    if wide:
        monkeypatch.setattr(neardup, "WIDE", wide)
    docs = spark.createDataFrame(loose_cluster(n, PARTED), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 1, 0.85).collect()}
    assert len(got) == n + 2 * len(PARTED) and got == {i: i - i % 2 if i < 2 * len(PARTED) else i for i in got}


def test_recall_holds_at_every_depth():
    r, n = np.random.default_rng(4), 1500
    x = r.integers(0, 2**32, (n, neardup.SIGNATURE), dtype="u4")
    y = np.where(r.random(x.shape) < 0.85, x, ~x)
    trees, repeats = neardup.plan(0.85)
    assert neardup.missed(0.85, 14, 1, 5) > 0.05
    assert max(neardup.missed(0.85, trees, repeats, k) for k in range(6)) <= neardup.MISS
    for at in range(0, n, 100):  # two rounds of the branching itself
        found = []
        for sigs in (x[at : at + 100], y[at : at + 100]):
            nodes, row = (np.concatenate(v) for v in zip(*[(neardup._descend(np.full(100, t, np.uint64), sigs, 0.85, 3)) for t in range(1, trees + 1)], strict=True))
            deep = [neardup._descend(start, sigs[row], 0.85, 3) for start in neardup._starts(nodes, repeats)]
            found.append({(int(k), int(row[i])) for keys, of in deep for k, i in zip(keys, of, strict=True)})
        assert len({i for _, i in found[0] & found[1]}) == 100


def test_near_misses_of_one_text_in_several_blocks(spark):
    """Some 600 texts near one template, about the threshold, more than two blocks: every row as brute force has it."""
    r = random.Random(21)
    base = prose(77, 120).split(" ")
    rows = []
    for i in range(600):
        text = list(base)
        for at in r.sample(range(len(base)), r.choice([1, 2, 3, 3, 4, 5])):
            text[at] = f"own{i}x{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(docs, 3, 0.85).collect()}
    want = brute_components(rows, 3, 85)
    assert got == want and 3 < len({c for _, c, _ in want.values()}) < 600


def test_near_duplicates_edges(spark, edges, empty, clashing):
    assert neardup.near_duplicates(empty).count() == 0
    rows = neardup.near_duplicates(edges).collect()
    assert len(rows) == edges.count() and {r.component_id for r in rows if r.doc_id in (15, 16)} == {15}
    kept = neardup.keep_one(clashing)
    assert kept.columns == clashing.columns and kept.count() == 2


def test_repeated_rows_stay_once(spark):
    a, b = prose(11, 80), prose(12, 80)
    rows = [(1, a), (1, a), (1, b), (2, a.upper()), (3, prose(13, 80)), (None, b), (None, b), (None, a), (4, ""), (4, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, n) for n, (i, t) in enumerate(rows)], SCHEMA)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[i] for i in (0, 2, 4, 5, 7, 8, 10, 11)], key=repr)


def test_set_hashes_follow_the_definition():
    import pyarrow as pa

    texts = ["A b\tc d", "a b c d", "a\x0bb", "a b", None, "", "é  É x", "a b c a b c a b c"]
    got = sets(words(pa.array(texts)), 3)
    want = [shingle_set(t, 3) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    assert (got[0] == got[1]).all() and (got[2] == got[3]).all()


def labelled(spark):
    good = [(i, prose(i, 80), "en", "s", 1) for i in range(120)]
    bad = [(500 + i, " ".join(f"{w}$$$ ###" for w in prose(i, 40).split()), "en", "s", 1) for i in range(30)]
    toxic = [(800 + i, prose(900 + i, 60) + " you idiot " + prose(i, 10) + " pathetic clown", "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(good + bad + toxic, SCHEMA)
    labels = spark.createDataFrame([(i, 0 if 500 <= i < 800 else 1, int(i >= 800)) for i, *_ in good + bad + toxic if i % 4], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark, edges, empty, clashing):
    docs, labels = labelled(spark)
    kept = {r.doc_id: r.kept for r in quality.resample(docs, labels).collect()}
    assert sum(kept[i] for i in range(500, 530)) <= 12 and sum(kept[i] for i in range(120)) >= 118
    assert quality.resample(docs, labels, k=50).where("kept").count() == 50
    assert quality.resample(docs, labels, share=0.5).where("kept").count() == 105
    assert quality.resample(docs, labels, k=0).where("kept").count() == 0
    none = labels.limit(0)
    assert quality.resample(docs, none).where("kept").count() == docs.count()
    assert quality.resample(empty, labels).count() == 0
    assert quality.resample(edges, labels).count() == edges.count()
    assert quality.reject_documents(clashing, none).columns == clashing.columns
    key = lambda r: (r.doc_id, r.log_weight, r.sample_key, r.kept)
    assert sorted(map(key, quality.scores(docs, labels).collect())) == sorted(map(key, quality.resample(docs, labels).collect()))
    again = docs.unionByName(docs.where("doc_id in (1, 500)"))  # repeated rows tie
    rows = quality.scores(again, labels).where("doc_id in (1, 500)").collect()
    assert len(rows) == 4 and len({(r.doc_id, r.sample_key, r.kept) for r in rows}) == 2


def test_contradicting_labels_are_not_good(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert {r.doc_id: r._good for r in quality.verdicts(rows).collect()} == {1: False, 2: True, 3: False}


def test_quality_is_brute_force(spark):
    """Counts, log ratios, weights, Gumbel keys, the share and the choice, recomputed in plain loops."""
    import pyarrow as pa

    docs, labels = labelled(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    verdict = {r.doc_id: r.quality for r in labels.collect()}

    def grams(text):
        words = re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]+", text)
        found = [int(quality.ngram_buckets(pa.array([w]))[0][0]) for w in words]
        return found + [int(quality.ngram_buckets(pa.array([f"{a} {b}"]))[0][2]) for a, b in zip(words, words[1:], strict=False)]

    of = {i: grams(t) for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, found in of.items():
        raw.update(found)
        if verdict.get(i) == 1:
            target.update(found)
    n = quality.BUCKETS
    ratio = lambda g: math.log((target[g] + 1) / (target.total() + n)) - math.log((raw[g] + 1) / (raw.total() + n))
    weight = {i: sum(map(ratio, found)) for i, found in of.items()}
    noise = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    key = {i: weight[i] + float(quality.gumbel(np.array([noise[i]]))[0]) for i in texts}
    good, of_labelled = sum(verdict[i] for i in texts if i in verdict), sum(i in verdict for i in texts)
    p, m, z = good / of_labelled, of_labelled, quality.Z
    upper = (p + z * z / (2 * m) + z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    kept = sorted(key, key=key.get, reverse=True)[: math.ceil(upper * len(key))]
    rows = quality.scores(docs, labels).collect()
    assert all(abs(r.log_weight - weight[r.doc_id]) < 1e-6 for r in rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: -r.sample_key)] == sorted(key, key=key.get, reverse=True)
    assert {r.doc_id for r in rows if r.kept} == set(kept)


def test_gumbel_noise_decides_between_like_weights():
    draws = quality.gumbel(np.arange(200_000) * 7919)
    assert abs(draws.mean() - 0.5772) < 0.02 and abs(draws.std() - math.pi / math.sqrt(6)) < 0.02
    # two groups with weights log 3 and 0: the larger keys hold them three to one at first
    keys = np.concatenate([draws[:100_000] + math.log(3), draws[100_000:]])
    first = np.argsort(-keys)[:2000] < 100_000
    assert abs(first.mean() - 0.75) < 0.04


def test_kth_largest(spark):
    r = random.Random(1)
    values = [r.randrange(-(2**63), 2**63) for _ in range(300)] + [5] * 20 + [-1, 0, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "sample_key long")
    for k in (1, 2, 150, 170, len(values)):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_toxicity(spark, edges, empty, clashing):
    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [r for r in rows.values() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id >= 800) for r in held]) > 0.95
    # labels of the held-out fold change nothing
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, other).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in rows.items())
    assert toxicity.toxicity(edges, labels).count() == edges.count() and toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(clashing, labels.limit(0)).collect()[0].score == 0


def brute_features(text, words, beginnings):
    """The dense features in plain Python, for ASCII texts."""
    strip = lambda x, keep="": "".join(c for c in x if c.isalnum() or c in keep)
    leet_of = str.maketrans("0134578@$", "oieastbas")
    plain = [w for w in (strip(x) for x in text.split()) if w]
    leet = [w for w in (strip(x, "@$").lower().translate(leet_of) for x in text.split()) if w]
    low = [w.lower() for w in plain]
    fixed, learned = [w in toxicity.INSULTS for w in low], [w in words for w in low]
    begins = [any(len(w) > len(b) and w.startswith(b) for b in beginnings) for w in low]
    hit = [i for i in range(len(low)) if fixed[i] or learned[i] or begins[i]]
    second = [w in toxicity.SECOND for w in low]
    near = [any(second[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i in hit]
    n, size = max(len(low), 1), max(len(text), 1)
    letters = max(sum(c.isalpha() for c in text), 1)
    return [
        sum(fixed) / n, sum(learned) / n, sum(begins) / n,
        max(sum(w in toxicity.INSULTS or w in words for w in leet) - sum(a or b for a, b in zip(fixed, learned, strict=True)), 0),
        len({low[i] for i in hit}), sum(near) / n, len(hit), sum(second) / n, sum(c.isupper() for c in text) / letters,
        sum(w.isupper() and w.isalpha() and len(w) > 1 for w in plain) / n, text.count("!") / size,
        sum(33 <= ord(c) < 128 and not c.isalnum() for c in text) / size,
        sum(any(c.isdigit() for c in w) and not w.isdigit() for w in plain) / n, math.log1p(len(low)),
        max([i / n for i in hit], default=0.0),
    ]


def test_toxicity_features_are_brute_force():
    import pyarrow as pa

    r = random.Random(5)
    some = ["You", "idiot!", "1d10t", "st@pid", "MORON", "nice", "day,", "y0u", "your", "A1", "2024", "WOW", "--", "vermintide", "glorptastic", "glorp", "hate?!", "u", "$cum", "..."]
    texts = [" ".join(r.choice(some) for _ in range(k)) for k in range(40)] + ["", " \n", "x" * 300]
    words, beginnings = ["nice", "wow"], ["vermi", "glorpta"]
    hashed = toxicity._hash_words(words)
    starts = []
    for b in beginnings:
        p = toxicity._parse(*toxicity.text_buffer(pa.array([b + "z"])), toxicity._PLAIN, toxicity._LOWER)
        starts.append(p.beginnings(len(b))[0])
    got = toxicity.features(pa.array(texts), hashed, np.sort(np.concatenate(starts)))
    assert got.shape[1] == len(toxicity.FEATURES)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, brute_features(text, words, beginnings)), text


def test_boosted_trees_are_brute_force():
    """The first tree's splits against an exhaustive search, and the margins against a walk down every tree."""
    from talkloom.llm import boosting

    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, size=(300, 4)).astype(float)
    y = ((x[:, 1] > 2) ^ (x[:, 3] > 3)).astype(float)
    model = boosting.fit(x, y, rounds=12, depth=2)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 2.0)
    bins = model.binned(x)
    best, split = 0.0, None
    for j in range(4):
        for k in range(len(model.edges[j])):
            left = bins[:, j] <= k
            if min(left.sum(), (~left).sum()) >= 8 and gain(left) + gain(~left) - gain(np.ones(len(y), bool)) > best + 1e-12:
                best, split = gain(left) + gain(~left) - gain(np.ones(len(y), bool)), (j, k)
    feature, cut, _ = model.trees[0]
    assert (feature[0], cut[0]) == split
    for row, margin in zip(x[:50], model.margin(x[:50]), strict=True):
        total = model.base
        for feature, cut, value in model.trees:
            node = 0
            for _ in range(2):
                above = sum(row[feature[node]] >= e for e in model.edges[feature[node]]) > cut[node]
                node = 2 * node + 1 + above
            total += value[node - 3]
        assert abs(total - margin) < 1e-9
    assert ((model.margin(x) > 0) == (y > 0)).mean() > 0.9


def test_isotonic_is_monotone():
    from talkloom.llm.boosting import isotonic

    x = np.random.default_rng(1).normal(size=400)
    at, value = isotonic(x, (x + np.random.default_rng(2).normal(size=400) > 0).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "near_dedup", "best_fit_packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf_dir).collect(), docs.schema)
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        if name == "near_dedup":
            texts = [(r.doc_id, r.text) for r in before.collect()]
            want = brute_components(texts, 5, 80)
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, _, kept) in want.items() if kept)
        if name == "line_dedup":
            assert after.where(F.length("text") != F.col("n_chars")).count() == before.where(F.length("text") != F.col("n_chars")).count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}
    per = defaultdict(int)
    for r in packed:
        per[r.sequence_id] += r.length
    assert max(per.values()) <= 2048
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
