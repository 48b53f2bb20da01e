"""Operators against brute force over random texts, on long and repetitive ones, and with columns whose names clash."""

import random
import re
import time
import zlib
from collections import Counter
from math import log

import pytest

from panelforge.llm import chosen_path, decontaminate, fuzzy_lines, graph, langid, license_scan, quality_model, quality_rules

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def sentence(rng, n):
    return " ".join(letters(rng, rng.randint(2, 9)) for _ in range(n))


def test_license_places_match_brute_force(spark):
    rng = random.Random(31)
    pool = ["MIT", "License", "apache", "general", "public", "license,", "(license)", "und\u00e9", "x-license", "GENERAL"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan_licenses(docs).collect():
        low = (texts[r["doc_id"]] or "").translate({k: k + 32 for k in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        expect = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == expect


def test_license_scan_is_linear():
    machine = license_scan.automaton(license_scan.BASE_PHRASES)
    began = time.perf_counter()
    row = license_scan.scan_text("mit license " * 900_000, machine)
    assert row[:4] == (1_800_000, 900_000, 0, 1_799_998) and time.perf_counter() - began < 20


def test_prose_after_an_identifier_is_no_expression():
    labels = lambda x: sorted(license_scan.evaluate(license_scan.parse_expression(x)).labels)
    assert labels("MIT and more text") == ["mit"]
    assert labels("mit or apache-2.0") == ["apache-2.0", "mit"]
    assert labels("GPL-2.0-only WITH Classpath-exception-2.0") == ["gpl-2.0-only"]
    assert labels("MIT OR Apache-2.0 and other things") == ["apache-2.0", "mit"]


def test_leaks_match_brute_force(spark):
    rng = random.Random(33)
    items = [(k, sentence(rng, 25)) for k in range(12)]
    docs = []
    for k in range(60):
        item = items[k % 12][1]
        a = rng.randrange(0, len(item) - 60)
        part = list(item[a : a + rng.choice([20, 30, 59, 80])])
        for _ in range(rng.choice([0, 0, 3])):
            part[rng.randrange(len(part))] = rng.choice("abc")
        docs.append((k, f"{sentence(rng, 15)} {''.join(part)} {sentence(rng, 15)}"))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(*frames).collect()}
    index = decontaminate.Index(items)

    def least(wanted, text):  # fewest edits that turn a part of the text into the segment
        row = [0] * (len(text) + 1)
        for i, x in enumerate(wanted, 1):
            left = [i]
            for j, y in enumerate(text, 1):
                left.append(min(row[j - 1] + (x != y), row[j] + 1, left[-1] + 1))
            row = left
        return min(row)

    expect = set()
    for doc, text in docs:
        normal = "".join(map(chr, decontaminate.normal([text])[0]))
        for s, item in enumerate(index.items):
            if item == doc % 12:
                wanted = "".join(map(chr, index.codes[index.begin[s] : index.begin[s] + index.size[s]]))
                if least(wanted, normal) <= index.edits[s]:
                    expect.add((doc, item))
                    break
    assert found == expect and len(expect) > 20


def test_shared_prompts_and_repeated_words_stay_cheap():
    rng = random.Random(34)
    prompt = sentence(rng, 22)[:130]
    index = decontaminate.Index([(k, f"{prompt} {sentence(rng, 30)}") for k in range(1000)])
    began = time.perf_counter()
    list(index.scan([f"{sentence(rng, 20)} {prompt} {sentence(rng, 20)}"]))
    assert time.perf_counter() - began < 6
    index = decontaminate.Index([(1, "again " * 40), (2, sentence(rng, 40))])
    seconds = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert {index.items[x[1]] for x in index.scan(["again " * n])} == {1}
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 40


def test_language_scores_match_brute_force(spark):
    rng = random.Random(35)
    alphabets = {"aa": "abcde ", "bb": "cdefg "}
    rows = [(k, "".join(rng.choice(alphabets[x]) for _ in range(rng.randint(3, 60))), x) for k in range(80) for x in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    count = {x: Counter() for x in alphabets}
    for _, text, lang in rows:
        for _, bucket, _ in langid.grams([text]):
            count[lang].update(bucket.tolist())
    total = {x: sum(c.values()) + langid.BUCKETS for x, c in count.items()}
    for r in langid.identify(docs, model).collect():
        best = {}
        for x in alphabets:
            best[x] = sum(log((count[x][b] + 1) / total[x]) for _, bucket, _ in langid.grams([rows[r["doc_id"]][1]]) for b in bucket.tolist())
        if abs(best["aa"] - best["bb"]) > 0.01 and r["lang_pred"] != "und":
            assert r["lang_pred"] == max(best, key=best.get)


def test_every_label_is_learned_once(spark):
    rows = [(k, "good words here" if k % 2 else "bad") for k in range(40)] + [(3, "another text"), (None, "x")]
    labels = [(k, k % 2) for k in range(40)] + [(4, None), (5, 7), (None, 1), (6, 0)]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality_model.classify(docs, quality_model.train(docs, marked)).collect()}
    assert all(got[k] == k % 2 for k in range(40) if k != 3)
    weights = quality_model.train(docs, marked)
    score = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, weights).where("doc_id <> 3").collect()}
    from math import exp

    def brute(text):  # a feature's value is its share of its kind
        out = float(weights[-1])
        for _, _, hashed, _, value in quality_model.features(__import__("pyarrow").array([text])):
            out += sum(float(weights[h]) * float(v) for h, v in zip(hashed, value, strict=True))
        return 1 / (1 + exp(-out))

    assert all(abs(score[k] - brute(t)) < 1e-6 for k, t in rows if k not in (3, None))


def test_rule_order_does_not_change_verdicts(spark):
    rng = random.Random(36)
    docs = spark.createDataFrame([(k, "\n".join(sentence(rng, rng.randint(1, 30)) + rng.choice(["", "...", " # # #"]) for _ in range(rng.randint(1, 6)))) for k in range(80)], "doc_id long, text string")
    one = sorted(map(tuple, quality_rules.quality_cascade(docs).collect()))
    other = sorted(map(tuple, quality_rules.quality_cascade(docs, rules=quality_rules.RULES[::-1]).collect()))
    assert one == other and {r[-1] for r in one} == {True, False}
    order = quality_rules.order_rules(docs)
    assert {r.name for r, _, _ in order} == {r.name for r in quality_rules.RULES} and all(0 <= share <= 1 and cost > 0 for _, share, cost in order)


CLASH = "doc_id long, text string, row long, drop long, id long, code long, part long, block long, path long, key long, `__dropped` long, `__leaked` long, `__id` long, n_words long, words long, `a.b` long, x long, y long"


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(37)
    text = "\n".join(sentence(rng, 20) for _ in range(5))
    rows = [(1, text), (2, text), (3, sentence(rng, 60)), (4, None), (5, ""), (None, sentence(rng, 30)), (3, sentence(rng, 60))]
    return spark.createDataFrame([(d, t, *range(16)) for d, t in rows], CLASH)


def test_columns_with_clashing_names_pass_through(spark, clashing):
    first = tuple(range(16))
    keep = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect() if tuple(r)[2:18] == first)
    assert len(keep(chosen_path.drop_near_duplicates(clashing))) == 6
    lines = fuzzy_lines.dedup_lines(clashing)
    assert lines.columns[:18] == clashing.columns and len(keep(lines)) == 7
    assert {r["doc_id"]: r["n_dropped"] for r in lines.collect() if r["doc_id"] in (1, 2)} == {1: 0, 2: 5}
    items = spark.createDataFrame([(1, clashing.first()["text"])], "item_id long, text string")
    assert keep(decontaminate.decontaminate(clashing, items)) == [(False, 3), (False, 3), (False, 4), (False, 5), (True, 0)]
    weights = quality_model.train(clashing, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert quality_model.keep_accepted(clashing, weights).columns == clashing.columns


def test_crc_fold_is_the_crc_of_the_id_as_text(spark):
    from panelforge.llm import common

    rows = spark.createDataFrame([(k,) for k in (0, 7, 123456789)], "doc_id long").select("doc_id", common.crc_fold("doc_id", 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows)


def test_a_crowd_of_near_copies_matches_brute_force(spark):
    """Two crowds around the threshold, each larger than a node of the trees, and a passage that unlike texts share."""
    rng = random.Random(41)
    rows, passage = [], sentence(rng, 60)
    for crowd in range(2):
        base = sentence(rng, 120).split()
        for k in range(170):
            copy = list(base)
            for at in rng.sample(range(120), rng.choice([2, 3, 4, 5])):
                copy[at] = letters(rng, 8)
            rows.append((crowd * 1000 + k, " ".join(copy)))
    rows += [(5000 + k, f"{passage} {sentence(rng, rng.randint(4, 40))}") for k in range(150)]
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                links += 1
                part[find(i)] = find(j)
    expect = {}
    for i, (doc, _) in enumerate(rows):
        expect.setdefault(find(i), []).append(doc)
    smallest = {d: min(group) for group in expect.values() for d in group}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_duplicates(docs, 4).collect()}
    assert links > 200 and len(expect) > 100
    assert got == smallest


def test_components_of_few_links_match_and_need_no_exchange(spark, monkeypatch):
    rng = random.Random(38)
    links = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    frame, stages = spark.createDataFrame(links, "a long, b long").repartition(3), []
    for few in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", few)
        spark.sparkContext.setJobGroup(f"links {few}", "")
        found = {tuple(r) for r in graph.components(frame).collect()}
        assert found == {(x, r) for x, r in root.items() if x != r}
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(x) for x in tracker.getJobIdsForGroup(f"links {few}")]
        stages.append(sum(len(x.stageIds) for x in jobs if x))
    spark.sparkContext._jsc.clearJobGroup()
    assert stages[0] * 2 < stages[1]


def test_a_shared_passage_makes_no_deep_trees(spark, monkeypatch):
    rng = random.Random(39)
    passage = sentence(rng, 60)
    docs = spark.createDataFrame([(k, f"{passage} {sentence(rng, 60)}") for k in range(200)], "doc_id long, text string")
    made, branch = [], chosen_path._branch
    monkeypatch.setattr(chosen_path, "_branch", lambda rows, trees=None: made.append(trees) or branch(rows, trees))
    assert {r["component_id"] for r in chosen_path.near_duplicates(docs, 4).collect()} == set(range(200))
    assert made.count(None) == 0


def test_a_crowd_beyond_a_node_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "NODE", 100)
    test_a_crowd_of_near_copies_matches_brute_force(spark)
