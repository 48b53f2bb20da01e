"""The operators on small fixtures: brute force, round trips and odd inputs."""

import random
import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import chosen_path, decontaminate, fuzzy_lines, graph, langid, license_scan, packing, quality_model, quality_rules, token_store, tokens, warc_fixity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key int, n int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, short, empty and null texts, a repeated row, a null id, and columns with clashing names."""
    rng = random.Random(3)
    base = words(rng, 120)
    parts = base.split()
    rows = [(1, base), (2, base), (3, " ".join(parts[:118])), (4, " ".join(parts[10:])), (5, words(rng, 80)), (6, ""), (7, None), (8, "one two"), (9, "One\ttwo"), (9, "One\ttwo"), (None, words(rng, 30)), (10, "café 한국 ​x\x0by " * 40)]
    rows += [(20 + k, words(rng, 60)) for k in range(20)]
    return spark.createDataFrame([(d, t, "en", "s", 0, 1, 2) for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates_match_brute_force(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]

    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                part[find(i)] = find(j)
    expect = []
    for i, (doc, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        component = None if doc is None else min(same)
        expect.append((doc, len(sets[i]), component, doc is None or component == doc))
    got = [tuple(r) for r in chosen_path.near_duplicates(corpus, 4).collect()]
    assert sorted(got, key=str) == sorted(expect, key=str)


def test_empty_tables(spark, nothing):
    assert chosen_path.near_duplicates(nothing).count() == 0
    assert fuzzy_lines.dedup_lines(nothing).count() == 0
    assert license_scan.scan_licenses(nothing).count() == 0
    assert quality_rules.quality_cascade(nothing).count() == 0
    assert token_store.token_id_store(nothing, tokens.public_path("word_bpe_49k.json")).count() == 0
    assert packing.pack_sequences(nothing, tokens.public_path("byte_bpe_50k.json")).count() == 0
    model = langid.train(nothing)
    assert model.langs == [] and langid.identify(nothing, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.classify(nothing, quality_model.train(nothing, labels)).count() == 0
    assert decontaminate.find_leaks(nothing, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_lines(spark):
    rng = random.Random(5)
    line = words(rng, 12)
    changed = line.split()
    changed[3] = "another"
    docs = spark.createDataFrame([(1, f"{line}\nfirst only here", 7), (2, f"- {line.upper()}!\nsecond", 7), (3, " ".join(changed), 7), (4, f"{words(rng, 12)}\n\n***", 7), (5, None, 7), (6, "", 7)], "doc_id long, text string, row int")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert got[1] == (f"{line}\nfirst only here", 2, 0)
    assert got[2] == ("second", 2, 1)
    assert got[3][1] == 1  # within the edit distance; found if a block agrees
    assert got[4][2] == 0 and got[5] == (None, 0, 0) and got[6] == ("", 0, 0)


def test_blocks_hold_each_line_once(spark):
    line, other = "one two three one two three four five six seven eight", "nil one two three one two three four five six nine"
    docs = spark.createDataFrame([(k, line) for k in range(5)] + [(9, other)], "doc_id long, text string")
    rows = fuzzy_lines._members(fuzzy_lines.distinct_lines(fuzzy_lines.occurrences(docs))).collect()
    assert len({(r["block"], r["id"]) for r in rows}) == len(rows) > 8
    assert all(r["members"] == 2 for r in rows) and {r["n"] for r in rows} == {1, 5}


def test_sketches_are_the_parity_of_units(spark):
    rng = random.Random(8)
    line = words(rng, 30)
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    hashes = spark.createDataFrame([(w,) for w in line.split()], "w string").selectExpr("xxhash64(w) AS h", "octet_length(w) >= 5 AS long").collect()
    bits = [0] * 64
    for r in hashes:
        h = (r["h"] | 1) if r["long"] else (r["h"] & -2)
        bits[(h >> 1) & 63] ^= 1
    assert fuzzy_lines.occurrences(docs).first()["sketch"] & (2**64 - 1) == sum(b << k for k, b in enumerate(bits))


def test_short_lines_that_share_a_run_alone_are_no_candidates(spark):
    rng = random.Random(31)
    rows, near = [], []
    for k, n in enumerate([8, 12, 20, 30, 40] * 6):
        line = words(rng, n).split()
        other = line[:3] + words(rng, n - 3).split()
        near.append(k % 2)
        if k % 2:  # at the limit: units replaced, inserted or left out
            other = list(line)
            for at in sorted(rng.sample(range(n), n // 5), reverse=True):
                other[at : at + rng.randrange(2)] = words(rng, rng.randrange(2)).split()
        rows += [(k, " ".join(line)), (-k - 1, " ".join(other))]
    found = fuzzy_lines.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).drop("blocks")
    both = found.alias("x").join(found.alias("y"), F.expr("y.doc_id = -x.doc_id - 1 AND x.doc_id >= 0"))
    got = both.select(F.col("x.doc_id").alias("k"), F.greatest("x.size", "y.size").alias("n"), fuzzy_lines._close("x", "y").alias("close")).collect()
    assert len(got) == 30 and all(r["close"] == bool(near[r["k"]]) for r in got)


def test_lines_that_share_a_run_by_chance_leave_the_first_shuffle_alone(spark):
    """What a shuffle of blocks brings together but can't be linked isn't written, and goes through no other shuffle."""
    rng = random.Random(33)
    rows = []
    for k in range(0, 60, 2):
        line = words(rng, 30)
        rows += [(k, line), (k + 1, " ".join(line.split()[:6] + words(rng, 24).split()))]
    near = words(rng, 30)
    docs = spark.createDataFrame([*rows, (100, near), (101, near.replace(near.split()[4], "other"))], "doc_id long, text string")
    members = fuzzy_lines._members(fuzzy_lines.distinct_lines(fuzzy_lines.occurrences(docs)))
    assert members.select("id").distinct().count() > 10
    left = fuzzy_lines._candidates(members)
    assert left.where("size(near) <> 1").count() == 0 and left.select("id").distinct().count() == 1
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == plan.count("Exchange") - 1 == 1


def test_lines_and_blocks_are_shuffled_in_parts(spark):
    """Each part holds a share of the blocks, all parts together every block once; of the lines' parts likewise."""
    rng = random.Random(34)
    docs = spark.createDataFrame([(k, f"{line}\n{words(rng, 7)}\n{line}") for k in range(60) for line in [words(rng, 12)] * 2], "doc_id long, text string")
    whole = fuzzy_lines.distinct_lines(fuzzy_lines.occurrences(docs))
    places, parts = fuzzy_lines._named(fuzzy_lines.occurrences(docs))
    assert places.count() == 360 and len(parts) == fuzzy_lines.PASSES > 1
    assert sorted(r["id"] for part in parts for r in part.collect()) == sorted(r["id"] for r in whole.collect())
    assert max(part.count() for part in parts) < whole.count() / 2
    text = words(rng, 60).split()
    docs = spark.createDataFrame([(k, " ".join([*text[:k], "other", *text[k:]])) for k in range(60)], "doc_id long, text string")
    whole = fuzzy_lines.distinct_lines(fuzzy_lines.occurrences(docs))
    keys = [[(r["block"], r["id"]) for r in fuzzy_lines._members(whole, k).collect()] for k in range(fuzzy_lines.PASSES)]
    every = [(r["block"], r["id"]) for r in fuzzy_lines._members(whole).collect()]
    assert sorted(x for part in keys for x in part) == sorted(every) and len(every) > 100
    assert max(len({b for b, _ in part}) for part in keys) < len({b for b, _ in every})


def test_crowded_blocks_are_not_cut_into_tasks_for_pairs_of_pieces(spark, monkeypatch):
    """A skewed join would be: both sides of the comparison are dealt out before it, which such a join leaves alone."""
    rng, plans, write = random.Random(35), {}, fuzzy_lines.common.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(fuzzy_lines.common, "written", seen)
    rows = [(k, f"some common phrase {words(rng, 15)}") for k in range(fuzzy_lines.SMALL + 20)]
    fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).count()
    dealt = [x for x in plans["left"].splitlines() if "hashpartitioning(block" in x and "chunk" in x]
    assert len(dealt) == 2 and all("REPARTITION_BY_COL" in x for x in dealt)


def test_counts_of_units_rule_out_no_link(spark):
    rng, rows = random.Random(8), []
    for n in (5, 10, 40, 200):
        for _ in range(20):
            x = [chr(0x10000 + rng.randrange(1 << 20)) for _ in range(n)]
            y = list(x)
            for _ in range(n * fuzzy_lines.EDIT_PERCENT // 100):
                at, how = rng.randrange(len(y)), rng.randrange(3)
                y[at : at + (how < 2)] = [chr(0x10000 + rng.randrange(1 << 20))] * (how != 1)
            rows.append(("".join(x), "".join(y)))
    phrase = [[chr(0x10000 + rng.randrange(1 << 20)) for _ in range(8)] for _ in range(2)]
    both = spark.createDataFrame([*rows, tuple("".join(p) * 30 for p in phrase)], "a string, b string")
    side = lambda c: F.struct(F.length(c).alias("size"), F.col(c).alias("code"), fuzzy_lines._counts(F.col(c)).alias("counts"))
    sides = both.select(side("a").alias("x"), side("b").alias("y"))
    got = sides.select(fuzzy_lines._near("x", "y", "code").alias("near"), fuzzy_lines._balanced("x", "y").alias("left"), F.expr("array(x.counts.*)").alias("c"), "x.size").collect()
    assert all(r["left"] for r in got if r["near"]) and sum(r["near"] for r in got) >= 60
    assert all(sum(r["c"]) == r["size"] for r in got)
    assert not got[-1]["near"] and not got[-1]["left"]


def test_crowded_lines_are_compared_in_brief(spark, monkeypatch):
    """One byte a unit is dealt out for the comparison of crowded blocks, and no line goes through a shuffle as it is spelled."""
    rng, plans, write = random.Random(36), {}, fuzzy_lines.common.written

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(fuzzy_lines.common, "written", seen)
    rows = [(k, f"some common phrase {words(rng, 15)}") for k in range(fuzzy_lines.SMALL + 20)]
    last = rows[-1][1].split()
    rows.append((999, " ".join([*last[:9], "other", *last[10:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert {d for d, n in got.items() if n} == {999}
    assert len(plans["texts"]) == 1 and "Aggregate" not in plans["texts"][0]
    assert "brief" in plans["left"][0] and not re.search(r"\bcode2?#", plans["left"][0])


def test_lines_in_brief_are_near_if_they_are_as_spelled(spark):
    line = spark.createDataFrame([(words(random.Random(37), 60),)], "line string").select(fuzzy_lines._hashes(fuzzy_lines._units(F.col("line"))).alias("u"))
    u = F.col("u")
    r = line.select(fuzzy_lines._spelled(u, 1).alias("code"), fuzzy_lines._spelled(u, 27).alias("code2"), fuzzy_lines._brief(u).alias("brief")).first()
    assert r["brief"] == "".join(chr(ord(c) & 63 | 64) for c in r["code"]) and len(r["code"]) == len(r["code2"]) == 60
    assert len(set(r["code"])) == len(set(r["code2"])) > 55 and set(map(ord, r["code"])) != set(map(ord, r["code2"]))


def test_pairs_of_crowded_blocks_meet_their_lines_once(spark, monkeypatch):
    line, names, write = words(random.Random(39), 20), [], fuzzy_lines.common.written
    monkeypatch.setattr(fuzzy_lines, "_small", lambda rows: False)
    monkeypatch.setattr(fuzzy_lines.common, "written", lambda df, name: names.append(name) or write(df, name))
    u = fuzzy_lines._hashes(fuzzy_lines._units(F.col("line")))
    lines = spark.createDataFrame([(1, line), (2, f"{line} more"), (3, words(random.Random(40), 20))], "id long, line string").withColumn("u", u)
    texts = lines.select("id", fuzzy_lines._spelled(F.col("u"), 1).alias("code"), fuzzy_lines._spelled(F.col("u"), 27).alias("code2"))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = fuzzy_lines._verified(pairs, texts, once=True).collect()
    assert [tuple(r) for r in got] == [(1, 2)] and names == ["alike"]


def test_pairs_of_lines_in_one_group_are_not_all_verified(spark, monkeypatch):
    """Of near copies few pairs are verified, in small blocks as in crowded ones; links between groups are still found."""
    rng, seen, verified = random.Random(41), [], fuzzy_lines._verified
    monkeypatch.setattr(fuzzy_lines, "_verified", lambda pairs, *a, **b: seen.append(pairs.count()) or verified(pairs, *a, **b))
    line = words(rng, 30).split()
    chain = [[*(f"new{j}" for j in range(4 * k)), *line[4 * k :]] for k in range(4)]  # each within the distance of the next alone
    rows = [(k, " ".join([*line[:5], f"other{k}", *line[6:]])) for k in range(40)] + [(100 + k, " ".join(x)) for k, x in enumerate(chain)]
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["n_dropped"] == 0} == {0}
    assert 43 <= sum(seen) < 250  # of 946 pairs


def test_links_of_pairs_make_the_groups_of_all_verified_pairs(spark):
    rng, u = random.Random(42), fuzzy_lines._hashes(fuzzy_lines._units(F.col("line")))
    line = words(rng, 20).split()
    rows = [(k, " ".join([*line[:k], f"x{k}", *line[k + 1 :]])) for k in range(12)] + [(20 + k, words(rng, 20)) for k in range(3)]
    rows.append((30, " ".join([*rows[11][1].split()[:15], *words(rng, 4).split(), line[19]])))  # linked with line 11 alone, not with the smallest
    lines = spark.createDataFrame(rows, "id long, line string").withColumn("u", u)
    texts = lines.select("id", fuzzy_lines._spelled(F.col("u"), 1).alias("code"), fuzzy_lines._spelled(F.col("u"), 27).alias("code2"))
    ids = [k for k, _ in rows]
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a long, b long")
    groups = lambda frames: sorted(tuple(r) for r in graph.components(reduce(DataFrame.unionByName, frames)).collect())
    expect = groups([fuzzy_lines._verified(pairs, texts)])
    assert groups(fuzzy_lines._links(pairs, texts)) == groups(fuzzy_lines._links(pairs, texts, once=True)) == expect and len(expect) >= 11


def test_texts_of_other_lines_stay_out_of_the_shuffle_of_pairs(spark, monkeypatch):
    plans, write, u = [], fuzzy_lines.common.written, fuzzy_lines._hashes(fuzzy_lines._units(F.col("line")))
    monkeypatch.setattr(fuzzy_lines, "_small", lambda rows: False)
    monkeypatch.setattr(fuzzy_lines.common, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    line = words(random.Random(43), 20)
    lines = spark.createDataFrame([(1, line), (2, f"{line} more"), (3, line)], "id long, line string").withColumn("u", u)
    texts = lines.select("id", fuzzy_lines._spelled(F.col("u"), 1).alias("code"), fuzzy_lines._spelled(F.col("u"), 27).alias("code2"))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in fuzzy_lines._verified(pairs, texts).collect()] == [(1, 2)]
    assert all(plan.count("LeftSemi, BuildRight") == 2 for plan in plans) and len(plans) == 2
    monkeypatch.setattr(fuzzy_lines, "BROADCAST_BYTES", 0)
    assert [tuple(r) for r in fuzzy_lines._verified(pairs, texts).collect()] == [(1, 2)]
    assert not any("LeftSemi" in plan for plan in plans[2:]) and len(plans) == 4


def test_a_repeated_row_s_lines_are_read_once(spark):
    line = words(random.Random(38), 20)
    docs = spark.createDataFrame([(1, line)] * 3 + [(2, f"{line} more")], "doc_id long, text string")
    lines = fuzzy_lines.distinct_lines(fuzzy_lines.occurrences(docs))
    assert fuzzy_lines._texts(lines.select("id"), lines, docs).count() == 2


def test_pieces_of_a_text_have_the_library_s_ids_and_are_few():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    bits = ["word", "Word", "\u00c9", "\u00d7", "\u00f7", "\u4e2d", ",", "...", "'s", "\n", " ", "  ", "7", "\t", "\r\n", "-", "\u201c", "<|endoftext|>", "\u00a0", "na\u00efve", "\U0001f600", "\x7f", "\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(5000)] + ["", " ", "\n"]
    e, plain = tokens.ChunkEncoder(tokens.public_path("byte_bpe_50k.json")), Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    flat, bounds = e.encode(pa.array(["cut off", *texts, None]).slice(1))
    for k, x in enumerate(plain.encode_batch_fast([*texts, ""], add_special_tokens=False)):
        assert flat[bounds[k] : bounds[k + 1]].tolist() == x.ids, [*texts, ""][k]
    e = tokens.ChunkEncoder(tokens.public_path("byte_bpe_50k.json"))
    e.encode(pa.array([f" ({x}{y} {x}{z}" for x in ("one", "two", "three") for y in ",;:" for z in "!?."]))
    assert len(e.cache) == 13  # three words with and without blank, a bracket, six marks


def test_leaks(spark):
    rng = random.Random(11)
    items = [(k, words(rng, 40)) for k in range(5)] + [(9, ""), (8, None), (7, "short")]
    edited = list(items[1][1])
    for p in range(10, len(edited), 40):
        edited[p] = "z"
    clean = words(rng, 200)
    docs = [(1, f"{clean} {items[0][1].upper()} tail"), (2, "x " + "".join(edited)), (3, clean), (4, None), (5, ""), (None, items[2][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    leaks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert leaks == {(1, 0), (2, 1), (None, 2)}
    left = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "5", "None"]


def test_align_matches_full_table():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
        r = [rng.randrange(3) for _ in range(rng.randint(1, 16))]
        table = [[0] * (len(r) + 1)]
        for i, x in enumerate(s, 1):
            table.append([i])
            for j, y in enumerate(r, 1):
                table[i].append(min(table[i - 1][j - 1] + (x != y), table[i - 1][j] + 1, table[i][j - 1] + 1))
        best, budget = min(table[-1]), rng.randint(0, 4)
        found = decontaminate.align(np.array(s, np.uint32), np.array(r, np.uint32), budget)
        if best <= budget and len(r) >= len(s) - budget:
            assert found is not None and found[0] == best
        else:
            assert found is None


def test_token_store_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    rows = token_store.token_id_store(corpus, tokens.public_path("word_bpe_49k.json")).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in corpus.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    at, expect = 0, []
    for doc, text in texts:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        expect.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expect


def test_variable_length_coding():
    values = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        assert (token_store.decompress(*token_store.compress(values[:n]), n) == values[:n]).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_are_exact(name):
    odd = ["", " ", "  a  b ", "a\n\n b", "a\nb c.\n", "77 7 a7b 7", "it's we'll", "ΣΑΣ ΟΔΟΣ.", "a\tb \t c", "<|endoftext|> x", "İstanbul 한국", "a\x1cb", "x\0y", "x\x85y", None]
    from tokenizers import Tokenizer

    odd += ["a <|endoftext|> b <|startoftext|>", "x<|endoftext|>", "<|ENDOFTEXT|> y"]
    fresh = Tokenizer.from_file(tokens.public_path(name))
    e = tokens.encoder(tokens.public_path(name))
    ids, bounds = e.encode(pa.array(odd))
    for x, a, b in zip(odd, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == fresh.encode(x or "", add_special_tokens=False).ids

@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_of_letters_and_marks_share_pieces(name):
    from tokenizers import Tokenizer

    e, plain = tokens.ChunkEncoder(tokens.public_path(name)), Tokenizer.from_file(tokens.public_path(name))
    given: list[str] = []
    e._learn_whole = lambda keys, whole=e._learn_whole: (given.extend(keys), whole(keys))[1]
    signs = ["a", "ll", "Zo", "É", "ñß", "Ÿ", "ſ", "İ", "Σ", "́", "ª", "µ", "7", "'", "'s", "'", ".", "...", "--", "’", "×", "\n", "\n\n", "\t", " ", " ", " ", " '", "日本", "😀", " ", "|>"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["\n", "\nword", "word\n", "a\n\nb", "it's", "(word)", "WORD,***", "Ünder.\nÉtat,\nend.", "", "O'Neill's\nx"]
    for k in range(0, len(texts), 500):
        flat, at = e.encode(pa.array(texts[k : k + 500]))
        for text, lo, hi in zip(texts[k : k + 500], at[:-1], at[1:], strict=True):
            assert flat[lo:hi].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    given.clear()
    e.encode(pa.array(["x blivet Blivet, blivet. (blivet)!! blivet\nblivet-blivet Größe, größe."]))
    assert not [x for x in given if "bl" in x.lower() or "gr" in x.lower()]


def test_word_chunks_are_cut_before_the_look_up():
    from tokenizers import Tokenizer

    path = tokens.public_path("word_bpe_49k.json")
    e, plain = tokens.ChunkEncoder(path), Tokenizer.from_file(path)
    texts = [" Blivet,\tblivet.\x0b\r\n(BLIVET)  ", "", " \n", "GRÖSSE Größe, b×X it's ÞÀ", None, "blivet"]
    whole = pa.array(["cut off", *texts, "cut off"])
    flat, at = e.encode(whole.slice(1, len(texts)))
    assert [flat[lo:hi].tolist() for lo, hi in zip(at[:-1], at[1:], strict=True)] == [plain.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert set(e.cache) == {"blivet", ",", ".", "(", ")", "grösse", "größe", "b×X", "it's", "þà"}


def test_packing_covers_every_id_once(spark, corpus):
    path = tokens.public_path("byte_bpe_50k.json")
    e = tokens.encoder(path)
    pieces = packing.pack_sequences(corpus, path, length=64).toPandas()
    by_doc = {}
    for r in pieces.itertuples():
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for r in corpus.where("doc_id IS NOT NULL AND doc_id <> 9").collect():
        want = [*e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        got = b"".join(x for _, x in sorted(by_doc[r["doc_id"], len(want)]))
        assert np.frombuffer(got, e.dtype).tolist() == want
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].to_numpy() == np.concatenate([[0], s["length"].cumsum()[:-1]])).all()
        total = int(s["length"].sum())
        assert total <= 64 and total & (total - 1) == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_language(spark):
    rng = random.Random(1)
    rows = [(k, words(rng, 30).replace("a", "x") if k % 2 else words(rng, 30).upper(), "xx" if k % 2 else "uu") for k in range(60)] + [(99, None, "xx"), (98, "123 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs.where("doc_id < 40"))).collect()}
    assert all(got[k]["lang_pred"] == ("xx" if k % 2 else "uu") for k in range(40, 60))
    assert got[99]["lang_pred"] == got[98]["lang_pred"] == "und" and got[99]["score"] == 0


def test_quality_model(spark):
    rng = random.Random(4)
    rows = [(k, words(rng, 40) if k % 2 else " ".join([words(rng, 1)] * 40)) for k in range(200)] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(101, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality_model.classify(docs, quality_model.train(docs, labels)).collect()}
    assert sum(got[k] == k % 2 for k in range(100, 200)) >= 98 and got[500] in (0, 1)


def test_rules_match_brute_force(spark, corpus):
    got = {r["doc_id"]: r for r in quality_rules.quality_cascade(corpus).collect()}
    for r in corpus.where("doc_id IS NOT NULL").collect():
        t = r["text"] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hot = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
        row = got[r["doc_id"]]
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hot))


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "Under the MIT-License, or\nApache License; mit license"), (2, "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND Apache-2.0\ncode"), (3, "SPDX-License-Identifier: AND MIT"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 2, 7, "apache,mit")
    assert got[2]["permissive"] is True and "spdx:mit" in got[2]["labels"] and got[2]["base_labels"] == ""
    assert got[3]["n_bad_tags"] == 1 and got[3]["permissive"] is None
    assert got[4]["n_words"] == got[5]["n_words"] == 0 and got[4]["labels"] == ""
    assert license_scan.parse_expression("A OR B AND C WITH D") == ["A", "B", "C", "D", "with", "and", "or"]


def test_fixity(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "é" * (k % 50) if k % 7 else None) for k in range(300)] + [(None, None, "y"), (5, "http://x/5", "again")], "page_id long, url string, html string")
    copy = warc_fixity.archive(pages, segment_bytes=4000).cache()
    assert warc_fixity.audit(copy.drop("page_id"), copy).count() == 0
    broken = warc_fixity.with_damage(copy)
    found = warc_fixity.audit(copy, broken).join(copy, ["segment", "offset"]).collect()
    fold = lambda p: zlib.crc32(str(p).encode()) % 64
    expect = [(r["page_id"], {5: "altered", 6: "only_left"}[fold(r["page_id"])]) for r in copy.collect() if r["page_id"] is not None and fold(r["page_id"]) in (5, 6)]
    assert sorted((r["page_id"], r["damage"]) for r in found) == sorted(expect)
