"""Cases that a shortcut would miss: each holds an operator to all that it says it finds."""

import random

from panelforge.llm import decontaminate, fuzzy_lines, quality_model


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def edited(rng, line, n):
    """``n`` units, at random places, replaced."""
    out = list(line)
    for k in rng.sample(range(len(line)), n):
        out[k] = letters(rng, 9)
    return out


def kept_lines(spark, pairs):
    """Which of the pairs' second lines are left, each line in a document of its own."""
    rows = [(2 * k + j, " ".join(x)) for k, pair in enumerate(pairs) for j, x in enumerate(pair)]
    out = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"] // 2 for r in out if r["doc_id"] % 2 and r["n_dropped"] == 0}


def test_every_pair_within_the_word_distance_is_found(spark):
    rng = random.Random(21)
    pairs, expect = [], set()
    for n in (5, 6, 9, 10, 14, 20, 40, 200):
        for e in (1, n // 5, n // 5 + 1):
            line = [letters(rng, 8) for _ in range(n)]
            if e > n // 5:
                expect.add(len(pairs))
            pairs.append((line, edited(rng, line, e)))
    for n in (5, 10, 15):  # the longer line decides
        line = [letters(rng, 8) for _ in range(n)]
        pairs.append((line, [x for k, x in enumerate(line) if k % 5 != 2]))
    same = ["again"] * 30
    pairs.append((same, edited(rng, same, 6)))
    assert kept_lines(spark, pairs) == expect


def test_lines_whose_only_shared_block_is_crowded_are_linked(spark):
    rng = random.Random(24)
    more = fuzzy_lines.SMALL + 20
    forms = [[f"chapter page {letters(rng, 9)} of it".split() for _ in range(more)]]  # one edit of five units apart: one block shared by all
    phrase = [letters(rng, 8) for _ in range(3)]
    alone = [[letters(rng, 8) for _ in range(17)] for _ in range(more)]
    forms.append([phrase + x for x in alone])  # a phrase in lines that are otherwise unlike
    last = [phrase + edited(rng, alone[7], 4)]
    rows = [(k, " ".join(x)) for k, x in enumerate(forms[0] + forms[1] + last)]
    left = {r["doc_id"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_dropped"] == 0}
    assert left == {0} | set(range(more, 2 * more))


def test_short_words_scripts_without_blanks_and_very_long_lines(spark):
    rng = random.Random(22)
    short = [letters(rng, rng.randint(1, 4)) for _ in range(10)]
    han = [chr(0x4E00 + rng.randrange(20000)) for _ in range(30)]
    thai = [chr(0x0E01 + rng.randrange(46)) for _ in range(30)]
    copies = [list(x) for x in (han, thai)]
    copies[0][7], copies[1][7] = chr(0x9FA0), chr(0x0E40)
    long = [letters(rng, 6) for _ in range(20_000)]
    several = [letters(rng, 6) for _ in range(900)]
    pairs = [(short, edited(rng, short, 2)), ("".join(han), "".join(copies[0])), ("".join(thai), "".join(copies[1])), (long, edited(rng, long, 400)), (several, edited(rng, several, 180))]
    pairs = [tuple([x] if isinstance(x, str) else x for x in pair) for pair in pairs]
    assert kept_lines(spark, pairs) == set()


def test_part_of_an_item_is_found_wherever_it_begins(spark):
    rng = random.Random(23)
    sentence = lambda n: " ".join(letters(rng, rng.randint(2, 9)) for _ in range(n))
    items = [(k, sentence(n)) for k, n in enumerate((12, 25, 33, 60, 100))]
    passages = [(item, text[a : a + 60]) for item, text in items for a in range(0, len(text) - 59, 7)]
    a_letter = [(item, p[:30] + "#" + p[31:]) for item, p in passages]
    docs = [(k, f"{sentence(20)} {p.upper()} {sentence(20)}") for k, (_, p) in enumerate(passages + a_letter)] + [(-1, sentence(500)), (-2, items[3][1][:30])]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(*frames).collect()}
    assert found == {(k, item) for k, (item, _) in enumerate(passages + a_letter)}


def test_labelled_texts_without_words_are_learned_from(spark):
    rows = [(k, text, k % 2) for k, text in enumerate(["", "one two", " ", None, "three", "", "\t"])]
    got = quality_model._rows(spark.createDataFrame(rows, "doc_id long, text string, label int").coalesce(1)).collect()
    assert sorted((r["doc_id"], r["label"], bool(r["at"])) for r in got) == [(k, k % 2, k in (1, 4)) for k in range(7)]
